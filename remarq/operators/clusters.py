"""Clusters of comments: noise rules, rule groups, k-means, summaries and representatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexicon import Taxonomy
from ..storage import stored
from .dedup import MOST_ROWS

# Names that appear in results.
NOISE_KEY, NOISE_NAME = "__noise__", "噪声/低信息评论"
NEUTRAL_NAME, TALK = "信息补充/中性讨论", "讨论"
INFORMATION = "信息补充"
NO_KEYWORDS = "无明显关键词"
SENTIMENT_NAMES = {"strong_positive": "强正向", "positive": "正向", "neutral": "中性", "negative": "负向", "strong_negative": "强负向"}
# End of fixed values.
SEED = 42


def noise(df: DataFrame, tax: Taxonomy) -> DataFrame:
    """``is_noise_row``: no sure label, no known term, and no stance or hardly any text."""
    lows = sorted({t.lower() for t in tax.known_terms})
    known = F.exists("tokens", lambda t: F.lower(t).isin(*lows)) if lows else F.lit(False)

    def sure(field: str) -> Column:
        return F.coalesce(F.col(f"{field}.confidence") >= 0.6, F.lit(False))

    signal = sure("painpoint") | sure("positive_attribution") | known
    fallback = F.col("stance.label") == tax.names("stance")[-1]
    return df.withColumn("is_noise_row", ~signal & (fallback | (F.length(F.trim("cleaned_content")) <= 8)))


def rule_key(df: DataFrame, tax: Taxonomy) -> DataFrame:
    """``cluster_key`` by noise, pain label, positive label or stance."""
    stance = F.col("stance.label")
    talk = F.when(stance.isin(INFORMATION, tax.names("stance")[-1]), NEUTRAL_NAME).otherwise(F.concat(stance, F.lit(TALK)))
    key = F.when(F.col("is_noise_row"), NOISE_KEY).otherwise(F.coalesce("painpoint.category", "positive_attribution.category", talk))
    return df.withColumn("cluster_key", key)


def numbered(df: DataFrame, key: str = "cluster_key") -> DataFrame:
    """key, cluster_id, cluster_size: noise is -1, the rest count up from the largest; equals by spelling.

    Ranks a row per cluster, not the comments.
    """
    sizes = df.groupBy(F.col(key).alias("cluster_key")).agg(F.count("*").alias("cluster_size"))
    ranked = F.row_number().over(Window.orderBy(F.col("cluster_key") == NOISE_KEY, F.desc("cluster_size"), "cluster_key")) - 1
    return sizes.withColumn("cluster_id", F.when(F.col("cluster_key") == NOISE_KEY, -1).otherwise(ranked))


def k_for(n: int) -> int:
    return max(2, min(6, int(n**0.5)))


def kmeans_clusters(df: DataFrame, vector: str = "embedding", seed: int = SEED, k: int | None = None) -> DataFrame:
    """``cluster_label`` by Spark's k-means over the rows that are no noise; noise rows get -1."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    ready = df.withColumn("__v", array_to_vector(F.col(vector).cast("array<double>")))
    own = ready.where(~F.col("is_noise_row")) if "is_noise_row" in df.columns else ready
    n = own.count()
    k = k or k_for(n)
    if n <= k:
        return df.withColumn("cluster_label", F.lit(None).cast("int"))
    model = KMeans(k=k, seed=seed, featuresCol="__v", predictionCol="cluster_label").fit(own)
    found = model.transform(own).drop("__v")
    if "is_noise_row" not in df.columns:
        return found
    return found.unionByName(df.where("is_noise_row").withColumn("cluster_label", F.lit(-1)))


def have_vectors(df: DataFrame, vector: str = "embedding") -> bool:
    """Whether every row has a vector that is not empty; a table without rows or without the column has none."""
    if vector not in df.columns:
        return False
    bad, n = df.agg(F.count_if(F.coalesce(F.size(vector), F.lit(0)) <= 0), F.count("*")).first()
    return n > 0 and not bad


def method_for(n: int, vectors: bool = True, density: bool = False) -> str:
    """The method ladder: by density from 30 rows on if asked for (to the comment limit of a run), else k-means from 12 rows on, if all have vectors; else rules."""
    if not vectors or n < 12:
        return "rules"
    return "density" if density and 30 <= n <= MOST_ROWS else "kmeans"


def top_counts(df: DataFrame, group: list[str], value: str, k: int, first: str = "first_seq") -> DataFrame:
    """The k most frequent values of each group with counts; of equals the first seen, then by spelling."""
    counted = df.groupBy(*group, value).agg(F.count("*").alias("n"), F.min("seq").alias(first))
    ranked = Window.partitionBy(*group).orderBy(F.desc("n"), first, value)
    return counted.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)


def mode_label(df: DataFrame, tax: Taxonomy) -> DataFrame:
    """cluster_id, base_name: the commonest pain or positive label of the cluster, else its commonest stance."""
    label = F.coalesce("painpoint.category", "positive_attribution.category")
    named = top_counts(df.where(label.isNotNull()).withColumn("label", label), ["cluster_id"], "label", 1).select("cluster_id", "label")
    stances = top_counts(df.withColumn("stance_label", F.col("stance.label")), ["cluster_id"], "stance_label", 1).select("cluster_id", "stance_label")
    return stances.join(named, "cluster_id", "left").select("cluster_id", F.coalesce("label", _talk(tax)).alias("base_name"))


def _talk(tax: Taxonomy) -> Column:
    """The name that a stance gives to a cluster without labels."""
    return F.when(F.col("stance_label") == tax.names("stance")[-1], NEUTRAL_NAME).otherwise(F.concat("stance_label", F.lit(TALK)))


def keywords(df: DataFrame, k: int = 6) -> DataFrame:
    """cluster_id, rank, word, n: the k tokens that most rows of a cluster have."""
    each = df.select("cluster_id", "seq", F.explode("tokens").alias("word"))
    return top_counts(each, ["cluster_id"], "word", k).select("cluster_id", "rank", "word", "n")


def examples(df: DataFrame, k: int = 3) -> DataFrame:
    """cluster_id, rank, seq, content: most liked, then strongest, then longest."""
    order = Window.partitionBy("cluster_id").orderBy(F.desc("like_count"), F.desc(F.abs("sentiment.score")), F.desc(F.length("cleaned_content")), "seq")
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("cluster_id", "rank", "seq", "cleaned_content")


def representative_score() -> Column:
    return F.col("like_count") * 0.08 + F.abs("sentiment.score") + F.least(F.lit(1.0), F.length("cleaned_content") / F.lit(80.0))


def representatives(df: DataFrame, k: int = 3) -> DataFrame:
    """cluster_id, rank, seq, id of each cluster's k best rows by likes, strength and clarity; duplicates never."""
    order = Window.partitionBy("cluster_id").orderBy(F.desc(F.round(representative_score(), 6)), "seq")
    return df.where(~F.col("is_duplicate")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("cluster_id", "rank", "seq", "id")


def sizes(df: DataFrame) -> DataFrame:
    """cluster_id, cluster_size and is_noise of the non-duplicates' clusters; one pass."""
    counted = df.where(~F.col("is_duplicate")).groupBy("cluster_id").agg(F.count("*").alias("cluster_size"), F.bool_and("is_noise_row").alias("all_noise"))
    return counted.select("cluster_id", "cluster_size", ((F.col("cluster_id") == -1) | F.col("all_noise")).alias("is_noise"))


def summary(df: DataFrame, tax: Taxonomy, method: str = "rules") -> DataFrame:
    """A row per cluster: size, share of the non-duplicates, noise flag, name, keywords, sentiment histogram, examples.

    Labels, stances and moods are counted in one pass, into cells that only their numbers bound; two more passes find keywords and examples.
    """
    own = df.where(~F.col("is_duplicate"))
    label = F.coalesce("painpoint.category", "positive_attribution.category")
    cells = own.groupBy("cluster_id", label.alias("label"), F.col("stance.label").alias("stance_label"), F.col("sentiment.label").alias("mood")).agg(F.count("*").alias("c"), F.min("seq").alias("f"), F.bool_and("is_noise_row").alias("noisy"))
    cells = stored(cells, "cluster-cells")
    base = cells.groupBy("cluster_id").agg(F.sum("c").alias("cluster_size"), F.bool_and("noisy").alias("all_noise"))
    base = base.withColumn("total", F.sum("cluster_size").over(Window.partitionBy()))  # a row per cluster

    def first_of(column: str) -> DataFrame:
        counted = cells.where(F.col(column).isNotNull()).groupBy("cluster_id", column).agg(F.sum("c").alias("n"), F.min("f").alias("f"))
        place = F.struct((-F.col("n")).alias("a"), "f", column)
        return counted.groupBy("cluster_id").agg(F.min_by(column, place).alias(column), F.map_from_entries(F.collect_list(F.struct(column, "n"))).alias(f"{column}_counts"))

    words = keywords(own).groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]).alias("top_keywords"))
    texts = examples(own).groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "cleaned_content"))), lambda x: x["cleaned_content"]).alias("representative_comments"))
    met = base
    for part in (first_of("label"), first_of("stance_label"), first_of("mood"), words, texts):
        met = met.join(F.broadcast(part), "cluster_id", "left")  # a row per cluster each
    noisy = (F.col("cluster_id") == -1) | F.col("all_noise")
    mood = F.coalesce(F.create_map(*(F.lit(x) for kv in SENTIMENT_NAMES.items() for x in kv))[F.col("mood")], F.col("mood"))
    shown = F.coalesce(F.when(F.size("top_keywords") > 0, F.array_join(F.slice("top_keywords", 1, 3), "、")), F.lit(NO_KEYWORDS))
    name = F.when(noisy, NOISE_NAME).otherwise(F.substring(F.concat_ws("｜", F.coalesce("label", _talk(tax)), shown, mood), 1, 80))
    return met.select("cluster_id", name.alias("cluster_name"), "cluster_size", F.round(F.col("cluster_size") / F.col("total"), 4).alias("cluster_ratio"), F.coalesce("top_keywords", F.array().cast("array<string>")).alias("top_keywords"), F.col("mood_counts").alias("sentiment_distribution"), F.lit(method).alias("method"), noisy.alias("is_noise"), F.coalesce("representative_comments", F.array().cast("array<string>")).alias("representative_comments"))


def noise_ratio(df: DataFrame) -> DataFrame:
    """Share of the non-duplicates in cluster -1."""
    return df.where(~F.col("is_duplicate")).agg(F.round(F.coalesce(F.avg((F.col("cluster_id") == -1).cast("double")), F.lit(0.0)), 4).alias("noise_ratio"))
