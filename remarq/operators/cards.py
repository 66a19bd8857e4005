"""Evidence cards: groups of comments with their best evidence, confidence and suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RISK, OPPORTUNITY, TOPIC = "risk_explanation", "opportunity_amplification", "topic_explanation"
MOST_CARDS, EVIDENCE, LEAST_ROWS = 4, 3, 2

# The cards' wording, by type.
TITLES = {RISK: "用事实拆解「%s」争议", OPPORTUNITY: "放大「%s」认可点", TOPIC: "围绕「%s」制作深度解读"}
ACTIONS = {
    RISK: ("整理与「%s」直接相关的比赛回合、技术统计和官方说明。", "将事实、球迷观点和仍无法确认的信息分栏呈现。", "在标题和摘要中避免把抽样评论写成全体球迷结论。"),
    OPPORTUNITY: ("围绕「%s」制作球员表现或球队战术拆解。", "引用高赞代表评论，同时附上对应技术统计和比赛节点。", "补充不同立场评论，避免只展示单一阵营。"),
    TOPIC: ("以「%s」为主线组织比赛复盘。", "按观点、证据和反方意见三个层次编排内容。", "在结尾列出下一场可继续验证的数据指标。"),
}
IMPACT = {RISK: "降低争议内容中的事实混淆，提高报告可解释性。", OPPORTUNITY: "提升高认可主题的内容相关性和读者互动。", TOPIC: "让分散评论形成可阅读、可验证的比赛主题脉络。"}
DESIGN = {
    "hypothesis": "使用证据导向的「%s」拆解，比普通赛后摘要获得更高的有效阅读和理性互动。",
    "control": "发布常规赛后概述，只呈现结论。",
    "variant": "发布观点 + 原评论证据 + 技术统计/官方上下文的结构化拆解。",
    "primary_metric": "报告完整阅读率",
}
GUARDRAILS = ("负面举报率", "事实更正次数", "评论区无关争论占比")
REASONS = {
    "small": "样本量仅 %d 条，小于 100；证据 %d 条，占比 %.1f%%。",
    "high": "证据 %d 条，占 %d 条样本的 %.1f%%，覆盖稳定。",
    "medium": "证据 %d 条，占比 %.1f%%，建议继续补充样本验证。",
    "low": "只有 %d 条证据，占比 %.1f%%，结论仅供探索。",
}
# End of fixed values.


def confidence(n: Column, total: Column) -> Column:
    ratio = n / total
    return F.when(total < 100, "low").when((n >= 12) & (ratio >= 0.12), "high").when(n >= 5, "medium").otherwise("low")


def confidence_reason(n: Column, total: Column) -> Column:
    share = n / total * 100
    return (
        F.when(total < 100, F.format_string(REASONS["small"], total, n, share))
        .when((n >= 12) & (n / total >= 0.12), F.format_string(REASONS["high"], n, total, share))
        .when(n >= 5, F.format_string(REASONS["medium"], n, share))
        .otherwise(F.format_string(REASONS["low"], n, share))
    )


def candidates(df: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """Rows (kind, category, seq, id, ...) of all groups: pain labels, positive labels, names of clusters that are no noise. One pass over the comments."""
    own = df.where(~F.col("is_duplicate"))
    groups = [F.struct(F.lit(0).alias("kind"), F.col("painpoint.category").alias("category")), F.struct(F.lit(1).alias("kind"), F.col("positive_attribution.category").alias("category"))]
    if clusters is not None:
        names = clusters.where(~F.col("is_noise")).select("cluster_id", "cluster_name")
        own = own.join(F.broadcast(names), "cluster_id", "left")  # a row per cluster
        groups.append(F.struct(F.lit(2).alias("kind"), F.col("cluster_name").alias("category")))
    given = F.filter(F.array(*groups), lambda g: F.coalesce(g["category"], F.lit("")) != "")
    return own.select(F.explode(given).alias("g"), "seq", "id", "content", "cleaned_content", "source_url", "like_count").select("g.kind", "g.category", "seq", "id", "content", "cleaned_content", "source_url", "like_count")


def evidence(rows: DataFrame) -> DataFrame:
    """Per group: n, first_seq and the most liked rows; sizes by pre-aggregation, the top by a window that keeps three rows."""
    sizes = rows.groupBy("kind", "category").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq")).where(F.col("n") >= LEAST_ROWS)
    order = Window.partitionBy("kind", "category").orderBy(F.desc("like_count"), "seq")
    best = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= EVIDENCE)
    item = F.struct("rank", F.col("id").cast("string").alias("comment_id"), F.coalesce(F.when(F.col("cleaned_content") != "", F.col("cleaned_content")), "content", F.lit("")).alias("content"), F.coalesce("source_url", F.lit("")).alias("source_url"), F.coalesce("like_count", F.lit(0)).cast("long").alias("like_count"))
    return sizes.join(best.groupBy("kind", "category").agg(F.array_sort(F.collect_list(item)).alias("evidence")), ["kind", "category"])


def ranked(groups: DataFrame) -> DataFrame:
    """The first four groups, largest first, whose evidence no earlier one has; ranks a row per group."""
    order = Window.orderBy(F.desc("n"), "kind", "first_seq", "category")
    signed = groups.withColumn("signature", F.transform("evidence", lambda e: e["comment_id"])).withColumn("__place", F.row_number().over(order))
    fresh = signed.withColumn("__copy", F.row_number().over(Window.partitionBy("signature").orderBy("__place"))).where("__copy = 1")
    return fresh.withColumn("card_rank", F.row_number().over(Window.orderBy("__place"))).where(F.col("card_rank") <= MOST_CARDS).drop("__place", "__copy")


def _by_type(kind: Column, texts: dict[str, str], argument: Column) -> Column:
    out = F.lit(None).cast("string")
    for i, name in enumerate((RISK, OPPORTUNITY, TOPIC)):
        text = texts[name]
        out = F.when(kind == i, F.format_string(text, argument) if "%s" in text else F.lit(text)).otherwise(out)
    return out


def cards(df: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """The evidence cards of a run, none for fewer than two non-duplicates."""
    total = df.where(~F.col("is_duplicate")).agg(F.count("*").alias("sample_size"))
    top = ranked(evidence(candidates(df, clusters))).join(F.broadcast(total), F.lit(True)).where("sample_size >= 2")
    kind, short = F.col("kind"), F.split_part(F.col("category"), F.lit("｜"), F.lit(1))
    subject = F.when(kind == 2, short).otherwise(F.col("category"))
    actions = F.array(*(_by_type(kind, {t: ACTIONS[t][i] for t in ACTIONS}, subject) for i in range(3)))
    n, size = F.col("n"), F.col("sample_size")
    card_type = F.element_at(F.array(F.lit(RISK), F.lit(OPPORTUNITY), F.lit(TOPIC)), kind + 1)
    design = F.struct(
        F.format_string(DESIGN["hypothesis"], F.col("category")).alias("hypothesis"),
        *(F.lit(DESIGN[k]).alias(k) for k in ("control", "variant", "primary_metric")),
        F.array(*map(F.lit, GUARDRAILS)).alias("guardrail_metrics"),
        F.format_string("当前分析样本为 %d 条；实验流量和周期需在发布渠道中另行估算。", size).alias("sample_size_note"),
        card_type.alias("source_type"),
    )
    return top.select(
        "card_rank",
        _by_type(kind, TITLES, subject).alias("title"),
        card_type.alias("card_type"),
        "category",
        F.col("signature").alias("evidence_comment_ids"),
        F.transform("evidence", lambda e: F.struct(e["comment_id"].alias("comment_id"), e["content"].alias("content"), e["source_url"].alias("source_url"), e["like_count"].alias("like_count"))).alias("evidence_comments"),
        n.alias("evidence_count"),
        "sample_size",
        F.round(n / size, 4).alias("affected_ratio"),
        confidence(n, size).alias("confidence"),
        confidence_reason(n, size).alias("confidence_reason"),
        actions.alias("suggested_actions"),
        _by_type(kind, IMPACT, subject).alias("expected_impact"),
        design.alias("ab_test_design"),
    )


def listed(found: DataFrame) -> DataFrame:
    """Cards to show, by share."""
    return found.where(F.col("evidence_count") >= LEAST_ROWS).orderBy(F.desc("affected_ratio"), "card_rank")


def exported(found: DataFrame) -> DataFrame:
    """Cards as JSON text."""
    return found.where(F.col("evidence_count") >= LEAST_ROWS).select("card_rank", F.to_json(F.struct(*found.columns)).alias("json"))


def drafts(found: DataFrame) -> DataFrame:
    """Experiment drafts from the cards' designs, with the card's own texts where a design has none."""
    d = F.col("ab_test_design")
    return found.select("card_rank", "title", F.coalesce(d["hypothesis"], "expected_impact").alias("hypothesis"), F.coalesce(d["control"], F.lit("")).alias("control"), F.coalesce(d["variant"], "title").alias("variant"), F.coalesce(d["primary_metric"], F.lit("")).alias("primary_metric"), d["guardrail_metrics"].alias("guardrail_metrics"))
