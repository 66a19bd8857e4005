"""The comment operators' steps as DuckDB SQL, over any source of comments and with any lists: what the queries are compared with."""

from __future__ import annotations

from functools import cached_property

from ..functions import text
from ..functions.lexicon import Lexicon, Taxonomy
from ..operators import cards, clusters

NO_SPACE, SPACE = "[^\\s\\p{Z}]", "[\\s\\p{Z}]"
LATIN, CJK = "[A-Za-z][A-Za-z0-9_-]+", "[一-鿿]{2,}"
CUT = "[，。！？、；：,.!?;:()\\[\\]{}<>《》“”\"''|/\\\\\\-]+"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(items) -> str:
    return "[" + ", ".join(map(quoted, items)) + "]::VARCHAR[]"


def histogram(column: str) -> str:
    """Counts by value as text, in an aggregation: one item per value that occurs."""
    return f"array_to_string(list_transform(list_sort(list_distinct(list({column}))), lambda v: v || '=' || len(list_filter(list({column}), lambda x: x = v))), ',')"


def normal_sql(x: str) -> str:
    out = f"trim(regexp_replace(coalesce({x}, ''), '{SPACE}+', ' ', 'g'))"
    for sign, word in text.EMOJI:
        out = f"replace({out}, {quoted(sign)}, {quoted(word)})"
    for pattern in (f"@{NO_SPACE}+", f"(^|{SPACE})(作者|置顶评论|回复|赞)({SPACE}|$)", f"展开{SPACE}*\\d+{SPACE}*条回复", "<[^>]+>", "[^\\p{L}\\p{N}_，。！？、,.!?：:；;（）()\\-\\s\\p{Z}]"):
        out = f"regexp_replace({out}, {quoted(pattern)}, ' ', 'g')"
    return f"trim(regexp_replace({out}, '{SPACE}+', ' ', 'g'))"


def quality_sql(x: str) -> str:
    short = f"lower(regexp_replace({x}, '{SPACE}+', '', 'g'))"
    flood, telling = (", ".join(map(quoted, w)) for w in (text.FLOOD, text.SHORT_BUT_TELLING))
    adverts = "(?i)" + "|".join(text.ADVERTS)
    return f"CASE WHEN {short} IN ({flood}) THEN 0.0::DOUBLE WHEN regexp_matches({x}, {quoted(adverts)}) THEN 0.1 WHEN length({short}) <= 1 THEN 0.0 WHEN length({short}) <= 4 AND {short} NOT IN ({telling}) THEN 0.45 ELSE least(1.0::DOUBLE, 0.55::DOUBLE + length({short}) / 80.0::DOUBLE) END"


def language_sql(x: str) -> str:
    return f"CASE WHEN length(regexp_replace({x}, '[^一-鿿]', '', 'g')) >= length(regexp_replace({x}, '[^A-Za-z]', '', 'g')) THEN 'zh' ELSE 'en' END"


class Chain:
    """WITH clauses step by step; each property holds all before it. ``rows`` selects seq, id, platform, content, like_count, source_url and more."""

    def __init__(self, rows: str, tax: Taxonomy, lexicon: Lexicon):
        self.rows, self.tax, self.lexicon = rows, tax, lexicon
        self.fallback = quoted(tax.names("stance")[-1])
        self.lows = sorted({t.lower() for t in tax.known_terms})
        self.known = ", ".join(map(quoted, self.lows))

    def _label(self, kind: str) -> tuple[str, str]:
        """label and confidence."""
        pairs = [(t.lower(), label) for label, terms in self.tax.labels[kind].items() for t in terms]
        hit = " OR ".join(f"contains(low, {quoted(t)})" for t, _ in pairs)
        if kind == "stance":
            default, sure, unsure = self.tax.names(kind)[-1], 0.78, 0.45
        else:
            pairs, default, sure, unsure = sorted(pairs, key=lambda p: -len(p[0])), self.tax.names(kind)[0], 0.82, 0.55
        label = "CASE " + " ".join(f"WHEN contains(low, {quoted(t)}) THEN {quoted(v)}" for t, v in pairs) + f" ELSE {quoted(default)} END"
        return label, f"CASE WHEN {hit} THEN {sure}::DOUBLE ELSE {unsure}::DOUBLE END"

    @cached_property
    def cleaned(self) -> str:
        return f"""WITH r AS MATERIALIZED (SELECT *, {normal_sql("content")} AS cleaned_content FROM ({self.rows})),
c AS MATERIALIZED (SELECT *, {quality_sql("cleaned_content")} AS quality_score, {language_sql("cleaned_content")} AS language, lower(cleaned_content) AS low FROM r WHERE cleaned_content <> '' AND {quality_sql("cleaned_content")} > 0.2)"""

    @cached_property
    def deduped(self) -> str:
        return f"""{self.cleaned},
h AS MATERIALIZED (SELECT *, sha1(regexp_replace(low, '[^\\p{{L}}\\p{{N}}_]+', '', 'g')) AS content_hash FROM c),
e AS MATERIALIZED (SELECT *, seq <> min(seq) OVER (PARTITION BY content_hash) AS is_duplicate, CASE WHEN seq <> min(seq) OVER (PARTITION BY content_hash) THEN substr(content_hash, 1, 12) END AS duplicate_group_id FROM h)"""

    @cached_property
    def labelled(self) -> str:
        weights = " + ".join(f"CASE WHEN contains(low, {quoted(t.lower())}) THEN {w} ELSE 0 END" for t, w in self.lexicon.terms)
        (pain, pain_sure), (good, good_sure), (stance, stance_sure) = (self._label(k) for k in ("negative", "positive", "stance"))
        return f"""{self.deduped},
s AS MATERIALIZED (SELECT *, greatest(-100, least(100, {weights})) AS hundredths FROM e),
l AS MATERIALIZED (SELECT *, hundredths / 100.0::DOUBLE AS score, CASE WHEN hundredths >= 55 THEN 'strong_positive' WHEN hundredths >= 15 THEN 'positive' WHEN hundredths <= -55 THEN 'strong_negative' WHEN hundredths <= -15 THEN 'negative' ELSE 'neutral' END AS label,
  CASE WHEN hundredths < -10 THEN {pain} END AS pain, CASE WHEN hundredths < -10 THEN {pain_sure} END AS pain_sure,
  CASE WHEN hundredths > 10 THEN {good} END AS good, CASE WHEN hundredths > 10 THEN {good_sure} END AS good_sure,
  {stance} AS stance, {stance_sure} AS stance_sure FROM s)"""

    @cached_property
    def tokenized(self) -> str:
        stop = ", ".join(map(quoted, self.tax.stop_words))
        body = f"regexp_replace(regexp_replace(regexp_replace(cleaned_content, 'https?://{NO_SPACE}+', ' ', 'g'), '@{NO_SPACE}+', ' ', 'g'), '#([^#]+)#', ' \\1 ', 'g')"
        body = f"trim(regexp_replace(regexp_replace({body}, '{CUT}', ' ', 'g'), '{SPACE}+', ' ', 'g'))"
        keep = f"length(t) > 1 AND t NOT IN ({stop}) AND NOT regexp_full_match(t, '[0-9]+') AND NOT (regexp_full_match(t, '[0-9a-zA-Z_-]+') AND length(t) <= 2)"
        terms = sorted({t.strip() for t in self.tax.known_terms if len(t.strip()) > 1 and t.lower() not in self.tax.stop_words}, key=lambda t: (-len(t), t))
        known = f"list_filter({listed(dict.fromkeys(t.lower() for t in terms))}, lambda t: contains(lower(body), t))"
        words = f"list_transform(regexp_extract_all(body, '({LATIN}|{CJK})', 1), lambda w: lower(w))"
        longer = listed(t for t in self.lows if len(t) >= 2)
        wanted = f"regexp_full_match(t, '{LATIN}') OR t IN ({self.known}) OR (length(t) <= 6 AND len(list_filter({longer}, lambda x: contains(t, x))) > 0)"
        return f"""{self.labelled},
t AS MATERIALIZED (SELECT *, list_distinct(list_filter(list_concat({known}, list_filter({words}, lambda t: ({keep}) AND ({wanted}))), lambda t: {keep})) AS keys FROM (SELECT *, {body} AS body FROM l)),
n AS MATERIALIZED (SELECT *, NOT (coalesce(pain_sure >= 0.6, false) OR coalesce(good_sure >= 0.6, false) OR list_has_any(keys, [{self.known}])) AND (stance = {self.fallback} OR length(trim(cleaned_content)) <= 8) AS is_noise_row FROM t)"""

    @property
    def written(self) -> str:
        """seq and the tokens in the forms in which they stand, of forms that differ in case alone the first."""
        stop = ", ".join(map(quoted, self.tax.stop_words))
        keep = f"length(t) > 1 AND lower(t) NOT IN ({stop}) AND NOT regexp_full_match(t, '[0-9]+') AND NOT (regexp_full_match(t, '[0-9a-zA-Z_-]+') AND length(t) <= 2)"
        terms = listed(sorted({t.strip() for t in self.tax.known_terms if len(t.strip()) > 1 and t.lower() not in self.tax.stop_words}, key=lambda t: (-len(t), t)))
        longer = listed(t for t in self.lows if len(t) >= 2)
        wanted = f"regexp_full_match(t, '{LATIN}') OR lower(t) IN ({self.known}) OR (length(t) <= 6 AND len(list_filter({longer}, lambda x: contains(lower(t), x))) > 0)"
        words = f"list_filter(regexp_extract_all(body, '({LATIN}|{CJK})', 1), lambda t: ({keep}) AND ({wanted}))"
        every = f"list_filter(list_concat(list_filter({terms}, lambda t: contains(lower(body), lower(t))), {words}), lambda t: {keep})"
        return f"""{self.tokenized}, f AS MATERIALIZED (SELECT seq, every, list_transform(every, lambda x: lower(x)) AS lows FROM (SELECT seq, {every} AS every FROM t))
SELECT seq, array_to_string(list_filter(every, lambda x, i: list_position(lows, lower(x)) = i), ',') AS tokens FROM f"""

    @cached_property
    def clustered(self) -> str:
        return f"""{self.tokenized},
k AS MATERIALIZED (SELECT *, CASE WHEN is_noise_row THEN '{clusters.NOISE_KEY}' ELSE coalesce(pain, good, CASE WHEN stance IN ('{clusters.INFORMATION}', {self.fallback}) THEN '{clusters.NEUTRAL_NAME}' ELSE stance || '{clusters.TALK}' END) END AS cluster_key FROM n),
z AS MATERIALIZED (SELECT cluster_key, count(*) AS cluster_size FROM k WHERE NOT is_duplicate GROUP BY cluster_key),
y AS MATERIALIZED (SELECT *, CASE WHEN cluster_key = '{clusters.NOISE_KEY}' THEN -1 ELSE row_number() OVER (ORDER BY cluster_key = '{clusters.NOISE_KEY}', cluster_size DESC, cluster_key) - 1 END AS cluster_id FROM z),
g AS MATERIALIZED (SELECT k.*, CASE WHEN NOT is_duplicate THEN cluster_id END AS cluster_id FROM k LEFT JOIN y ON k.cluster_key = y.cluster_key),
o AS MATERIALIZED (SELECT * FROM g WHERE NOT is_duplicate)"""

    @cached_property
    def named(self) -> str:
        """v: a row per cluster with its name (in small letters) and all that a summary has."""
        moods = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in clusters.SENTIMENT_NAMES.items())
        stances = f"CASE WHEN st = {self.fallback} THEN '{clusters.NEUTRAL_NAME}' ELSE st || '{clusters.TALK}' END"

        def first(column: str, name: str) -> str:
            return f"(SELECT cluster_id, {column} AS {name}, row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, min(seq), {column}) AS i FROM o WHERE {column} IS NOT NULL GROUP BY cluster_id, {column})"

        return f"""{self.clustered},
kw AS MATERIALIZED (SELECT cluster_id, list(key ORDER BY rank) AS words FROM (SELECT cluster_id, key, row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, min(seq), key) AS rank FROM (SELECT cluster_id, seq, unnest(keys) AS key FROM o) GROUP BY cluster_id, key) WHERE rank <= 6 GROUP BY cluster_id),
ex AS MATERIALIZED (SELECT cluster_id, string_agg(cleaned_content, '|' ORDER BY i) AS texts FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY like_count DESC, abs(score) DESC, length(cleaned_content) DESC, seq) AS i FROM o) WHERE i <= 3 GROUP BY cluster_id),
ba AS MATERIALIZED (SELECT cluster_id, count(*) AS cluster_size, cluster_id = -1 OR bool_and(is_noise_row) AS is_noise, {histogram("label")} AS moods FROM o GROUP BY cluster_id),
v AS MATERIALIZED (SELECT ba.*, round(cluster_size / (SELECT count(*) FROM o)::DOUBLE, 4) AS cluster_ratio, coalesce(array_to_string(words, ','), '') AS top_keywords, texts,
  CASE WHEN is_noise THEN '{clusters.NOISE_NAME}' ELSE left(lower(coalesce(lb, {stances})) || '｜' || coalesce(array_to_string(words[1:3], '、'), '{clusters.NO_KEYWORDS}') || '｜' || CASE md {moods} ELSE md END, 80) END AS cluster_name
  FROM ba LEFT JOIN {first("coalesce(pain, good)", "lb")} a ON ba.cluster_id = a.cluster_id AND a.i = 1 LEFT JOIN {first("stance", "st")} b ON ba.cluster_id = b.cluster_id AND b.i = 1 LEFT JOIN {first("label", "md")} d ON ba.cluster_id = d.cluster_id AND d.i = 1
  LEFT JOIN kw ON ba.cluster_id = kw.cluster_id LEFT JOIN ex ON ba.cluster_id = ex.cluster_id)"""

    @property
    def summary(self) -> str:
        return f"{self.named} SELECT CAST(cluster_id AS BIGINT) AS cluster_id, cluster_name, cluster_size, cluster_ratio, top_keywords, moods, is_noise, texts AS representative_comments FROM v"

    @property
    def frequencies(self) -> str:
        return f"{self.tokenized}, f AS MATERIALIZED (SELECT key, count(*) AS df FROM (SELECT unnest(keys) AS key FROM t WHERE NOT is_duplicate) GROUP BY key)"

    def cloud(self, where: str = "true") -> str:
        boosted = f"CASE WHEN key IN ({self.known}) THEN 1.75 WHEN length(key) >= 4 AND len(list_filter({listed(self.lows)}, lambda x: contains(key, x))) > 0 THEN 1.35 ELSE 1.0 END"
        return f"""{self.tokenized}, q AS MATERIALIZED (SELECT * FROM t WHERE NOT is_duplicate AND {where}), f AS MATERIALIZED (SELECT key, count(*) AS df FROM (SELECT unnest(keys) AS key FROM q) GROUP BY key),
w AS (SELECT key, df, df * (ln(((SELECT count(*) FROM q WHERE len(keys) > 0) + 1) / (df + 1)::DOUBLE) + 1) * {boosted} AS score FROM f)
SELECT key, df, round(1 + score / (SELECT max(score) FROM w) * 9, 3) AS weight FROM (SELECT * FROM w ORDER BY score DESC, key LIMIT 60)"""

    def cards(self, of_clusters: bool) -> str:
        """The evidence cards with their texts; with those of clusters, whose names are in small letters."""
        base = self.named if of_clusters else f"{self.labelled}, o AS MATERIALIZED (SELECT * FROM l WHERE NOT is_duplicate)"
        third = "UNION ALL SELECT 2, cluster_name, seq, id, cleaned_content, like_count FROM o JOIN v ON o.cluster_id = v.cluster_id WHERE NOT is_noise" if of_clusters else ""
        kinds = (cards.RISK, cards.OPPORTUNITY, cards.TOPIC)

        def by_kind(texts, argument: str = "subject") -> str:
            parts = (f"WHEN {i} THEN " + (f"replace({quoted(t)}, '%s', {argument})" if "%s" in t else quoted(t)) for i, t in enumerate(texts))
            return f"CASE kind {' '.join(parts)} END"

        actions = " || '|' || ".join(by_kind([cards.ACTIONS[k][i] for k in kinds]) for i in range(3))
        reasons = {k: quoted(v) for k, v in cards.REASONS.items()}
        return f"""{base}, a AS (SELECT 0 AS kind, pain AS category, seq, id, cleaned_content, like_count FROM o WHERE pain IS NOT NULL UNION ALL SELECT 1, good, seq, id, cleaned_content, like_count FROM o WHERE good IS NOT NULL {third}),
b AS (SELECT *, count(*) OVER (PARTITION BY kind, category) AS n, min(seq) OVER (PARTITION BY kind, category) AS f, row_number() OVER (PARTITION BY kind, category ORDER BY like_count DESC, seq) AS i FROM a),
d AS (SELECT kind, category, n, f, string_agg(id, ',' ORDER BY i) AS ids, string_agg(cleaned_content, '|' ORDER BY i) AS evidence FROM b WHERE i <= 3 AND n >= 2 GROUP BY ALL),
p AS (SELECT *, row_number() OVER (ORDER BY n DESC, kind, f, category) AS place FROM d),
u AS (SELECT *, row_number() OVER (PARTITION BY ids ORDER BY place) AS copy FROM p),
x AS (SELECT *, row_number() OVER (ORDER BY place) AS card_rank, (SELECT count(*) FROM o) AS size, CASE WHEN kind = 2 THEN split_part(category, '｜', 1) ELSE category END AS subject FROM u WHERE copy = 1)
SELECT CAST(card_rank AS INTEGER) AS card_rank, {by_kind([cards.TITLES[k] for k in kinds])} AS title, CASE kind WHEN 0 THEN '{kinds[0]}' WHEN 1 THEN '{kinds[1]}' ELSE '{kinds[2]}' END AS card_type, category, ids, evidence, n AS evidence_count, size AS sample_size, round(n / size::DOUBLE, 4) AS affected_ratio,
  CASE WHEN size < 100 THEN 'low' WHEN n >= 12 AND n / size::DOUBLE >= 0.12 THEN 'high' WHEN n >= 5 THEN 'medium' ELSE 'low' END AS confidence,
  CASE WHEN size < 100 THEN printf({reasons["small"]}, size, n, n / size::DOUBLE * 100) WHEN n >= 12 AND n / size::DOUBLE >= 0.12 THEN printf({reasons["high"]}, n, size, n / size::DOUBLE * 100) WHEN n >= 5 THEN printf({reasons["medium"]}, n, n / size::DOUBLE * 100) ELSE printf({reasons["low"]}, n, n / size::DOUBLE * 100) END AS confidence_reason,
  {actions} AS actions, {by_kind([cards.IMPACT[k] for k in kinds])} AS expected_impact, replace({quoted(cards.DESIGN["hypothesis"])}, '%s', category) AS hypothesis FROM x WHERE card_rank <= 4"""
