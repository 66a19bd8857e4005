"""Comment files: CSV, JSON and JSON lines in one fixed schema, with column aliases or a given mapping."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from .order import FILE, START, numbered, with_places

# Names under which each field may come.
ALIASES = {
    "id": ("id", "comment_id"),
    "content": ("content", "comment_text", "text"),
    "author_hash": ("author_hash", "author", "user_id"),
    "like_count": ("like_count", "likes"),
    "reply_count": ("reply_count", "replies"),
    "publish_time": ("publish_time", "created_at", "time"),
    "source_url": ("source_url", "url"),
    "parent_id": ("parent_id",),
    "platform": ("platform", "source"),
    "topic": ("topic", "title"),
}
UPLOAD_ALIASES = ALIASES | {"content": ("content", "comment_text", "text", "comment", "body", "message", "评论内容", "内容"), "like_count": ("like_count", "likes", "点赞数"), "publish_time": ("publish_time", "created_at", "time", "date", "发布时间")}
RECORD_KEYS = ("comments", "data", "items", "records")
# End of fixed values.
#: The number of a row in its file, among raw columns.
SEQ = "__seq"
MOST_BYTES = 10 << 20
PREVIEW = 10


def holds_line_breaks(spark: SparkSession, path: str) -> bool:
    """Whether a quoted field of a CSV file may hold a line break: some line then has an odd number of quotes."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(quotes % 2 == 1).isEmpty()


def read_rows(spark: SparkSession, path: str, places: bool = False) -> DataFrame:
    """All columns as text. JSON files hold a list, or an object with a list under one of the record keys.

    A CSV file without line breaks in fields is read in splits, others whole. ``places`` adds where rows are from, for :func:`order.numbered`.
    """
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    keep = with_places if places else lambda df: df
    if suffix == "csv":
        return keep(spark.read.option("header", True).option("multiLine", holds_line_breaks(spark, path)).option("escape", '"').csv(path))
    if suffix == "jsonl":
        return keep(spark.read.option("primitivesAsString", True).json(path))
    if suffix != "json":
        raise ValueError(f"no reader for .{suffix}")
    found = keep(spark.read.option("multiLine", True).option("primitivesAsString", True).json(path))
    for key in RECORD_KEYS:
        if key in found.columns and found.schema[key].dataType.typeName() == "array":
            return found.select(*([FILE, START] if places else []), F.explode(key).alias("r")).select(*([FILE, START] if places else []), "r.*")
    return found


def auto_mapping(columns: list[str]) -> dict[str, str]:
    """Field to column by the first alias that is there, whatever its case."""
    known = {c.strip().lower(): c for c in columns}
    return {name: known[a] for name, aliases in UPLOAD_ALIASES.items() for a in [next((a for a in aliases if a in known), None)] if a}


def mapping_errors(mapping: dict[str, str], columns: list[str]) -> list[str]:
    errors = [] if mapping.get("content") else ["content needs a column"]
    return errors + [f"{name}: no column {column}" for name, column in mapping.items() if column and column not in columns]


def with_mapping(mapping: dict[str, str], changes: dict[str, str], columns: list[str]) -> tuple[dict[str, str], str]:
    """The changed mapping, known fields with a column only, and its status."""
    merged = {k: v for k, v in (mapping | changes).items() if k in ALIASES and v}
    return merged, "needs_mapping" if mapping_errors(merged, columns) else "ready"


def normalize_rows(df: DataFrame, platform: str = "", topic: str = "", mapping: dict[str, str] | None = None) -> DataFrame:
    """Raw rows to the comment schema; ``seq`` is theirs, or comes from the order read. A mapped field takes its column alone, even where that is empty."""
    mapping = mapping or {}

    def given(column: str) -> Column:
        own = F.col(f"`{column}`").cast("string")
        return F.when(own != "", own)

    def value(name: str) -> Column:
        if mapping.get(name):
            return given(mapping[name])
        found = [given(a) for a in ALIASES[name] if a in df.columns]
        return F.coalesce(*found) if found else F.lit(None).cast("string")

    content = F.coalesce(value("content"), F.lit(""))
    return df.select(
        (F.col(SEQ) if SEQ in df.columns else F.monotonically_increasing_id()).alias("seq"),
        F.coalesce(value("id"), text.surrogate_id(content)).alias("id"),
        F.coalesce(value("platform"), F.lit(platform)).alias("platform"),
        F.coalesce(value("topic"), F.lit(topic)).alias("topic"),
        content.alias("content"),
        F.coalesce(value("author_hash"), F.lit("anonymous")).alias("author_hash"),
        text.safe_int(value("like_count")).cast("int").alias("like_count"),
        text.safe_int(value("reply_count")).cast("int").alias("reply_count"),
        F.coalesce(value("publish_time"), F.lit("")).alias("publish_time"),
        F.coalesce(value("source_url"), F.lit("")).alias("source_url"),
        value("parent_id").alias("parent_id"),
    )


def comments_from_file(spark: SparkSession, path: str, most: int = 5000, **options) -> DataFrame:
    """The first ``most`` comments of a file, numbered in its order."""
    return normalize_rows(numbered(read_rows(spark, path, places=True), SEQ, most), **options)


@dataclass
class Inspection:
    columns: list[str]
    preview: list[dict]
    n_rows: int
    mapping: dict[str, str]
    status: str
    errors: list[str] = field(default_factory=list)


def inspect(spark: SparkSession, path: str, size: int | None = None) -> Inspection:
    """What an uploaded file holds; empty and too large files are errors."""
    if size is not None and not 0 < size <= MOST_BYTES:
        raise ValueError("empty file" if size == 0 else "file too large")
    rows = read_rows(spark, path)
    mapping = auto_mapping(rows.columns)
    errors = mapping_errors(mapping, rows.columns)
    return Inspection(rows.columns, [r.asDict(recursive=True) for r in rows.limit(PREVIEW).collect()], rows.count(), mapping, "needs_mapping" if errors else "ready", errors)
