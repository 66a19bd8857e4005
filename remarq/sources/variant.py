"""Rows and replies as VARIANT columns: JSON that differs from row to row, or comes with something around it, read in one pass.

Defined cases: what is no JSON, also without what stands around it, is null; so are values that a row lacks. Names are those of the upper level; objects below the level
that is asked for stay JSON text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What joins the pairs of an object, and a name with its value, in texts.
JOINED, NAMED = "；", "："


def tolerant(text: Column) -> Column:
    """A text as a variant: as it is, without a fence around it, or what lies between its first opening and its last closing brace."""
    bare = F.regexp_replace(F.trim(text), r"(?s)^```(?:json)?\s*|\s*```$", "")
    braced = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(bare), F.try_parse_json(braced))


def kind(v: Column) -> Column:
    """OBJECT, ARRAY or the name of a scalar's type; null of null."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def objects(df: DataFrame, text: str, name: str = "row") -> DataFrame:
    """The rows whose text is an object, with it as a variant; rows of other kinds go."""
    read = df.withColumn(name, tolerant(F.col(text)))
    return read.where(kind(F.col(name)) == "OBJECT")


def names(df: DataFrame, column: str = "row") -> list[str]:
    """All fields of the rows' objects, by spelling. They come to the driver: they are the columns of a table."""
    keys = F.map_keys(F.try_variant_get(F.col(column), "$", "map<string, string>"))
    found = df.select(F.explode(keys).alias("key")).distinct().orderBy("key")
    return [r["key"] for r in found.collect()]


def field(v: Column, name: str, kind_: str = "string") -> Column:
    """A field by its whole name, dots and quotes included."""
    quoted = name.replace("\\", "\\\\").replace('"', '\\"')
    return F.try_variant_get(v, f'$["{quoted}"]', kind_)


def table(df: DataFrame, column: str = "row", fields: list[str] | None = None) -> DataFrame:
    """The fields of all rows as text columns in place of the variant; a row has null for those that it lacks."""
    wanted = names(df, column) if fields is None else fields
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, *(field(F.col(column), n).alias(n) for n in wanted))


def texts(v: Column) -> Column:
    """Texts of a list's items, an object's pairs, or a single value, without empty ones; of null none."""
    items = F.try_variant_get(v, "$", "array<string>")
    pairs = F.transform(F.map_entries(F.try_variant_get(v, "$", "map<string, string>")), lambda e: F.when(e["value"] != "", F.concat(e["key"], F.lit(NAMED), e["value"])))
    one = F.array(F.try_variant_get(v, "$", "string"))
    found = F.when(kind(v) == "ARRAY", items).when(kind(v) == "OBJECT", pairs).otherwise(one)
    return F.coalesce(F.filter(found, lambda t: t.isNotNull() & (t != "")), F.array().cast("array<string>"))
