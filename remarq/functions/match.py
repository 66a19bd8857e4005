"""Looking for lexicon terms in texts with one automaton over all of them.

The automaton (a trie with failure links) goes over a text once, however many terms it has, and tells the terms that occur, each once. It runs on Arrow batches; what
follows (sums, first and longest terms) only ever sees the few that occur, so it stays with Spark's expressions. A lexicon is a bounded parameter and part of the plan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bind import let
from .lexicon import Lexicon, Taxonomy

KINDS = ("positive", "negative", "stance")
#: Texts of a batch that are Python objects at once.
SLICE = 256


@lru_cache(maxsize=32)
def _automaton(terms: tuple[str, ...]) -> ahocorasick.Automaton:
    """One of each list in a worker, for all its tasks."""
    out = ahocorasick.Automaton()
    for i, t in enumerate(terms):
        out.add_word(t, i)
    out.make_automaton()
    return out


def places(text: str | None, terms: tuple[str, ...]) -> list[int]:
    """The places in ``terms`` of those that the text contains, in order."""
    return sorted({i for _, i in _automaton(terms).iter(text)}) if text and terms else []


def by_slices(texts: pa.Array, f: Callable[[str | None], object], kind: pa.DataType) -> pa.Array:
    """f of every text; no more than ``SLICE`` texts and results are Python objects at a time, whatever a batch holds."""
    parts = [pa.array([f(t) for t in texts.slice(i, SLICE).to_pylist()], kind) for i in range(0, len(texts), SLICE)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def occurring(text: Column, terms: tuple[str, ...]) -> Column:
    """The places in ``terms`` of those that the text contains, in order; null and empty texts contain none."""
    if not terms:
        return F.array().cast("array<int>")

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def found(texts: pa.Array) -> pa.Array:
        return by_slices(texts, lambda t: places(t, terms), pa.list_(pa.int32()))

    return found(text)


class Hits:
    """The terms of a list that occur in a text: ``places`` is what :func:`occurring` gives for the list."""

    def __init__(self, places: Column, terms: tuple[str, ...]):
        self.places, self.terms = places, terms
        self._at = {t: i for i, t in enumerate(terms)}

    @classmethod
    def of(cls, text: Column, terms: Iterable[str]) -> Hits:
        own = vocabulary(terms)
        return cls(occurring(F.lower(text), own), own)

    def _looked_up(self, values: dict[str, object], kind: str) -> Column:
        """For each term that occurs its value, or null."""
        by_place: list[object] = [None] * len(self.terms)
        for t, v in values.items():
            by_place[self._at[t]] = v
        table = F.array(*map(F.lit, by_place)).cast(f"array<{kind}>")
        return F.transform(self.places, lambda i: F.get(table, i))

    def total(self, weights: dict[str, int]) -> Column:
        """The sum over the terms that occur, each once."""
        return F.aggregate(self._looked_up(weights, "int"), F.lit(0), lambda s, w: s + F.coalesce(w, F.lit(0)))

    def first(self, ordered: list[str]) -> Column:
        """The place in ``ordered`` of its first term that occurs; null if none does."""
        ranks: dict[str, object] = {}
        for i, t in enumerate(ordered):
            ranks.setdefault(t, i)
        return F.array_min(self._looked_up(ranks, "int"))

    def forms(self, ordered: list[str]) -> Column:
        """Those of ``ordered`` whose small letters occur, in its order."""
        by_place: list[list[int]] = [[] for _ in self.terms]
        for i, t in enumerate(ordered):
            by_place[self._at[t.lower()]].append(i)
        table = F.array(*(F.array(*map(F.lit, x)).cast("array<int>") for x in by_place))
        names = F.array(*map(F.lit, ordered)).cast("array<string>")
        return F.transform(F.sort_array(F.flatten(F.transform(self.places, lambda i: F.get(table, i)))), lambda i: F.get(names, i))


def vocabulary(terms: Iterable[str]) -> tuple[str, ...]:
    return tuple(sorted({t.lower() for t in terms} - {""}))


def lexicon_terms(lexicon: Lexicon) -> list[str]:
    return [t for t, _ in lexicon.terms]


def label_terms(tax: Taxonomy) -> list[str]:
    return [t for kind in KINDS for terms in tax.labels[kind].values() for t in terms]


def with_hits(df: DataFrame, name: str, text: Column, terms: Iterable[str]) -> tuple[DataFrame, Hits]:
    """A column with the places of the terms that occur, for several uses of one pass."""
    found = Hits.of(text, terms)
    return df.withColumn(name, found.places), Hits(F.col(name), found.terms)


def sentiment_hundredths(text: Column, lexicon: Lexicon, hits: Hits | None = None) -> Column:
    """Summed weights of all terms that occur, each once."""
    weights: dict[str, int] = {}
    for t, w in lexicon.terms:
        weights[t.lower()] = weights.get(t.lower(), 0) + w
    return (hits or Hits.of(text, weights)).total(weights)


def _pairs(taxonomy: Taxonomy, kind: str) -> list[tuple[str, str, str]]:
    return [(term.lower(), label, term) for label, terms in taxonomy.labels[kind].items() for term in terms]


def longest_label(text: Column, taxonomy: Taxonomy, kind: str, hits: Hits | None = None) -> Column:
    """label, term, confidence of the longest term that occurs, the first of equals; else the first label without a term."""
    rows = sorted(_pairs(taxonomy, kind), key=lambda r: -len(r[0]))  # stable: taxonomy order among equals
    return _first(text, rows, taxonomy.names(kind)[0], 0.82, 0.55, hits)


def first_label(text: Column, taxonomy: Taxonomy, kind: str = "stance", hits: Hits | None = None) -> Column:
    """label, term, confidence of the first term in taxonomy order; else the last label without a term."""
    return _first(text, _pairs(taxonomy, kind), taxonomy.names(kind)[-1], 0.78, 0.45, hits)


def _first(text: Column, rows: list[tuple[str, str, str]], default: str, hit: float, miss: float, hits: Hits | None) -> Column:
    keys = [r[0] for r in rows]
    labels, terms = (F.array(*(F.lit(r[i]) for r in rows)).cast("array<string>") for i in (1, 2))

    def named(at: Column) -> Column:
        return F.struct(
            F.coalesce(F.get(labels, at), F.lit(default)).alias("label"),
            F.coalesce(F.get(terms, at), F.lit("")).alias("term"),
            F.when(at.isNotNull(), hit).otherwise(miss).alias("confidence"),
        )

    return let((hits or Hits.of(text, keys)).first(keys), named)
