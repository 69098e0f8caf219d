"""Audit of the sources of each language: how far their term distributions lie apart.

Terms are taken from whole texts and counted per (language, source). A language keeps the
terms that stand in enough of its documents; the groups of a language meet its vocabulary, so
that a term a group never uses counts as zero there; a self-join on language and term brings
the sources of a language together, term by term. Terms that set a source apart from its
language, and its distances to the other sources, are ranked per source.

Tasks read texts in Arrow batches and count the terms of each row, all and different ones, so
no shuffle by document is needed and only counts move; a task holds a bounded number of them.
Groups meet their vocabulary on (language, share of the vocabulary), so a language that holds most
rows doesn't fall into one task, and totals of groups travel with that join instead of
meeting every term again. A ranking of terms keeps its first rows in each task before they
move. Distances are summed for one order of two sources and read both ways.

Probabilities are integers in billionths, with products in decimals of 38 digits: counts may
pass 2**33. All results are exact.

Nulls: a null text, language or source is the empty string. Texts without terms still give
their group, with uniform probabilities, and a language without vocabulary distances of zero.
Ties: terms and sources of equal value stand in the order of their UTF-8 bytes. Repeated rows
count once each. An empty table gives no rows. A long text is handled by one task, which holds
its terms in one array. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.scratch import discard, materialize

#: Bytes of UTF-8 text: capitals of ASCII to small letters, what else of ASCII isn't a letter to
#: a space. All bytes of other characters are above ASCII and stay, so terms stand between spaces.
_BYTES = bytes(k if k > 127 or chr(k).isalpha() else 32 for k in range(256)).lower()
#: Terms of groups that a task counts before it gives the counts out.
HELD_TERMS = 200_000
LEAST_DOCS = 30
TOP_TERMS = 50
SCALE = 1_000_000_000
SMOOTHING = 5
#: Parts of each language's vocabulary, which its groups meet one by one.
SHARES = 256


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs`` of each group; the term is null for texts without any.

    ``n`` counts occurrences, ``docs`` the rows that hold the term.
    """
    blank = F.lit("")
    rows = docs.select(F.coalesce("lang", blank).alias("lang"), F.coalesce("source", blank).alias("source"), F.coalesce("text", blank).cast("binary").alias("text"))
    counts = rows.mapInArrow(_counts, "lang string, source string, term binary, n long, docs long")
    return counts.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the terms of a task's texts, given out whenever ``HELD_TERMS`` are held."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def given() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            names = [pa.repeat(pa.scalar(x, pa.string()), len(n)) for x in (lang, source)]
            numbers = [pa.array(x, pa.int64()) for x in (n.values(), [docs[t] for t in n])]
            yield pa.RecordBatch.from_arrays([*names, pa.array(n, pa.binary()), *numbers], ["lang", "source", "term", "n", "docs"])
        held.clear()

    size = 0
    for batch in batches:
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text"), strict=True):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            before = len(n)
            terms = text.as_py().translate(_BYTES).split()
            n.update(terms or [None])
            docs.update(set(terms))
            size += len(n) - before
            if size > HELD_TERMS:
                yield from given()
                size = 0
    yield from given()


def _probability(n: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(SCALE * (n + SMOOTHING) / (total + SMOOTHING * terms))``, exactly."""
    above = (n + F.lit(SMOOTHING)).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    below = (total + F.lit(SMOOTHING) * terms).cast("decimal(20,0)")
    # the remainder goes first, so that the quotient is whole and no rounding applies
    return F.lit(1) + ((above - above % below) / below).cast("decimal(20,0)").cast("long")


def probabilities(counts: DataFrame, least_docs: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame]:
    """Groups, and the probabilities of their languages' kept terms.

    Gives ``lang, source`` of every group, and ``lang, source, term, n, p, q``: ``p`` of the
    group and ``q`` of its language, zeros included. The second table is written.
    """
    kept = counts.where(F.col("term").isNotNull()).groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("docs"))
    kept = materialize(kept.where(F.col("docs") >= least_docs).select("lang", "term", "all_n"), "vocabulary")
    own = materialize(counts.join(kept.select("lang", "term"), ["lang", "term"]).select("lang", "source", "term", "n"), "kept-counts")
    groups = counts.select("lang", "source").distinct()
    langs = kept.groupBy("lang").agg(F.sum("all_n").alias("all_total"), F.count("*").alias("terms"))
    totals = own.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = materialize(groups.join(langs, "lang", "left").join(totals, ["lang", "source"], "left"), "groups")
    share = F.pmod(F.xxhash64("term"), F.lit(SHARES))
    wide = groups.where(F.col("terms").isNotNull()).withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SHARES - 1).cast("long"))))
    dense = kept.withColumn("share", share).join(wide, ["lang", "share"])
    dense = dense.join(own, ["lang", "source", "term"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    p = _probability(F.col("n"), F.coalesce("total", F.lit(0)), F.col("terms"))
    q = _probability(F.col("all_n"), F.col("all_total"), F.col("terms"))
    dense = materialize(dense.select("lang", "source", "term", "n", p.alias("p"), q.alias("q")), "probabilities")
    discard(kept, own)
    return groups.select("lang", "source"), dense


def source_divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank`` of every (language, source) group.

    Part ``pair``: each other source of the language and the summed distance to it. Part
    ``term``: the ``top`` terms more probable in the group than in its language, and by how much.
    """
    counts = materialize(term_counts(docs), "term-counts")
    groups, dense = probabilities(counts, least_docs)
    discard(counts)
    a, b = (dense.select("lang", "term", F.col("source").alias(name), F.col("p").alias(f"p_{name}")) for name in ("source", "item"))
    apart = a.join(b, ["lang", "term"]).where(F.col("source") < F.col("item"))
    apart = apart.groupBy("lang", "source", "item").agg(F.sum(F.abs(F.col("p_source") - F.col("p_item"))).alias("value"))
    # languages without vocabulary have pairs too
    pairs = groups.join(groups.withColumnRenamed("source", "item"), "lang").where(F.col("source") < F.col("item"))
    pairs = pairs.join(apart, ["lang", "source", "item"], "left").withColumn("value", F.coalesce("value", F.lit(0)))
    both = F.explode(F.array(F.struct(F.col("source").alias("a"), F.col("item").alias("b")), F.struct(F.col("item").alias("a"), F.col("source").alias("b"))))
    pairs = pairs.select("lang", both.alias("x"), "value").select("lang", F.col("x.a").alias("source"), F.lit("pair").alias("part"), F.col("x.b").alias("item"), "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    terms = dense.where((F.col("n") > 0) & (F.col("p") > F.col("q")))
    terms = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.unionByName(terms)
