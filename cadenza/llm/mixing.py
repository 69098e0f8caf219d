"""Mixing sources to target weights by a low-discrepancy schedule of equal blocks.

Each source's documents stand in a shuffled order (by the MD5 of the id) and form a stream
of words that may be passed through at most ``most`` times. The stream is cut into blocks of
``block_words`` words. The schedule has one slot per block: the points of a base-2 van der
Corput sequence run through the cumulative block counts of the sources, which names the
source of each slot, so every stretch of the schedule is close to the target weights. Slots
are ranked within their source, and rank r takes block r of the source's stream.

All of it is DataFrame expressions. Positions in streams and ranks of slots come from two
levels of sums (within short ranges, then over the ranges of a source), so no window holds
more than a range of one source, or one row per range. Documents with the same id (or none),
source and size are one row with a count there, so such an id adds a row per different size.

Nulls: a null text has no words; a null source is a source, last in order; a null id is
shuffled by the MD5 of the empty text. Repeated rows are documents of their own. An empty
table gives no rows; a source without words has the target 0. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.scratch import materialize
from .frames import copies, positional, restored

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2
BLOCK_WORDS = 4096
RANGE_DOCS = 500
RANGE_SLOTS = 4096
#: Slots whose documents stand together in a table of mixed documents.
STRETCH = 64


def word_count(text: Column) -> Column:
    """Number of runs of bytes other than 0x20 and 0x09-0x0D; null counts 0."""
    spaced = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.length(F.regexp_replace(spaced, r"[^ ]+ *", "x")).cast("long") - F.startswith(spaced, F.lit(" ")).cast("long") * (
        F.length(F.regexp_extract(spaced, r"^ +", 0))
    )


def target_sizes(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Adds ``sid, weight, target`` to a table ``source, source_size`` of one row per source.

    Sources by code point, nulls last, take the weights in turn. Together they get ``share``
    times all words; none gets more than ``most`` times its own, and what it can't take goes
    to the others by weight. Filling sources in the order of cap per weight gives the level
    at which that ends.
    """
    whole = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    level = Window.orderBy("__ratio", "sid")
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    out = sizes.withColumn("sid", F.row_number().over(by_name) - 1).withColumn("weight", pick)
    out = out.withColumn("__cap", F.col("source_size") * F.lit(float(most)))
    out = out.withColumn("__ratio", F.col("__cap") / F.col("weight"))
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    onward = level.rowsBetween(0, Window.unboundedFollowing)
    rest = F.lit(float(share)) * F.sum("source_size").over(whole) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))
    out = out.withColumn("__level", rest / F.sum("weight").over(onward))
    out = out.withColumn("__level", F.min(F.when(F.col("__level") <= F.col("__ratio"), F.struct("__ratio", "sid", "__level"))).over(whole)["__level"])
    target = F.when(F.col("__level").isNull(), F.col("__cap")).otherwise(F.least(F.col("__cap"), F.col("__level") * F.col("weight")))
    return out.withColumn("target", target).drop("__cap", "__ratio", "__level")


def schedule(counts: DataFrame, range_slots: int = RANGE_SLOTS) -> DataFrame:
    """``slot, sid, rank`` for a table ``sid, blocks``: one slot per block.

    Slots are numbered with gaps: of 2**m slots those whose van der Corput point lies above
    the last source's share stay empty.
    """
    ordered = Window.orderBy("sid")
    placed = counts.where("blocks > 0").withColumn("first", F.sum("blocks").over(ordered) - F.col("blocks"))
    placed = placed.withColumn("bits", F.greatest(F.length(F.bin(F.sum("blocks").over(Window.partitionBy()) - 1)), F.lit(1)))
    last = F.col("first") + F.col("blocks") - 1
    runs = placed.select("sid", "bits", last.alias("last"), F.explode(F.sequence("first", last, F.lit(range_slots).cast("long"))).alias("run"))
    points = runs.repartition("sid", "run").select(
        "sid", "bits", F.explode(F.sequence("run", F.least(F.col("run") + range_slots - 1, "last"))).alias("point")
    )
    slot = F.conv(F.reverse(F.lpad(F.bin("point"), F.col("bits"), F.lit("0"))), 2, 10).cast("long")
    slots = points.select("sid", slot.alias("slot")).withColumn("range", F.floor(F.col("slot") / range_slots))
    sums = slots.groupBy("sid", "range").agg(F.count("*").alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("sid").orderBy("range")) - F.col("n")
    sums = sums.select("sid", "range", ahead.alias("ahead"))
    inner = F.row_number().over(Window.partitionBy("sid", "range").orderBy("slot")) - 1
    return slots.withColumn("inner", inner).join(sums, ["sid", "range"]).select("slot", "sid", (F.col("ahead") + F.col("inner")).alias("rank"))


@dataclass(frozen=True)
class Mix:
    """documents: one row per document with its place in its source's stream, size, source_size,
    target, limit (words of the stream to take). slots: slot, sid, rank. pieces: sid, block,
    start, pass, words: which part of which document stands in which block."""

    documents: DataFrame
    slots: DataFrame
    pieces: DataFrame

    def taken(self) -> DataFrame:
        """documents with what the scheduled blocks hold of them: ``taken`` (words, repeats
        counted), ``first_slot`` and ``last_slot`` (null where nothing is taken)."""
        used = self.pieces.join(self.slots, (self.pieces["sid"] == self.slots["sid"]) & (self.pieces["block"] == self.slots["rank"]))
        used = used.groupBy(self.pieces["sid"], "start").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"))
        key = F.when(F.col("size") > 0, F.col("start"))
        out = self.documents.withColumn("__start", key).join(
            used.select(F.col("sid").alias("__sid"), F.col("start").alias("__used"), "taken", "first_slot", "last_slot"),
            (F.col("sid") == F.col("__sid")) & (F.col("__start") == F.col("__used")),
            "left",
        )
        return out.withColumn("taken", F.coalesce("taken", F.lit(0).cast("long"))).drop("__start", "__sid", "__used")


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    block_words: int = BLOCK_WORDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> Mix:
    """Schedule the documents' words by source; see the module."""
    sized = materialize(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")), "sized"
    )
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    targets = target_sizes(per_source, weights, share, most)
    limit = F.least(F.round("target").cast("long"), F.col("source_size") * most)
    targets = materialize(targets.withColumn("limit", limit), "targets")
    bits = max(0, (int(targets.agg(F.coalesce(F.max("n_docs"), F.lit(0))).first()[0]) // RANGE_DOCS).bit_length())
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    place = F.shiftright(F.conv(F.substring("order", 1, 8), 16, 10).cast("long"), 32 - bits) if bits else F.lit(0).cast("long")
    rows = sized.join(targets.drop("n_docs", "weight"), sized["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    # documents that share id, source and size take each other's places: they are one row with a
    # count, so an id that many documents share (or lack) has a row per size in its range
    rows = rows.groupBy(*rows.columns).agg(F.count("*").alias("equal")).withColumn("order", order).withColumn("range", place)
    words = F.col("size") * F.col("equal")
    sums = rows.groupBy("sid", "range").agg(F.sum(words).alias("n"))
    sums = sums.select("sid", "range", (F.sum("n").over(Window.partitionBy("sid").orderBy("range")) - F.col("n")).alias("ahead"))
    inner = Window.partitionBy("sid", "range").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("inner", F.sum(words).over(inner) - words).join(sums, ["sid", "range"])
    placed = placed.withColumn("first", F.col("ahead") + F.col("inner")).drop("ahead", "inner", "order", "range")
    placed = copies(placed, "equal", "copy", ["sid", "doc_id", "size"]).withColumn("start", F.col("first") + F.col("copy") * F.col("size"))
    placed = materialize(placed.drop("first", "copy"), "placed")

    low = F.col("pass") * F.col("source_size") + F.col("start")
    parts = placed.where("size > 0").withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(most - 1).cast("long"))))
    parts = parts.select("sid", "start", "pass", low.alias("low"), F.least(low + F.col("size"), "limit").alias("high")).where("low < high")
    block = F.floor(F.col("low") / block_words), F.floor((F.col("high") - 1) / block_words)
    parts = parts.withColumn("block", F.explode(F.sequence(*block)))
    words = F.least("high", (F.col("block") + 1) * block_words) - F.greatest("low", F.col("block") * block_words)
    pieces = parts.select("sid", "block", "start", "pass", words.alias("words"))
    blocks = targets.select("sid", F.ceil(F.col("limit") / block_words).alias("blocks"))
    return Mix(placed, schedule(blocks), pieces)


def mixed_documents(docs: DataFrame, mix: Mix, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the mix takes, once for each pass that reaches their first word.

    Rows stand in the order of their slots within each stretch of ``STRETCH`` slots, so any
    part of a written table is close to the target weights. A document is taken whole: what a
    target cuts off at the end of a source's stream belongs to a document that is in, too.
    Documents without words are in no block and go. Columns are those of ``docs``. Where ids
    repeat, rows are told apart by source, size and text.
    """
    parts = mix.documents.where("size > 0").withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil((F.col("limit") - F.col("start")) / F.col("source_size")) - 1)))
    parts = parts.where("pass * source_size + start < limit")
    head = mix.pieces.groupBy("sid", "start", "pass").agg(F.min("block").alias("block"))
    slot = head.join(mix.slots, (head["sid"] == mix.slots["sid"]) & (head["block"] == mix.slots["rank"])).select(
        head["sid"].alias("__sid"), F.col("start").alias("__start"), F.col("pass").alias("__pass"), "slot"
    )
    chosen = parts.join(slot, (F.col("sid") == F.col("__sid")) & (F.col("start") == F.col("__start")) & (F.col("pass") == F.col("__pass")))
    chosen = materialize(
        chosen.groupBy(F.col("doc_id").alias("id"), F.col("source").alias("its_source"), F.col("size").alias("its_size"), F.col("start").alias("its_start")).agg(
            F.array_sort(F.collect_list("slot")).alias("its_slots")
        ),
        "chosen",
    )
    rows, names = positional(docs)
    own, origin, text = (F.col(names[c]) for c in (id_col, source_col, text_col))
    rows = rows.where(word_count(text) > 0)
    match = own.eqNullSafe(F.col("id"))
    if not chosen.groupBy("id").count().where("count > 1").isEmpty():
        chosen = chosen.withColumn("nth", F.row_number().over(Window.partitionBy("id", "its_source", "its_size").orderBy("its_start")))
        same = Window.partitionBy(own, origin, "words").orderBy(F.xxhash64(text))
        rows = rows.withColumn("words", word_count(text)).withColumn("row", F.row_number().over(same))
        match &= origin.eqNullSafe(F.col("its_source")) & (F.col("words") == F.col("its_size")) & (F.col("row") == F.col("nth"))
    copies = rows.join(chosen.hint("merge"), match).withColumn("slot", F.explode("its_slots"))
    copies = copies.repartition(F.floor(F.col("slot") / STRETCH)).sortWithinPartitions("slot")
    return restored(copies, names)
