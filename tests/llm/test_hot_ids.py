"""A third of the rows without an id, and a third under one id."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from cadenza.llm import covers, exact, langid, mixing, packing
from cadenza.llm.registry import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string"
N = 30_000


@pytest.fixture(scope="module")
def hot(spark):
    """Different texts, each also under an id of its own, and equal ones."""
    k = F.col("id")
    doc = F.when(k % 3 == 0, None).when(k % 3 == 1, -7).otherwise(k)
    text = F.when(k % 30 < 3, "the same text").otherwise(F.concat(F.lit("word"), (k / 3).cast("long").cast("string"), F.lit(" and some more")))
    return spark.range(0, N, 1, 8).select(doc.alias("doc_id"), text.alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))


def test_byte_check_reads_no_more_rows_than_the_table_has(spark, hot):
    rows = exact.fingerprinted(hot).withColumn("new", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(2)) == 1)
    old, new = (exact.grouped(rows.where(side).select("doc_id", "digest")) for side in ("not new", "new"))
    both = exact.grouped(rows.select("doc_id", "digest"))
    wanted = both.select("digest", F.col("keep_id").alias("new_id"), F.col("keep_id").alias("old_id"))
    found = exact.confirmed(hot, wanted)
    assert found.count() == both.count()
    texts = hot.select("doc_id", exact.normalized(F.col("text")).alias("norm"))
    read = texts.withColumn("own", F.unhex(F.sha2(F.col("norm").cast("binary"), 256))).join(both, (F.col("own") == F.col("digest")) & texts["doc_id"].eqNullSafe(both["keep_id"]))
    assert read.count() <= N
    assert old.count() and new.count()


def test_exact_duplicates(spark, hot):
    got = exact.exact_duplicates(hot).agg(F.count("*"), F.max("group_size"), F.count_distinct("digest")).first()
    groups = Counter(r["text"] for r in hot.select("text").collect())
    assert tuple(got) == (N, max(groups.values()), len(groups))


def test_learning_keeps_its_bound(spark, hot):
    sizes = hot.groupBy("lang").count().first()["count"]
    bound = int(min(1.0, 200 / sizes) * (1 << 20))
    rows = hot.where(F.pmod(F.xxhash64(F.col("doc_id"), F.col("text")), F.lit(1 << 20)) < bound).groupBy("doc_id", "text").count()
    assert 100 < rows.count() < 400
    model = langid.learn(hot, docs_a_lang=200)
    assert model.langs == ["en"]


def test_mixing_windows_are_short(spark, hot):
    mix = mixing.mix_sources(hot)
    got = mix.documents.groupBy("start").agg(F.sum(F.when(F.col("size") > 0, 1).otherwise(0)).alias("n")).agg(F.max("n")).first()[0]
    assert got == 1 and mix.documents.count() == N
    rows = mix.documents.groupBy("doc_id", "size").count()
    assert rows.where("doc_id is null or doc_id = -7").count() < 10  # what the ids add to their ranges


def test_packing_parts_are_short(spark, hot):
    pieces = packing.tokenized_pieces(hot, tokenizer_path())
    rows = pieces.groupBy("doc_id", "piece", "start", "length", "ids_crc32").count()
    parts = max(64, N // packing.PART_PIECES)
    part = rows.groupBy("length", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts))).agg(F.count("*").alias("n"))
    assert part.agg(F.max("n")).first()[0] < 3 * rows.count() / parts
    got = packing.packed(hot, tokenizer_path()).agg(F.count("*"), F.count_distinct("sequence_id", "offset"), F.sum("length")).first()
    assert got[0] == got[1] == N
    assert got[2] == pieces.agg(F.sum("length")).first()[0]


def test_substrings_without_ids_meet_no_bucket(spark, hot):
    long = hot.withColumn("text", F.concat_ws(" ", *["text"] * 5)).where("doc_id is null or doc_id > 0")
    got = covers.without_repeats(long).groupBy(F.col("doc_id").isNull().alias("none")).agg(F.count("*").alias("n"), F.sum("n_removed").alias("gone")).collect()
    found = {r["none"]: (r["n"], r["gone"]) for r in got}
    assert found[True] == (N // 3, 0) and found[False][0] == N // 3 and found[False][1] > 0
    # no row without an id is dealt to a bucket
    alone = covers.without_repeats(long.where("doc_id is null"))._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in alone
