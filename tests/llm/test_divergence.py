import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import functions as F

from cadenza.llm import divergence

LETTERS = re.compile(r"[A-Za-z\u0080-\U0010ffff]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(rows, least, top):
    n, docs, groups = Counter(), Counter(), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = LETTERS.findall(lowered(text or ""))
        n.update((lang, source, t) for t in found)
        docs.update((lang, t) for t in set(found))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (l, t), k in docs.items() if l == lang and k >= least)
        sources = sorted({s for l, s in groups if l == lang}, key=str.encode)
        own = {s: {t: n[lang, s, t] for t in kept} for s in sources}
        whole = {t: sum(own[s][t] for s in sources) for t in kept}

        def p(counts):
            below = sum(counts.values()) + 5 * len(kept)
            return {t: 1 + 10**9 * (k + 5) // below for t, k in counts.items()}

        chance, q = {s: p(own[s]) for s in sources}, p(whole)
        for s in sources:
            pairs = [(-sum(abs(chance[s][t] - chance[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            terms = [(-(chance[s][t] - q[t]), t.encode(), t) for t in kept if own[s][t] and chance[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, item, -value, k + 1) for k, (value, _, item) in enumerate(found)}
    return out


def check(spark, rows, least, top, partitions=3):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lang string, source string, term string, n int").repartition(partitions)
    got = [tuple(r) for r in divergence.source_divergence(docs, least, top).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute(rows, least, top)
    return got


def test_against_counting(spark, corpus):
    rows = [r[:4] for r in corpus]
    got = check(spark, rows, 3, 7)
    assert {r[2] for r in got} == {"pair", "term"}


def test_hot_source_ties_and_null_ids(spark):
    rng = random.Random(3)
    words = ["Ab", "cd", "É", "日本", "ef", "gh", "x1y", "a'b", "\x7f", "ab-CD", "ñ"]
    rows = [(None if k % 3 == 0 else 7, " ".join(rng.choices(words, k=rng.randint(0, 9))), "en" if k % 4 else None, "hot" if k % 3 else f"s{k % 5}") for k in range(400)]
    check(spark, rows, 30, 4, 8)


def test_no_vocabulary_empty_texts_and_empty_table(spark):
    rows = [(1, None, "en", "a"), (2, "", "en", "b"), (3, "once", "en", None), (4, " 12 ", None, None)]
    got = check(spark, rows, 2, 5)
    assert {r[4] for r in got} == {0} and len(got) == 6
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert divergence.source_divergence(none).count() == 0


def test_a_text_of_megabytes(spark):
    rows = [(1, "alpha beta " * 400_000, "en", "a"), (2, "beta gamma", "en", "b"), (3, "beta", "en", "b")]
    check(spark, rows, 1, 5)


def test_counts_beyond_the_long_range_of_products(spark):
    big = [(5 * 10**11 + 3, 9 * 10**12 + 1, 10**6), (0, 9 * 10**12, 10**9), (17, 17, 1)]
    rows = spark.createDataFrame(big, "n long, total long, terms long")
    got = [r[0] for r in rows.select(divergence._probability(F.col("n"), F.col("total"), F.col("terms"))).collect()]
    assert got == [1 + 10**9 * (n + 5) // (total + 5 * terms) for n, total, terms in big]


def test_rows_of_a_source_ranked_in_tasks_first(spark):
    """The window over a source's terms gets no more than the top of each task."""
    docs = spark.createDataFrame([(k, "a b c", "en", "s") for k in range(50)], "doc_id long, text string, lang string, source string")
    plan = divergence.source_divergence(docs)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_terms_are_counted_inside_tasks(spark, monkeypatch):
    """A task moves a row per group and term, not more, and gives counts out when it holds many."""
    rows = [(lang, source, f"aB ab É{k % 3} 日本 é".encode()) for k in range(500) for lang, source in (("en", "a"), ("fr", ""))] + [("en", "a", b" 12 ")] * 3
    batch = pa.RecordBatch.from_pylist([dict(zip(("lang", "source", "text"), r, strict=True)) for r in rows])
    want = {(lang, source, t.encode()): (500 * n, 500) for lang, source in (("en", "a"), ("fr", "")) for t, n in (("ab", 2), ("É", 1), ("日本", 1), ("é", 1))} | {("en", "a", None): (3, 0)}
    got = [tuple(r.values()) for b in divergence._counts(iter([batch])) for r in b.to_pylist()]
    assert len(got) == len(want) and {r[:3]: r[3:] for r in got} == want
    monkeypatch.setattr(divergence, "HELD_TERMS", 3)
    sums = defaultdict(lambda: (0, 0))
    for b in divergence._counts(iter([batch, batch.slice(0, 0)])):
        assert b.num_rows <= 7
        for *key, n, docs in (r.values() for r in b.to_pylist()):
            sums[tuple(key)] = sums[tuple(key)][0] + n, sums[tuple(key)][1] + docs
    assert sums == want
    docs = spark.createDataFrame([(1, "x", "en", "a")], "doc_id long, text string, lang string, source string")
    plan = divergence.term_counts(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "sort_array" not in plan
