import itertools
import math
import random
import re

import numpy as np
import pytest
import xxhash

from cadenza.llm import langid, resampling, words as hashing

FR = "le la les des une dans est que pour avec sur pas plus cette tout nous vous être avoir français été déjà élève où".split()
EN = "the this that with from which there would their about other into could people first after water where most".split()
RU = "что это как его она они только когда даже после через было".split()


def text(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(3)
    rows = [(k, text(rng, w, 30), lang) for k in range(60) for lang, w in [[("en", EN), ("fr", FR), ("ru", RU)][k % 3]]]
    return spark.createDataFrame([*rows, (900, None, "en"), (901, "abc def", None)], "doc_id long, text string, lang string")


def test_languages_and_spans(spark, labelled):
    rng = random.Random(9)
    model = langid.learn(labelled)
    assert model.langs == ["en", "fr", "ru"]
    mixed = text(rng, EN, 20) + " " + text(rng, FR, 40)
    rows = [(0, text(rng, FR, 20), "x"), (1, text(rng, RU, 5), "x"), (2, None, "en"), (3, "123 !!", "en"), (4, "", None), (5, mixed, "en"), (5, mixed, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumnRenamed("lang", "lang_pred")
    got = {r["doc_id"]: r for r in langid.identify(df, model).collect()}
    assert [got[k]["lang_pred"] for k in range(6)] == ["fr", "ru", "und", "und", "und", "fr"]
    assert [got[k]["score"] for k in (2, 3, 4)] == [0, 0, 0] and got[0]["score"] == 1
    spans = [(s["lang"], mixed[s["start"] : s["end"]]) for s in got[5]["spans"]]
    assert [s[0] for s in spans] == ["en", "fr"] and 0.5 < got[5]["score"] < 1
    kept = langid.keep_identified(df, model, lang_col="lang_pred")
    assert kept.columns == df.columns and sorted((r["doc_id"], r["lang_pred"]) for r in kept.collect()) == [(0, "fr"), (1, "ru"), (5, "fr"), (5, "fr")]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.learn(docs.where(~langid.held_out(docs["doc_id"])))
    found = langid.identify(docs, model).join(docs.where(langid.held_out(docs["doc_id"])), "doc_id").select("lang", "lang_pred").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in found]) > 0.97


def test_without_rows(spark, none):
    model = langid.learn(none)
    assert langid.identify(none, model).count() == 0
    one = spark.createDataFrame([(1, "hello")], "doc_id long, text string")
    assert [tuple(r)[1:3] for r in langid.identify(one, model).collect()] == [("und", 0.0)]


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(4)
    for n, k in ((1, 3), (5, 2), (7, 3)):
        s = rng.normal(size=(n, k))
        w = np.where(rng.random(n) < 0.2, 0.0, 0.7)
        best = max(itertools.product(range(k), repeat=n), key=lambda p: sum(s[i, p[i]] for i in range(n)) - sum(w[i] for i in range(1, n) if p[i] != p[i - 1]))
        assert langid.viterbi(s, w, chunk=3).tolist() == list(best)


def test_resampling(spark):
    rng = random.Random(5)
    good, junk = EN, ["buy!!", "$$$", "click", "CLICK", "now***", "free"]
    rows = [(k, text(rng, good if k % 2 else junk, 40)) for k in range(300)] + [(300, None), (301, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(0, 60)] + [(301, None, 0)], "doc_id long, quality int, toxic int")
    out = resampling.resample(docs, labels).collect()
    assert len(out) == 302 and sum(r["kept"] for r in out) == 151
    assert np.mean([r["kept"] for r in out if r["doc_id"] < 300 and r["doc_id"] % 2]) > 0.95
    assert {r["doc_id"]: r["weight"] for r in out}[300] == 0
    again = resampling.resample(docs, labels).collect()
    assert sorted((r["doc_id"], r["kept"]) for r in out) == sorted((r["doc_id"], r["kept"]) for r in again)


def test_top_against_sorting(spark):
    rng = random.Random(6)
    keys = [(k, rng.choice([rng.gauss(0, 1), 0.5, 1e9])) for k in range(500)]
    df = spark.createDataFrame(keys, "doc_id long, key double")
    for k in (0, 1, 7, 250, 499, 500, 900):
        want = {d for d, _ in sorted(keys, key=lambda r: (-r[1], r[0]))[:k]}
        assert {r["doc_id"] for r in resampling.top(df, k, bins=8).collect() if r["kept"]} == want


def test_resampling_without_rows_or_labels(spark, none, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert resampling.resample(none, labels).count() == 0
    out = resampling.resample(docs.select("doc_id", "text"), labels, share=0.5).collect()
    assert all(r["weight"] == 0 for r in out)


def test_top_of_null_ids_and_repeated_rows(spark):
    rows = [(None, 1.0)] * 40 + [(3, 1.0)] * 5 + [(1, 1.0), (2, 2.0), (None, 0.5)]
    df = spark.createDataFrame(rows, "doc_id long, key double").repartition(5)
    for k in (1, 3, 6, 7, 20, 46, 47, 48):
        got = [r["doc_id"] for r in resampling.top(df, k, bins=4).collect() if r["kept"]]
        order = sorted(rows, key=lambda r: (-r[1], r[0] is None, r[0] or 0))
        assert sorted(got, key=repr) == sorted((r[0] for r in order[:k]), key=repr)


def bag(t, bins):
    """Bins of the words and pairs of words of a text, one by one."""
    mask, seed = (1 << 64) - 1, hashing._FAMILIES[0][0]

    def mix(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
        return x ^ (x >> 31)

    data = bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode())
    h = [xxhash.xxh64_intdigest(w, seed) for w in re.findall(rb"[^\x20\x09-\x0D]+", data)]
    return [x % bins for x in h] + [mix((a * 0x9E3779B97F4A7C15 + b) & mask) % bins for a, b in zip(h, h[1:])]


def test_weights_against_brute_force(spark, corpus, docs):
    """Every weight, key and decision, recounted in plain Python."""
    bins, seed = 256, 7
    quality = {r[0]: k % 2 for k, r in enumerate(corpus) if k % 3}
    labels = spark.createDataFrame([(k, q, 0) for k, q in quality.items()] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    raw, goal = [1.0] * bins, [1.0] * bins
    for r in corpus:
        for x in bag(r[1], bins):
            raw[x] += 1
            goal[x] += quality.get(r[0]) == 1
    ratio = [math.log(g / sum(goal)) - math.log(w / sum(raw)) for g, w in zip(goal, raw)]
    got = resampling.resample(docs, labels, share=0.4, seed=seed, bins=bins).collect()
    assert len(got) == len(corpus)
    want, keys = {r[0]: bag(r[1], bins) for r in corpus}, {}
    for r in got:
        found = want[r["doc_id"]]
        assert r["n_features"] == len(found) and r["weight"] == pytest.approx(sum(ratio[x] for x in found), abs=1e-6)
        noise = hashing.mixed(np.array([r["doc_id"]], np.uint64) ^ hashing.mixed(np.array([seed], np.uint64)))[0]
        uniform = (float(int(noise) >> 11) + 0.5) * 2.0**-53
        assert r["key"] == pytest.approx(r["weight"] - math.log(-math.log(uniform)))
        keys.setdefault(r["doc_id"], []).append((r["key"], r["kept"]))
    n = round(0.4 * len(corpus))
    order = sorted((-k, d) for d, ks in keys.items() for k, _ in ks)[:n]
    assert sorted(d for _, d in order) == sorted(d for d, ks in keys.items() for _, kept in ks if kept)


def test_labels_against_a_loop(spark, corpus):
    """Languages, scores and spans of whole texts by a plain Viterbi pass, word by word."""
    rng = random.Random(8)
    parts = [(w, lang) for lang, w in (("en", EN), ("fr", FR), ("ru", RU))]
    labelled = spark.createDataFrame([(k, text(rng, parts[k % 3][0], 30), parts[k % 3][1]) for k in range(60)], "doc_id long, text string, lang string")
    model = langid.learn(labelled)
    texts = [r[1] or "" for r in corpus] + [" ".join(text(rng, rng.choice(parts)[0], rng.randint(1, 15)) for _ in range(6)) for _ in range(20)] + ["日本 word слово"]
    got = langid.label(texts, model)
    for t, (lang, score, spans) in zip(texts, got, strict=True):
        w = langid.letters([t])
        if not len(w.first):
            assert (lang, score, spans) == ("und", 0.0, [])
            continue
        ends, best, back = [*w.first[1:].tolist(), len(w.bucket)], None, []
        for i, lo in enumerate(w.first.tolist()):
            own = model.logp[w.bucket[lo : ends[i]]].sum(axis=0, dtype=np.float64)
            allowed = model.scripts[w.script[i]]
            if allowed.any():
                own = own - np.where(allowed, 0.0, langid.FOREIGN)
            if best is None:
                best = own
            else:
                jump = best.max() - langid.SWITCH
                back.append([(int(best.argmax()) if jump > b else k) for k, b in enumerate(best)])
                best = np.maximum(best, jump) + own
        path = [int(best.argmax())]
        for step in reversed(back):
            path.append(step[path[-1]])
        path.reverse()
        sizes = [0] * len(model.langs)
        for i, k in enumerate(path):
            sizes[k] += ends[i] - int(w.first[i])
        top = max(range(len(sizes)), key=lambda k: (sizes[k], -k))
        assert lang == model.langs[top] and score == pytest.approx(sizes[top] / sum(sizes))
        runs = [(k, [i for i, _ in g]) for k, g in itertools.groupby(enumerate(path), key=lambda x: x[1])]
        assert [(s["lang"], s["start"], s["end"]) for s in spans] == [(model.langs[k], int(w.begin[i[0]]), int(w.end[i[-1]])) for k, i in runs]
