import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from cadenza.llm import covers, repeats, suffixes
from cadenza.llm import words as hashing
from pyspark.sql import functions as F


def words(t):
    return re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())


def test_covers_against_brute_force(docs, corpus):
    where = defaultdict(set)
    for r in corpus:
        w = words(r[1])
        for i in range(len(w) - 12):
            where[tuple(w[i : i + 13])].add(r[0])
    want = []
    for r in corpus:
        w, gone = words(r[1]), set()
        for i in range(len(w) - 12):
            if min(where[tuple(w[i : i + 13])]) < r[0]:
                gone.update(range(i, i + 13))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((r[0], len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    found = covers.without_repeats(docs, with_text=True).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"], r["kept_text"]) for r in found) == sorted(want)
    assert all(sum(s["end"] - s["start"] for s in r["removed"]) == r["n_removed"] for r in found)
    assert any(r["n_removed"] for r in found)


def test_covers_of_odd_tables(spark, none):
    assert covers.without_repeats(none).count() == 0
    text = " ".join(f"w{k}" for k in range(20))
    df = spark.createDataFrame([(None, text), (1, text), (1, text), (2, text)], "doc_id long, text string")
    assert sorted(((r["doc_id"], r["n_removed"]) for r in covers.without_repeats(df).collect()), key=repr) == sorted([(None, 0), (1, 0), (1, 0), (2, 20)], key=repr)
    with pytest.raises(ValueError):
        covers.check_cover((0, 1), 7)


def test_suffixes_against_brute_force(docs, corpus):
    where = defaultdict(set)
    rows = {r[0]: words(r[1]) for r in corpus}
    for k, w in rows.items():
        for i in range(len(w) - 49):
            where[tuple(w[i : i + 50])].add(k)
    want = {(k, j) for k, w in rows.items() for i in range(len(w) - 49) if len(where[tuple(w[i : i + 50])]) > 1 for j in range(i, i + 50)}
    found = suffixes.repeated_passages(docs).collect()
    assert {(r["doc_id"], j) for r in found for j in range(r["start_word"], r["end_word"])} == want
    assert want and all(r["n_words"] >= 50 and r["other_doc_id"] != r["doc_id"] for r in found)


def _hidden_passages():
    rng = random.Random(5)
    word = lambda n: [f"{rng.choice('abcdefgh')}{rng.randint(0, 10**6)}" for _ in range(n)]
    block, passage = word(60), word(90)
    rows = [block * 200, word(20) + block + word(20)]
    for _ in range(60):
        lo, hi = rng.randint(0, 60), rng.randint(30, 90)
        rows.append(word(rng.randint(0, 60)) + passage[lo : max(hi, lo + 12)] + word(rng.randint(0, 60)))
    return [(k, " ".join(w)) for k, w in enumerate(rows)]


def test_suffixes_find_passages_among_many_holders(spark):
    """A text that one document repeats 200 times, and a passage that many hold in part."""
    rows = _hidden_passages()
    where = defaultdict(set)
    split = {k: t.split() for k, t in rows}
    for k, w in split.items():
        for i in range(len(w) - 49):
            where[tuple(w[i : i + 50])].add(k)
    want, others = set(), {}
    for k, w in split.items():
        for i in range(len(w) - 49):
            if len(s := where[tuple(w[i : i + 50])] - {k}):
                for j in range(i, i + 50):
                    want.add((k, j))
                    others[k, j] = min(others.get((k, j), 10**9), *s)
    found = suffixes.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], j) for r in found for j in range(r["start_word"], r["end_word"])} == want
    assert len({w for k, w in want if k == 0}) > 11_000
    for r in found:
        assert r["other_doc_id"] == min(others[r["doc_id"], j] for j in range(r["start_word"], r["end_word"]))


def test_suffixes_of_odd_tables(spark, none):
    assert suffixes.repeated_passages(none).count() == 0
    text = " ".join(f"w{k}" for k in range(60))
    df = spark.createDataFrame([(None, text), (1, text), (1, text)], "doc_id long, text string")
    assert suffixes.repeated_passages(df).count() == 0


def test_minimisers_against_a_loop():
    rng = np.random.default_rng(0)
    doc = np.sort(rng.integers(0, 6, 200))
    h = rng.integers(1, 1 << 60, 200).astype(np.uint64)
    want = set()
    for i in range(200 - 9):
        if doc[i] == doc[i + 9]:
            want.add(i + int(np.argmin(h[i : i + 10])))
    assert set(suffixes.minimisers(h, doc, 10).tolist()) == want


def test_bucket_of_documents(spark):
    ids = [0, 1, -5, 2**40, 123456789]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "i long").select(repeats.doc_bucket(F.col("i"), 97)).collect()]
    assert got == repeats.doc_buckets(np.array(ids), 97).tolist()


def thue_morse(n):
    return np.array([bin(k).count("1") % 2 for k in range(n)])


@pytest.mark.parametrize("n", [1024, 2048])
def test_hashes_tell_thue_morse_words_apart(n):
    """Polynomials modulo 2**64 take a Thue-Morse word and its complement for the same."""
    bits = thue_morse(n)
    word = (97 + bits).astype(np.uint8)
    both = hashing.Texts(np.concatenate([word, (98 - bits).astype(np.uint8)]), np.array([0, n, 2 * n]))
    for family in (0, 1):
        one, two = both.hashes(np.array([0, n]), np.array([n, 2 * n]), family)
        assert one != two
        letters = np.array([123456789, 987654321], np.uint64)
        assert hashing.windows(letters[bits], n, family)[0] != hashing.windows(letters[1 - bits], n, family)[0]


def test_windows_against_big_integers():
    rng = np.random.default_rng(3)
    h = rng.integers(0, 1 << 63, 70_000).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    h[:3] = [hashing.PRIME, hashing.PRIME - 1, 2**64 - 1]
    for family, length in ((0, 13), (1, 50), (0, 1)):
        base, got = hashing._FAMILIES[family][1], hashing.windows(h, length, family)
        assert len(got) == len(h) - length + 1 and not len(hashing.windows(h[: length - 1], length, family))
        for i in (0, 1, 2, 65_535, 65_536, len(got) - 1):
            value = sum(int(x) * pow(base, k, hashing.PRIME) for k, x in enumerate(h[i : i + length])) % hashing.PRIME
            assert hashing.mixed(np.array([value], np.uint64))[0] == got[i]


def test_pairs_are_located_by_both_numbers():
    first, second = np.array([1, 5, 5, 5, 9], np.uint64), np.array([7, 1, 2, 3, 7], np.uint64)
    asked = [(5, 3), (5, 4), (1, 7), (9, 8), (10, 1), (5, 1)]
    got = hashing.located(first, second, *(np.array(x, np.uint64) for x in zip(*asked, strict=True)))
    assert got.tolist() == [3, -1, 0, -1, -1, 1]
    assert hashing.located(first[:0], second[:0], first, second).tolist() == [-1] * 5


def test_long_words_that_weak_hashes_confuse(spark):
    bits = thue_morse(1024)
    a, b = ("".join("ab"[x] for x in y) for y in (bits, 1 - bits))
    rest = [f"w{k}" for k in range(60)]
    rows = [(0, " ".join([*rest[:30], a, *rest[30:]])), (1, " ".join([*rest[:30], b, *rest[30:]]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r["doc_id"], r["n_removed"]) for r in covers.without_repeats(df).collect()) == [(0, 0), (1, 60)]
    assert suffixes.repeated_passages(df).count() == 0


def test_passage_many_times_in_two_documents(spark):
    rng = random.Random(9)
    passage = [f"p{rng.randint(0, 10**6)}" for _ in range(60)]
    df = spark.createDataFrame([(k, " ".join(passage * 20)) for k in (3, 8)], "doc_id long, text string")
    found = suffixes.repeated_passages(df).collect()
    assert sorted((r["doc_id"], r["start_word"], r["end_word"], r["other_doc_id"], r["repeats_earlier"]) for r in found) == [(3, 0, 1200, 8, False), (8, 0, 1200, 3, True)]
