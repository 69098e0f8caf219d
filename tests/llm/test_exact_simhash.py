import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from cadenza.llm import exact, fuse, simhash


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact_duplicates(docs, corpus):
    groups = {}
    for r in corpus:
        groups.setdefault(norm(r[1]), []).append(r[0])
    want = sorted((r[0], min(groups[norm(r[1])]), len(groups[norm(r[1])]), hashlib.sha256(norm(r[1]).encode()).digest()) for r in corpus)
    got = sorted((r["doc_id"], r["keep_id"], r["group_size"], bytes(r["digest"])) for r in exact.exact_duplicates(docs).collect())
    assert got == want


def test_drop_exact_keeps_columns_and_one_row_each(docs, corpus):
    out = exact.drop_exact_duplicates(docs)
    assert out.columns == docs.columns
    ids = sorted(r["doc_id"] for r in out.collect())
    assert ids == sorted({min(r[0] for r in corpus if norm(r[1]) == t) for t in {norm(r[1]) for r in corpus}})


def test_null_ids(spark):
    df = spark.createDataFrame([(None, "a"), (2, "a"), (None, "b"), (None, "b")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact.exact_duplicates(df).collect()), key=repr)
    assert got == sorted([(None, 2, 2, False), (2, 2, 2, True), (None, None, 2, True), (None, None, 2, True)], key=repr)


def test_empty(none):
    assert exact.exact_duplicates(none).count() == 0
    assert exact.drop_exact_duplicates(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.drop_near_duplicates(none).count() == 0


def test_snapshot_against_batch(docs, spark):
    rows = exact.fingerprinted(docs)
    old, new = rows.where("doc_id < 40"), rows.where("doc_id >= 40")
    found = exact.against_snapshot(docs, new, exact.snapshot(old)).collect()
    known = {bytes(r["digest"]) for r in old.collect()}
    assert {bytes(r["digest"]) for r in found if r["old_keep"] is not None} == known & {bytes(r["digest"]) for r in new.collect()}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000, 50_000])
def test_fuse_filter(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 1 << 63, n).astype(np.uint64)
    blob = fuse.build(keys)
    assert fuse.contains(blob, keys).all()
    if n >= 1000:
        assert fuse.contains(blob, rng.integers(0, 1 << 63, 100_000).astype(np.uint64)).mean() < 1e-3
        assert len(blob) < 2.6 * n + 4000


def fingerprint(t):
    data = bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode())
    w = re.findall(rb"[^\x20\x09-\x0D]+", data)
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_components(docs, corpus):
    prints = {r[0]: fingerprint(r[1]) for r in corpus}
    parent = {k: k for k in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in prints:
        for b in prints:
            if bin(prints[a] ^ prints[b]).count("1") <= 3:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(corpus)
    for r in got:
        assert r["bits"] & (2**64 - 1) == prints[r["doc_id"]] and r["component_id"] == find(r["doc_id"])
    out = simhash.drop_near_duplicates(docs)
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == sorted({find(k) for k in prints})


def test_near_copies_under_null_and_repeated_ids(spark):
    a, b, c, d, e = (" ".join(f"{x}{k * k % 97}" for k in range(60)) for x in "abcde")
    rows = [(None, a), (None, a + " "), (None, b), (None, None), (1, c), (1, d), (2, d), (3, d), (1, d), (4, e), (None, e), (5, a + "\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r["doc_id"], norm(r["text"]).strip()) for r in simhash.drop_near_duplicates(df).collect()), key=repr)
    assert got == sorted([(5, a), (None, b), (None, ""), (1, c), (1, d), (4, e)], key=repr)
    links = {(r["doc_id"], r["bits"]): r["component_id"] for r in simhash.near_duplicates(df).collect()}
    assert links[None, simhash._signed(fingerprint(a))] == 5 and links[2, simhash._signed(fingerprint(d))] == 1


def test_near_copies_without_ids_are_linked(spark):
    rng = random.Random(3)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(3000)]
    first = fingerprint(" ".join(base))
    # the first change at the end that turns a bit
    close = next(t for n in range(1, 200) if fingerprint(t := " ".join([*base, *(f"more{k}" for k in range(n))])) != first)
    assert bin(fingerprint(close) ^ first).count("1") <= 3
    texts = [" ".join(base), close, " ".join(base[::-1])]
    df = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    assert simhash.drop_near_duplicates(df).count() == 2


def test_every_close_pair_shares_a_mask():
    masks = simhash.covering_masks(3)
    rng = random.Random(0)
    assert len(masks) == 15
    for _ in range(3000):
        flipped = sum(1 << k for k in rng.sample(range(64), rng.randint(0, 3)))
        assert any(m & flipped == 0 for m in masks)


@pytest.mark.parametrize("bucket", [2048, 5])
def test_links_in_large_buckets(spark, bucket):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(4)]
    bits = sorted({b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 4))) for b in base for _ in range(60)})
    df = spark.createDataFrame([(simhash._signed(b), k) for k, b in enumerate(bits)], "bits long, rep long")
    parent = list(range(len(bits)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(bits)):
        for b in range(a):
            if bin(bits[a] ^ bits[b]).count("1") <= 3:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    want = [find(k) for k in range(len(bits))]
    found = list(range(len(bits)))

    def root(x):
        while found[x] != x:
            x = found[x]
        return x

    for r in simhash.linked(df, bucket=bucket).collect():
        assert bin(bits[r["u"]] ^ bits[r["v"]]).count("1") <= 3 or root(r["u"]) is not None
        x, y = root(r["u"]), root(r["v"])
        found[max(x, y)] = min(x, y)
    assert [root(k) for k in range(len(bits))] == want
