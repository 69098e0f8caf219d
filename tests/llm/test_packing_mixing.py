import random
import re
import zlib

import numpy as np
import pytest
import pyarrow as pa
from pyspark.sql import functions as F

from cadenza.llm import mixing, packing
from cadenza.llm.registry import tokenizer_path
from cadenza.llm.words import slices


def test_packed_against_the_tokenizer(docs, corpus):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    want = []
    for r in corpus:
        ids = tok.encode(r[1] or "", add_special_tokens=False).ids + [1]
        for k, a in enumerate(range(0, len(ids), 512)):
            part = ids[a : a + 512]
            want.append((r[0], k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    rows = packing.packed(docs, tokenizer_path(), capacity=512).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    assert len(bins) <= -(-sum(r["length"] for r in rows) // 512) + 1


def test_packing_nothing(none):
    assert packing.packed(none, tokenizer_path()).count() == 0


def test_pieces_of_odd_texts():
    w = packing.WordTokens(tokenizer_path())
    rng = random.Random(1)
    parts = ["a", "b", "Z", "'", "s", "'s", "n't", "1", "23", ",", ".", "—", "é", "É", "é", "ß", "İ", "Σ", "ς", " ", "\n", " ", "<|endoftext|>", "<|ENDOFTEXT|>", "<", "|", ">", "日", "😀", "_", "\x00", "’", "̀", "½", "don't", "I'LL"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 50))) for _ in range(800)] + ["", None]
    for lo, hi, t in slices(pa.array(texts, pa.string()), 1500):
        ids, upto = w.encode(t)
        for k in range(hi - lo):
            assert ids[upto[k] : upto[k + 1]].tolist() == w.tokenizer.encode(texts[lo + k] or "", add_special_tokens=False).ids


def test_fullest_against_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(0, 6))}
        room = rng.randint(0, 60)
        items = [n for n, k in counts.items() for _ in range(k)]
        best = max(s for s in (sum(n for i, n in enumerate(items) if m >> i & 1) for m in range(1 << len(items))) if s <= room)
        used = packing.fullest(counts, room)
        assert sum(n * k for n, k in used.items()) == best and all(k <= counts[n] for n, k in used.items())


def test_plan_uses_every_piece():
    counts = {n: 1 + n % 5 for n in range(1, 400, 7)}
    used = {}
    for combo, times in packing.minimum_bin_slack(counts, 400):
        assert sum(n * k for n, k in combo.items()) <= 400
        for n, k in combo.items():
            used[n] = used.get(n, 0) + k * times
    assert used == counts


def count_words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def test_word_count(spark):
    texts = ["", None, " ", "a", " a", "a ", "\ta\n\nb\x0b c\r", "a b", "  \x0c x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(mixing.word_count(F.col("t"))).collect()] == [count_words(t) for t in texts]


def targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, full, out = 1.5 * sum(sizes.values()), {}, {}
    while True:
        open_ = [s for s in names if s not in full]
        rest = total - sum(full.values())
        w = sum(weight[s] for s in open_)
        out = {s: rest * weight[s] / w for s in open_} if open_ else {}
        over = [s for s in open_ if out[s] > 2 * sizes[s]]
        if not over:
            return full | out
        full |= {s: 2.0 * sizes[s] for s in over}


@pytest.mark.parametrize("block", [16, 4096])
def test_mix(docs, corpus, block):
    sizes = {}
    for r in corpus:
        sizes[r[3]] = sizes.get(r[3], 0) + count_words(r[1])
    goal = targets(sizes)
    mix = mixing.mix_sources(docs, block_words=block)
    rows = mix.taken().collect()
    assert sorted((r["doc_id"], r["size"]) for r in rows) == sorted((r[0], count_words(r[1])) for r in corpus)
    taken = {}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(goal[r["source"]])
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken[s] - goal[s]) <= 1 for s in goal)
    again = sorted((r["doc_id"], r["taken"]) for r in mixing.mix_sources(docs, block_words=block).taken().collect())
    assert again == sorted((r["doc_id"], r["taken"]) for r in rows)


def test_schedule_is_even(spark):
    counts = spark.createDataFrame([(0, 500), (1, 250), (2, 0), (3, 250)], "sid int, blocks long")
    rows = sorted((r["slot"], r["sid"], r["rank"]) for r in mixing.schedule(counts, 64).collect())
    assert len(rows) == 1000 and len({r[0] for r in rows}) == 1000
    seen = {}
    for k, (_, sid, rank) in enumerate(rows):
        assert rank == seen.get(sid, 0)
        seen[sid] = rank + 1
        if k % 100 == 99:
            assert abs(seen[0] - (k + 1) * 0.5) <= 8


def test_mixed_documents(docs, none, corpus):
    mix = mixing.mix_sources(docs)
    out = mixing.mixed_documents(docs, mix)
    assert out.columns == docs.columns
    got = {}
    for r in out.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    taken = {}
    for r in mix.taken().collect():
        if r["taken"]:
            taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + (1 if r["taken"] <= r["size"] else 2)
    assert set(got) == set(taken) and all(got[k] >= taken[k] - (k == 4) * 2 for k in got)
    assert mixing.mix_sources(none).taken().count() == 0
    assert mixing.mixed_documents(none, mixing.mix_sources(none)).count() == 0


def thue_morse(n):
    """The Thue-Morse word of n letters and its complement: polynomials modulo 2**64 don't tell them apart."""
    word = "".join("ab"[bin(k).count("1") % 2] for k in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_tokens_of_words_that_collide_under_weak_hashes(monkeypatch):
    monkeypatch.setattr(packing, "SLICE", 5000)
    w = packing.WordTokens(tokenizer_path())
    texts = [*thue_morse(1024), *thue_morse(2048), " ".join(thue_morse(64)), "é" * 40 + "x" * 20, "\x00a \x00 a\x00", "ab " * 6000 + "é" * 70]
    for _ in range(2):
        for lo, hi, t in slices(pa.array(texts, pa.string()), 3000):
            ids, upto = w.encode(t)
            for k in range(hi - lo):
                assert ids[upto[k] : upto[k + 1]].tolist() == w.tokenizer.encode(texts[lo + k], add_special_tokens=False).ids


def test_tokens_of_more_pieces_than_are_remembered(monkeypatch):
    monkeypatch.setattr(packing, "KNOWN_WORDS", 64)
    w = packing.WordTokens(tokenizer_path())
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randint(0, 300)}x{'é' * rng.randint(0, 40)}" for _ in range(200)) for _ in range(5)]
    for lo, hi, t in slices(pa.array(texts, pa.string()), 1 << 20):
        ids, upto = w.encode(t)
        for k in range(hi - lo):
            assert ids[upto[k] : upto[k + 1]].tolist() == w.tokenizer.encode(texts[lo + k], add_special_tokens=False).ids
