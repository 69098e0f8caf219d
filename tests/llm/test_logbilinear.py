import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cadenza.llm import logbilinear as lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, held_out string, word string, n int"


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def held(k):
    return k is not None and zlib.crc32(str(k).encode()) % 5 == 1


def brute(rows):
    counts, ends = Counter(), 0
    for k, text in rows:
        if not held(k):
            counts.update(WORD.findall(lowered(text)))
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + (ends > 0)
    out = []
    for k, text in rows:
        c = [counts[w] for w in WORD.findall(lowered(text))] + [ends]
        out.append((k, held(k), len(c), sum(x > 0 for x in c), n, round(sum(math.log10((x + 0.5) / (n + 0.5 * (v + 1))) for x in c), 6)))
    return out


def frame(spark, rows, partitions=4):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA).repartition(partitions)


def scores(df):
    return [(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in df], [r["score"] for r in df]


key = lambda r: tuple((x is None, x or 0) for x in r)


def test_counts_and_base_against_counting(spark, corpus):
    rows = [r[:2] for r in corpus] + [(None, "null id words"), (None, None), (3, "A\x1cb \x0b c\x0cÀ")]
    got, found = scores(lm.scored(frame(spark, rows), words=40).collect())
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    assert all(x < 0 and math.isfinite(x) for x in found)


@pytest.fixture(scope="module")
def grammar():
    """Texts in two made-up languages: a word tells the language of the next."""
    rng = random.Random(5)
    sides = [[a + b for a in "bdfg" for b in ("a", "o", "u", "an", "on")], [a + b for a in "klmn" for b in ("i", "e", "is", "es", "it")]]
    rows = []
    for k in range(900):
        side = sides[rng.random() < 0.5]
        rows.append((k, " ".join(rng.choice(side) for _ in range(rng.randint(20, 60)))))
    return rows


def test_better_than_unigrams_on_held_out_texts(spark, grammar):
    rows = lm.scored(frame(spark, grammar)).where("held_out").collect()
    tokens = sum(r["n_tokens"] for r in rows)
    assert sum(r["score"] - r["base_score"] for r in rows) / tokens > 0.12


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(2)
    n = 30
    p = lm.Parameters(rng.normal(size=(n, 5)), rng.normal(size=(2, 5)), rng.normal(size=(n, 5)), rng.normal(size=n))
    before = np.repeat(rng.integers(0, n, (2, 50)), n, axis=1)
    ids = np.tile(np.arange(n), 50)
    logs = lm.log_probabilities(p, ids, before).reshape(50, n)
    assert np.allclose(np.exp(logs).sum(1), 1, atol=1e-5)
    x = p.context[before[0]] * p.places[0] + p.context[before[1]] * p.places[1]
    plain = (x @ p.target.T + p.bias)[np.arange(0, len(ids), n)]
    plain -= np.log(np.exp(plain).sum(1))[:, None]
    assert np.allclose(logs, plain, atol=1e-4)


def test_shares_of_tail_classes_sum_to_one(spark, corpus):
    """Over a class: its known words and one unknown word share the class's probability."""
    rows = [r[:2] for r in corpus]
    docs = frame(spark, rows).selectExpr("doc_id", "false as held_out", "text")
    model = lm.counted(docs, words=20)
    found = model.counts.collect()
    single = set(model.words)
    total = np.full(lm.TAILS, 0.5)
    for r in found:
        if r["word"] not in single:
            total[r["tail"]] += r["n"] + 0.5
    assert np.allclose(10 ** model.inside()[-lm.TAILS :], total)
    assert model.tokens == sum(r["n"] for r in found) + len(rows)


def test_one_step_against_loops():
    """A minibatch moves the parameters as a plain loop over tokens and noise does."""
    rng = np.random.default_rng(4)
    n, size = 12, 3
    noise = rng.random(n) + 0.1
    noise /= noise.sum()
    start = lm.Parameters(rng.normal(size=(n, size)), rng.normal(size=(2, size)), rng.normal(size=(n, size)), rng.normal(size=n))
    ids, before = rng.integers(0, n, 20), rng.integers(0, n, (2, 20))
    trainer = lm.Trainer(start, noise, 0.1, 7)
    trainer._minibatch(ids, before)
    drawn = np.minimum(np.searchsorted(np.cumsum(noise), np.random.default_rng(7).random(lm.NOISE), "right"), n - 1)
    grads = [np.zeros_like(x) for x in start.parts()]
    for t, (w, a, b) in enumerate(zip(ids, *before, strict=True)):
        x = start.context[a] * start.places[0] + start.context[b] * start.places[1]
        back = np.zeros(size)
        for true, v in [(1, w), *((0, v) for v in drawn)]:
            s = x @ start.target[v] + start.bias[v] - math.log(lm.NOISE * noise[v])
            g = 1 / (1 + math.exp(-s)) - true
            grads[2][v] += g * x
            grads[3][v] += g
            back += g * start.target[v]
        for k, c in enumerate((a, b)):
            grads[0][c] += back * start.places[k]
            grads[1][k] += back * start.context[c]
    for part, old, g in zip(trainer.p.parts(), start.parts(), grads, strict=True):
        assert np.allclose(part, old - 0.1 * g / np.sqrt(1 + g * g), atol=1e-4)


def test_mean_of_changes_is_weighted_by_row():
    start = lm.Parameters(np.zeros((2, 1)), np.zeros((2, 1)), np.zeros((2, 1)), np.zeros(2))

    def change(values, weights):
        x = np.array(values, float)
        return np.concatenate([x * np.array(weights), np.array(weights, float)])

    one = change([1, 2, 3, 4, 5, 6, 7, 8], [3, 0, 1, 1, 1, 1, 1, 1])
    two = change([5, 4, 3, 4, 7, 6, 7, 8], [1, 2, 1, 1, 1, 1, 1, 1])
    p = lm.moved(start, one + two)
    assert p.context.ravel().tolist() == [2, 4] and p.target.ravel().tolist() == [6, 6] and p.bias.tolist() == [7, 8]


def test_no_training_texts_long_text_and_empty_table(spark):
    rows = [(1, "some words here"), (1, None)]
    assert held(1) is False
    only = next(k for k in range(100) if held(k))
    got, found = scores(lm.scored(frame(spark, [(only, "never learned"), (only, "")])).collect())
    assert {r[3:] for r in got} == {(0, 0, 0.0)} and all(math.isfinite(x) and x <= 0 for x in found)
    long = [(0, "a b c d " * 400_000), (only, "a b zz"), *rows]
    got, found = scores(lm.scored(frame(spark, long, 2)).collect())
    assert sorted(got, key=key) == sorted(brute(long), key=key)
    assert lm.scored(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_split_is_that_of_the_pattern():
    texts = ["A  b\tc\x0b\x0cd\r\n", "", None, " ", "\x1cx É y", "aa AA aA"]
    words, code, owner = lm._split(pa.array(texts))
    found = [[w for w, o in zip(words.take(pa.array(code)).to_pylist(), owner.tolist(), strict=True) if o == k] for k in range(len(texts))]
    assert found == [WORD.findall(lowered(t)) for t in texts]
