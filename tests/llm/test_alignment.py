import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from cadenza.llm import alignment
from cadenza.llm.registry import tokenizer_path

FIRST, SECOND = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
ODD = [
    "plain words here", " leading", "two  spaces and\n\nlines\t tab ", "café été naïve", "a b   c d e　f", "▁marked▁text", "<|endoftext|> <s> </s> <0x0A>",
    "don't we'll I'm it's 's", "日本語 のテキスト 。 です", "x" * 3000, "é ö a ́b", "1234 567,890.12 $%& *** a***b", "\x00 \x01 \x1c \x85 a\x85 b", "\U0001f600 \U0001f468‍\U0001f469 ok", " ", "  ", "\n", "a", None, "",
    "A   b  c  d", "tab\tonly words\x0bvt\x0cff end", "Ünïcode ßtraße İstanbul", "   lots   of   runs   ",
]


@pytest.fixture(scope="module")
def models():
    return alignment.ByteTokens(FIRST), alignment.PieceTokens(SECOND)


def whole(models, text):
    """Tokens of the whole text in one call a side, aligned by a plain walk over its bytes."""
    if not text:
        return None
    one, two = models
    a, b = one.encode([" " + text])[0], two.encode([text])[0]
    bytes_ = (" " + text).encode()
    if b"".join(one.bytes[i] for i in a) != bytes_ or b"".join(two.bytes[i] for i in b) != bytes_:
        return None
    spans = []
    for side, ids in ((one, a), (two, b)):
        at, out = 0, []
        for i in ids:
            out.append((at, at + len(side.bytes[i]), i))
            at = out[-1][1]
        spans.append(out)
    cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
    groups, low = [], 0
    for cut in cuts:
        groups.append("|".join(",".join(str(i) for s, e, i in side if low <= s and e <= cut) for side in spans))
        low = cut
    links = [(i, j) for s, e, i in spans[0] for t, f, j in spans[1] if s < f and t < e]
    return a, b, groups, links


def brute(models, texts):
    found = [whole(models, t) for t in texts]
    counts = Counter(p for f in found if f for p in set(f[3]))
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    rows = []
    for f in found:
        if f is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
            continue
        a, b, groups, links = f
        top = sum(counts[p] == best[p[0]] for p in links)
        rows.append((len(a), len(b), len(groups), len(links), top, sum(counts[p] for p in links), sha256(";".join(groups).encode()).hexdigest()))
    return rows, counts, best


def run(spark, texts, partitions=3, **more):
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, batch string, pair int").repartition(partitions)
    return alignment.aligned(docs, FIRST, SECOND, **more)


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_against_whole_texts(spark, models, corpus, monkeypatch):
    texts = ODD + [r[1] for r in corpus if len(r[1] or "") < 9000] + ["the same words again"] * 40
    got = run(spark, texts)
    rows = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in got.documents.collect()}
    want, counts, best = brute(models, texts)
    assert [rows[k] for k in range(len(texts))] == want
    pairs = {(r["first"], r["second"]): (r["docs"], r["best"]) for r in got.pairs.collect()}
    assert pairs == {p: (n, n == best[p[0]]) for p, n in counts.items()}
    assert got.documents.dtypes[0] == ("doc_id", "bigint")


def test_groups_are_given_as_text(spark, models):
    rows = run(spark, ODD, with_groups=True).documents.collect()
    for r in rows:
        found = whole(models, ODD[r["doc_id"]])
        assert r["groups"] == (";".join(found[2]) if found else "")


def test_small_batches_and_forgotten_pieces_change_nothing(models):
    import pyarrow as pa

    aligner = alignment.Aligner(FIRST, SECOND)
    batch = alignment._Batch(aligner, pa.array(ODD), True)
    aligner.forget()
    again = [alignment._Batch(aligner, pa.array([t], pa.string()), True) for t in ODD]
    assert batch.groups == [a.groups[0] for a in again]
    assert [batch.stats[k].tolist() for k in range(4)] == [[int(a.stats[k][0]) for a in again] for k in range(4)]
    for text, groups in zip(ODD, batch.groups, strict=True):
        found = whole(models, text)
        assert groups == (";".join(found[2]) if found else "")


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab Z9.'\n\t  　é▁日\U0001f600\x1c\x85s")), max_size=40))
def test_pieces_hold_the_tokens_of_the_whole(text):
    if not text:
        return
    one, two = alignment._aligner(FIRST, SECOND).first, alignment._aligner(FIRST, SECOND).second
    data = np.frombuffer((" " + text).encode(), np.uint8)
    at = [*alignment.pieces(data, np.zeros(1, np.int64)).tolist(), len(data)]
    parts = [data[a:b].tobytes().decode() for a, b in zip(at[:-1], at[1:], strict=True)]
    assert [i for x in one.encode(parts) for i in x] == one.encode([" " + text])[0]
    assert [i for x in two.encode([p[1:] for p in parts]) for i in x] == two.encode([text])[0]


def test_alignment_of_sizes():
    found = alignment.align(np.array([2, 3, 1]), np.array([1, 1, 4]))
    assert found.cuts.tolist() == [2, 6] and found.first_group.tolist() == [0, 1, 1] and found.second_group.tolist() == [0, 0, 1]
    assert list(zip(found.first.tolist(), found.second.tolist(), strict=True)) == [(0, 0), (0, 1), (1, 2), (2, 2)]


def test_null_and_repeated_ids_and_empty_table(spark, models):
    texts = ["some words", "other words"] * 30
    docs = spark.createDataFrame([(None if k % 3 else 5, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = sorted(tuple(r[c] for c in COLUMNS) for r in alignment.aligned(docs, FIRST, SECOND).documents.collect())
    assert got == sorted(brute(models, texts)[0])
    none = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.aligned(none, FIRST, SECOND).documents.count() == 0


def test_a_text_of_megabytes_and_many_batches(spark, models, monkeypatch):
    text = " ".join(f"w{zlib.crc32(bytes([k % 251])) % 997} and" for k in range(300_000))
    short = "and w1 and"
    got = {r["doc_id"]: r for r in run(spark, [text, short, text], 1).documents.collect()}
    one, two = models
    a, b = one.encode([" " + text])[0], two.encode([text])[0]
    assert (got[0]["n_a"], got[0]["n_b"]) == (len(a), len(b)) and got[0]["count_sum"] == got[2]["count_sum"]
    assert got[1]["n_links"] > 0
