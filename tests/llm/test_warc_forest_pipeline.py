import base64
import gzip
import hashlib
import zlib

import numpy as np
import pytest

import corpus_pipeline
from cadenza.llm import forest, langid, warc
from cadenza.llm.registry import tokenizer_path

from .conftest import SCHEMA
from .test_exact_simhash import fingerprint, norm
from .test_packing_mixing import count_words, targets


def record(kind, ident, payload, version=b"WARC/1.1"):
    block = warc.HTTP.encode() + payload
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = f"\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:page:{ident}>\r\nWARC-Payload-Digest: sha1:{digest}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
    return version + head.encode() + block + b"\r\n\r\n"


def found(data):
    rows = list(warc.salvage(data))
    return [r["record_id"][10:-1] for r in rows if "gap" not in r], [(r["position"], r["length"]) for r in rows if "gap" in r]


def test_salvage_of_plain_archives():
    a, b, c = (record("response", k, b"<p>%d</p>" % k * 20) for k in (1, 2, 3))
    assert found(a + b + c) == (["1", "2", "3"], [])
    broken = bytearray(b)
    broken[-30] ^= 1
    assert found(a + bytes(broken) + c) == (["1", "3"], [(len(a), len(b))])
    assert found(a + b[:50] + c) == (["1", "3"], [(len(a), 50)])
    assert found(b"junk" + a + c[:-9]) == (["1"], [(0, 4), (4 + len(a), len(c) - 9)])
    assert found(b"") == ([], []) and found(b"WARC/1.1 and nothing") == ([], [(0, 20)])


def test_salvage_of_gzip_members():
    parts = [gzip.compress(record("response", k, b"x" * 500 + bytes([k]) * 50)) for k in range(5)]
    assert found(b"".join(parts))[0] == list("01234")
    hurt = bytearray(parts[2])
    hurt[len(hurt) // 2] ^= 255
    ids, gaps = found(b"".join([*parts[:2], bytes(hurt), *parts[3:]]))
    assert ids == list("0134") and gaps == [(len(parts[0]) + len(parts[1]), len(hurt))]
    assert found(b"".join(parts[:4]) + parts[4][:-3])[0] == list("0123")


def test_headers_of_any_length(spark, tmp_path):
    path = f"file://{tmp_path}/long"
    url = "data:text/html," + "y" * 200_000
    warc.write_archives(spark.createDataFrame([(1, url, "a", "", 1), (2, "u", "b", "", 1)], PAGES), path)
    got = warc.read_archives(spark, path).collect()
    assert sorted((r["record_id"], r["target_uri"], r["gap"]) for r in got) == [("<urn:page:1>", url, None), ("<urn:page:2>", "u", None)]


def test_salvage_inside_gzip_members():
    rng = np.random.default_rng(1)
    many = [record("response", k, rng.integers(0, 256, 3000, np.uint8).tobytes()) for k in range(6)]
    hurt = bytearray(many[2])
    hurt[-30] ^= 1
    whole = gzip.compress(b"".join([*many[:2], bytes(hurt), *many[3:]]))
    assert found(whole) == (list("01345"), [(0, len(whole))])
    last = gzip.compress(record("response", 9, b"z"))
    cut = gzip.compress(b"".join(many))[:-4000]
    assert found(cut)[0] == list("0123")
    broken = bytearray(gzip.compress(b"".join(many)))
    broken[len(broken) * 2 // 3] ^= 255
    assert found(bytes(broken) + last)[0][:3] == list("012") and found(bytes(broken) + last)[0][-1] == "9"


def test_salvage_of_many_false_starts():
    """Thousands of version lines without a record, and one record behind them."""
    last = record("response", 7, b"<p>end</p>")
    junk = b"WARC/1.1 no record\x1f\x8b\x08" * 20_000
    assert found(junk + last) == (["7"], [(0, len(junk))])


PAGES = "page_id long, url string, html string, sha1 string, n long"


def test_round_trip(spark, tmp_path):
    texts = ["<a>1</a>", None, "", "é\r\n\r\nWARC/1.1\r\n", "<a>1</a>", "<a>1</a>", "x" * 100_000]
    rows = [(k, "http://x/ y\r\n" if k else None, t, "clash", 1) for k, t in enumerate(texts)] + [(None, "u", "only", "", 2)]
    path = f"file://{tmp_path}/a"
    warc.write_archives(spark.createDataFrame(rows, PAGES), path)
    got = warc.read_archives(spark, path).collect()
    assert all(r["gap"] is None for r in got) and len(got) == len(rows)
    by = {r["record_id"]: r for r in got}
    for k, t in enumerate(texts):
        r = by[f"<urn:page:{k}>"]
        data = (t or "").encode()
        top = max(i for i, s in enumerate(texts) if (s or "") == (t or ""))
        assert r["payload_bytes"] == len(data) and r["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert (r["record_type"], r["refers_to"]) == (("response", None) if k == top else ("revisit", f"<urn:page:{top}>"))
        assert bytes(r["payload"]) == data if k == top else r["payload"] is None
    assert by[None]["payload_bytes"] == 4


def test_no_pages(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    warc.write_archives(spark.createDataFrame([], PAGES), path)
    assert warc.read_archives(spark, path).where("gap is null").count() == 0


VECTORS = "vec_id long, embedding array<float>, label int, rep long, n string"


def brute(rows):
    ok = [(i, np.array(e, np.float32).astype(float), y) for i, e, y in rows if i is not None and y is not None and e and None not in e and np.isfinite(np.array(e, float)).all() and any(e)]
    links = {k: 0 for k in range(len(ok))}
    parent = list(range(len(ok)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ok)):
        for b in range(a):
            (_, x, p), (_, y, q) = ok[a], ok[b]
            if p == q and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                links[a] += 1
                links[b] += 1
                parent[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k in range(len(ok)):
        least[find(k)] = min(least.get(find(k), 1 << 60), ok[k][0])
    return sorted((ok[k][0], links[k], least[find(k)]) for k in range(len(ok)))


@pytest.mark.parametrize("leaf", [512, 24])
def test_forest_against_brute_force(spark, leaf):
    rng = np.random.default_rng(8)
    rows = []
    for k in range(220):
        base = rng.normal(size=16)
        rows.append((len(rows), base.tolist(), int(k % 2)))
        for _ in range(int(rng.integers(0, 3))):
            rows.append((len(rows), (base + rng.normal(size=16) * 0.15).tolist(), int(k % 2)))
    centre = rng.normal(size=16)
    for _ in range(80):
        rows.append((len(rows), (centre + rng.normal(size=16) * 0.02).tolist(), 1))
    rows += [(9000 + k, centre.tolist(), 1) for k in range(5)]
    got = forest.near_duplicate_vectors(spark.createDataFrame([(*r, 1, "x") for r in rows], VECTORS), leaf=leaf).collect()
    want = brute(rows)
    assert sorted(r["vec_id"] for r in got) == [w[0] for w in want]
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_vectors_that_cannot_link(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], None), (4, None, 1), (5, [0.0, 0.0], 1), (6, [nan, 1.0], 1), (7, [1.0, None], 1), (8, [inf, 1.0], 1), (9, [1.0, 0.0, 0.0], 1), (10, [], 1), (11, [-1.0, 0.0], 1)]
    got = forest.near_duplicate_vectors(spark.createDataFrame([(*r, 1, "x") for r in rows], VECTORS)).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [(1, 1, 1), (2, 1, 1)] + [(k, 0, k) for k in range(3, 12)]
    assert forest.near_duplicate_vectors(spark.createDataFrame([], VECTORS)).count() == 0


def test_pipeline_stages(spark, docs, none):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "exact", "near", "mix", "pack"]
    now, empty = docs, none
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"] for r in now.collect()}
        now, empty = stage(spark, now, "").persist(), stage(spark, empty, "")
        assert empty.count() == 0
        rows = now.collect()
        assert rows and {r["doc_id"] for r in rows} <= before
        if name != "pack":
            assert now.columns == docs.columns
    assert {"sequence_id", "offset", "length"} <= set(now.columns)


def near_groups(prints):
    """Indices of linked fingerprints, group by group."""
    label = list(range(len(prints)))
    for a in range(len(prints)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= 3 and label[a] != label[b]:
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if x == old else x for x in label]
    groups = {}
    for k, x in enumerate(label):
        groups.setdefault(x, []).append(k)
    return list(groups.values())


def mixed_rows(rows):
    """How often the mix takes each row: passes of its source's stream that reach its first word."""
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + count_words(r["text"])
    goal, out = targets(sizes), []
    for source, total in sizes.items():
        own = [r for r in rows if r["source"] == source]
        own.sort(key=lambda r: (hashlib.md5(str(r["doc_id"] if r["doc_id"] is not None else "").encode()).hexdigest(), r["doc_id"] or 0, count_words(r["text"])))
        at = 0
        for r in own:
            n = count_words(r["text"])
            if n:
                out += [r] * sum(p * total + at < min(round(goal[source]), 2 * total) for p in (0, 1))
            at += n
    return out


def test_pipeline_against_brute_force(spark, corpus):
    """Each stage on what the one before it kept, rows and all columns, against plain Python."""
    from tokenizers import Tokenizer

    rows = [*corpus, (None, "one of the texts without an id", None, "a", 30, "clash", 7), (None, "another text that has no id and more words", "en", "a", 40, "clash", 7)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    as_rows = lambda found: sorted((tuple(r) for r in found), key=repr)
    now, stages = docs, dict(corpus_pipeline.STAGES)

    before = now.collect()
    now = stages["language"](spark, now, "").persist()
    model = langid.learn(docs.where(~langid.held_out(docs["doc_id"])))
    told = [langid.label([r["text"] or ""], model)[0][0] for r in before]
    assert as_rows(now.collect()) == as_rows((*r[:2], lang, *r[3:]) for r, lang in zip(before, told, strict=True) if lang != "und")

    before = now.collect()
    now = stages["exact"](spark, now, "").persist()
    groups = {}
    for r in before:
        groups.setdefault(norm(r["text"]), []).append(r)
    least = lambda group: min(group, key=lambda r: (r["doc_id"] is None, r["doc_id"]))
    assert as_rows(now.collect()) == as_rows(least(g) for g in groups.values())

    before = now.collect()
    now = stages["near"](spark, now, "").persist()
    assert as_rows(now.collect()) == as_rows(least([before[k] for k in g]) for g in near_groups([fingerprint(r["text"]) for r in before]))

    before = now.collect()
    now = stages["mix"](spark, now, "").persist()
    assert as_rows(now.collect()) == as_rows(mixed_rows(before))

    before = now.collect()
    tok, want = Tokenizer.from_file(tokenizer_path()), []
    for r in before:
        ids = tok.encode(r["text"], add_special_tokens=False).ids + [1]
        for k, a in enumerate(range(0, len(ids), 4096)):
            want.append((r["doc_id"], k, a, len(ids[a : a + 4096]), zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes())))
    found = stages["pack"](spark, now, "").collect()
    assert sorted((tuple(r)[:5] for r in found), key=repr) == sorted(want, key=repr)
    places = {}
    for r in found:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in places.values():
        parts.sort()
        assert [a for a, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 4096
    assert len(places) <= -(-sum(w[3] for w in want) // 4096) + 1
