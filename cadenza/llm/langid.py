"""Language of whole texts, with spans of mixed-language text.

Letters fall into scripts by code point; a word's script leaves the languages whose learned
text uses that script. Each word then has a score per language: the sum of the log
probabilities of its character trigrams. A Viterbi pass over the words, with a penalty for
each change of language, labels spans. A document's language is the one with most letters,
its score their share.

Learning counts trigrams (hashed to ``BUCKETS``) of at most about ``DOCS_A_LANG`` labelled
documents of each language, chosen by a hash of the id; that bound is a parameter. The model
has BUCKETS numbers per language.

The Viterbi pass runs over all words of a slice at once: chunks of words are reduced to
matrices of best path scores, those are chained, and the paths are traced back.

Nulls: a null text or one without letters is ``und`` with the score 0 and no spans. Rows
without text or language aren't learned from. Ties go to the language first in code-point
order. With no row to learn from every text is ``und``. Repeated rows and other columns
change nothing.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .words import slices

BUCKETS = 1 << 15
DOCS_A_LANG = 2000
#: Documents that a task learns from.
DOCS_A_TASK = 1000
SWITCH = 12.0
FOREIGN = 30.0
LEAST_SHARE = 0.01
CHUNK = 256
UNKNOWN = "und"

#: Script names as they begin the names of letters (fixed values).
SCRIPTS = ("LATIN", "GREEK", "CYRILLIC", "ARMENIAN", "HEBREW", "ARABIC", "DEVANAGARI", "BENGALI", "TAMIL", "TELUGU", "THAI", "GEORGIAN", "HANGUL", "HIRAGANA", "KATAKANA", "CJK", "ETHIOPIC", "KHMER")


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point of the basic plane: script (0: no letter) and lower case."""
    script = np.zeros(0x10000, np.uint8)
    lower = np.arange(0x10000, dtype=np.uint32)
    of = {name: k + 1 for k, name in enumerate(SCRIPTS)}
    for c in range(0x10000):
        ch = chr(c)
        if unicodedata.category(ch)[0] in "LM":
            script[c] = of.get(unicodedata.name(ch, "").split(" ")[0].split("-")[0], len(SCRIPTS) + 1)
            if len(low := ch.lower()) == 1:
                lower[c] = ord(low)
    return script, lower


@dataclass(frozen=True)
class Letters:
    """The words (runs of letters) of consecutive texts.

    bucket: of the trigram around each letter; first: the first letter of each word; script,
    begin, end, doc: of each word (begin and end are places in the text's characters).
    """

    bucket: np.ndarray
    first: np.ndarray
    script: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    doc: np.ndarray


def letters(texts: list[str]) -> Letters:
    """Words and hashed trigrams of texts."""
    script_of, lower = _tables()
    joined = "\0".join(texts)
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = code < 0x10000
    script = np.where(low, script_of[np.where(low, code, 0)], 0)
    if not low.all():
        other, back = np.unique(code[~low], return_inverse=True)
        kinds = np.array([(len(SCRIPTS) + 1 if unicodedata.category(chr(c))[0] in "LM" else 0) for c in other.tolist()], np.uint8)
        script[~low] = kinds[back]
    is_letter = script > 0
    at = np.flatnonzero(is_letter)
    if not len(at):
        none = np.zeros(0, np.int64)
        return Letters(none, none, none, none, none, none)
    char = np.where(low[at], lower[np.where(low[at], code[at], 0)], code[at]).astype(np.uint64)
    new = np.empty(len(at), bool)
    new[0] = True
    new[1:] = np.diff(at) > 1
    last = np.empty(len(at), bool)
    last[-1] = True
    last[:-1] = new[1:]
    before = np.where(new, 0, np.concatenate([[0], char[:-1]]).astype(np.uint64)).astype(np.uint64)
    after = np.where(last, 0, np.concatenate([char[1:], [0]]).astype(np.uint64)).astype(np.uint64)
    mixed = (before * np.uint64(0x9E3779B97F4A7C15) + char) * np.uint64(0xBF58476D1CE4E5B9) + after * np.uint64(0x94D049BB133111EB)
    mixed ^= mixed >> np.uint64(29)
    bucket = ((mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(new)
    begin, end = at[first], at[np.flatnonzero(last)] + 1
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    doc = np.searchsorted(starts, begin, "right") - 1
    return Letters(bucket, first, script[begin], begin - starts[doc], end - starts[doc], doc)


@dataclass(frozen=True)
class Model:
    """langs in code-point order; logp: buckets by langs; scripts: scripts by langs, allowed."""

    langs: list[str]
    logp: np.ndarray
    scripts: np.ndarray


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram and script counts of each language over all batches of a task."""
    grams: dict[str, np.ndarray] = {}
    kinds: dict[str, np.ndarray] = {}
    for batch in batches:
        names = np.array(batch.column(0).to_pylist(), object)
        for lo, hi, _ in slices(batch.column(1)):
            part, lang = batch.column(1).slice(lo, hi - lo).to_pylist(), names[lo:hi]
            for name in set(lang.tolist()):
                w = letters([t for t, n in zip(part, lang, strict=True) if n == name])
                grams[name] = grams.get(name, 0) + np.bincount(w.bucket, minlength=BUCKETS)
                sizes = np.diff(np.append(w.first, len(w.bucket)))
                kinds[name] = kinds.get(name, 0) + np.bincount(w.script, weights=sizes, minlength=len(SCRIPTS) + 2)
    found = sorted(grams)
    yield pa.RecordBatch.from_arrays(
        [pa.array(found, pa.string()), pa.array([grams[n].astype("<u4").tobytes() for n in found], pa.binary()), pa.array([kinds[n].astype("<f8").tobytes() for n in found], pa.binary())],
        ["lang", "grams", "scripts"],
    )


_COUNTS = "lang string, grams binary, scripts binary"


def _total(table: pa.Table) -> pa.Table:
    """The counts of one language over all tasks, in the order of their bytes."""
    out = [table["lang"][:1]]
    for name, kind in (("grams", "<u4"), ("scripts", "<f8")):
        total = sum(np.frombuffer(x, kind).astype(kind) for x in sorted(table[name].to_pylist()))
        out.append(pa.array([total.tobytes()], pa.binary()))
    return pa.table(out, names=["lang", "grams", "scripts"])


def learn(docs: DataFrame, docs_a_lang: int = DOCS_A_LANG, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn a model from labelled documents, at most about docs_a_lang of each language."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((len(SCRIPTS) + 2, 0), bool))
    bound = F.lit(0)
    for lang, n in sizes.items():
        bound = F.when(F.col("lang") == lang, int(min(1.0, docs_a_lang / n) * (1 << 20))).otherwise(bound)
    # null and repeated ids are told apart by their texts, and a repeated row is learned once
    sample = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 20)) < bound).groupBy("lang", "id", "text").agg(F.lit(1).alias("n")).select("lang", "text")
    tasks = -(-sum(min(n, docs_a_lang) for n in sizes.values()) // DOCS_A_TASK)
    found = sample.repartition(tasks).mapInArrow(_counts, _COUNTS).groupBy("lang").applyInArrow(_total, _COUNTS).collect()
    langs = sorted(sizes)
    grams = np.zeros((BUCKETS, len(langs)))
    scripts = np.zeros((len(SCRIPTS) + 2, len(langs)))
    for r in found:
        k = langs.index(r["lang"])
        grams[:, k] += np.frombuffer(r["grams"], "<u4")
        scripts[:, k] += np.frombuffer(r["scripts"], "<f8")
    smooth = grams + 0.5
    share = scripts / np.maximum(scripts.sum(axis=0), 1)
    return Model(langs, np.log(smooth / smooth.sum(axis=0)).astype(np.float32), share >= LEAST_SHARE)


def viterbi(scores: np.ndarray, switch: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """The best label of each row: scores by label, and what a change before the row costs."""
    n, k = scores.shape
    c = -(-n // chunk)
    s = np.zeros((c * chunk, k), np.float64)
    s[:n] = scores
    w = np.zeros(c * chunk)
    w[:n] = switch
    s, w = s.reshape(c, chunk, k), w.reshape(c, chunk)
    through = np.full((c, k, k), -np.inf)
    through[:, np.arange(k), np.arange(k)] = 0
    for t in range(chunk):
        through = np.maximum(through, through.max(axis=2, keepdims=True) - w[:, t, None, None]) + s[:, t, None, :]
    enter = np.zeros((c, k))
    for i in range(1, c):
        v = (enter[i - 1][:, None] + through[i - 1]).max(axis=0)
        enter[i] = v - v.max()
    v, jumps, best = enter, np.empty((chunk, c, k), bool), np.empty((chunk, c), np.int64)
    for t in range(chunk):
        best[t] = v.argmax(axis=1)
        jump = (v.max(axis=1) - w[:, t])[:, None]
        jumps[t] = jump > v
        v = np.where(jumps[t], jump, v) + s[:, t]
    came = np.tile(np.arange(k), (c, 1))
    rows = np.arange(c)
    for t in range(chunk - 1, -1, -1):
        came = np.where(jumps[t][rows[:, None], came], best[t][:, None], came)
    leave = np.empty(c, np.int64)
    leave[-1] = v[-1].argmax()
    for i in range(c - 1, 0, -1):
        leave[i - 1] = came[i, leave[i]]
    out = np.empty((c, chunk), np.int64)
    now = leave
    for t in range(chunk - 1, -1, -1):
        out[:, t] = now
        now = np.where(jumps[t][rows, now], best[t], now)
    return out.ravel()[:n]


def label(texts: list[str], model: Model, switch: float = SWITCH) -> list[tuple[str, float, list[dict]]]:
    """Language, score and spans (start, end, lang; in characters) of each text."""
    out = [(UNKNOWN, 0.0, []) for _ in texts]
    w, k = letters(texts), len(model.langs)
    if not len(w.first) or not k:
        return out
    scores = np.add.reduceat(model.logp[w.bucket], w.first, axis=0)
    allowed = model.scripts[w.script]
    scores -= np.where(allowed | ~allowed.any(axis=1, keepdims=True), 0.0, FOREIGN).astype(np.float32)
    starts = np.concatenate([[True], np.diff(w.doc) > 0])
    best = viterbi(scores, np.where(starts, 0.0, switch))
    sizes = np.diff(np.append(w.first, len(w.bucket)))
    share = np.bincount(w.doc * k + best, weights=sizes, minlength=len(texts) * k).reshape(-1, k)
    total, pick = share.sum(axis=1), share.argmax(axis=1)
    cut = np.flatnonzero(starts | np.concatenate([[True], np.diff(best) != 0]))
    ends = w.end[np.append(cut[1:], len(best)) - 1]
    spans: list[list[dict]] = [[] for _ in texts]
    for d, a, b, x in zip(w.doc[cut].tolist(), w.begin[cut].tolist(), ends.tolist(), best[cut].tolist(), strict=True):
        spans[d].append({"start": a, "end": b, "lang": model.langs[x]})
    for d in np.flatnonzero(total).tolist():
        out[d] = (model.langs[pick[d]], float(share[d, pick[d]] / total[d]), spans[d])
    return out


SPANS = "array<struct<start:int,end:int,lang:string>>"


def _labelled(model, keep: int, size: int, switch: float, names: list[str]):
    """Rows of ``keep`` columns and a text last: those columns, then lang_pred, score, spans."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, _ in slices(batch.column(keep), size):
                part = batch.slice(lo, hi - lo)
                found = label([t or "" for t in part.column(keep).to_pylist()], model.value, switch)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:keep], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], kind)],
                    names=[*names, "lang_pred", "score", "spans"],
                )

    return run


def _slice_bytes(model: Model) -> int:
    return max(1 << 14, (1 << 21) // max(4, len(model.langs)))


def identify(docs: DataFrame, model: Model, switch: float = SWITCH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, spans`` of every row; only the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        _labelled(shared, 1, _slice_bytes(model), switch, ["doc_id"]), f"doc_id {id_type}, lang_pred string, score double, spans {SPANS}"
    )


def keep_identified(docs: DataFrame, model: Model, switch: float = SWITCH, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows that have a language, their language column set to it; all columns of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"c{k}" for k in range(len(docs.columns))]
    rows = docs.toDF(*names)
    text = f"c{docs.columns.index(text_col)}"
    kind = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema.fields, strict=True))
    found = rows.withColumn("text", F.col(text).cast("string")).mapInArrow(
        _labelled(shared, len(names), _slice_bytes(model), switch, names), f"{kind}, lang_pred string, score double, spans {SPANS}"
    )
    out = [F.col("lang_pred" if c == lang_col else n).alias(c) for n, c in zip(names, docs.columns, strict=True)]
    return found.where(F.col("lang_pred") != UNKNOWN).select(*out)


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: CRC-32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
