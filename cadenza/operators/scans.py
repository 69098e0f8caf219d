"""Ordered scans: state handed on from row to row of an entity, and what builds on them.

Rows are dealt by entity and sorted inside the partitions; a task reads them in Arrow batches
and carries its state over batches, so no entity is gathered and a batch is all that a worker
holds besides the state. Where steps can be composed (``smoothed``), an entity too large for
one task is cut into ranges of its order: each range gives its step as a whole, these are
composed range by range, and the ranges then start from the state they meet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from .ranges import ranged

#: Gets which rows start an entity, and the batch; gives the new columns' values.
Step = Callable[[np.ndarray, pa.RecordBatch], list[pa.Array]]


def _starts(batch: pa.RecordBatch, keys: list[str], last: pa.RecordBatch | None) -> np.ndarray:
    """Which rows have another key than the row before; ``last`` is the row before the batch."""
    out = np.zeros(batch.num_rows, bool)
    out[0] = last is None
    for key in keys:
        now = batch.column(key)
        head = now.slice(0, 1) if last is None else last.column(key)
        before = pa.concat_arrays([head, now.slice(0, len(now) - 1)])
        same = pc.fill_null(pc.equal(now, before), False)
        same = pc.or_(same, pc.and_(pc.is_null(now), pc.is_null(before)))
        out |= ~same.to_numpy(zero_copy_only=False)
    return out


def ordered_scan(df: DataFrame, keys: list[str], order: list[str | Column], make: Callable[[], Step], added: str, keep: Callable[[pa.RecordBatch], pa.Array] | None = None) -> DataFrame:
    """Rows with the columns ``added`` (a schema text) that a step gives, entity by entity.

    make: called once per task; what it returns holds the state. keep: which rows stay.
    """
    rows = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    schema = StructType(df.schema.fields + StructType.fromDDL(added).fields)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, last = make(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = step(_starts(batch, keys, last), batch)
            last = batch.slice(batch.num_rows - 1)
            out = pa.RecordBatch.from_arrays([*batch.columns, *new], names)
            yield out if keep is None else out.filter(keep(batch))

    return rows.mapInArrow(run, schema)


def _exponential(value: str, keep: float, given: str | None = None) -> Callable[[], Step]:
    """``keep * last + (1 - keep) * value``; an entity starts from its first value, or from
    ``given`` where that isn't null. Gives also the same without a start, and the share of it."""

    def make() -> Step:
        state: list[float | None] = [None, 0.0, 1.0]

        def step(first: np.ndarray, batch: pa.RecordBatch) -> list[pa.Array]:
            begin = batch.column(given).to_pylist() if given else None
            (s, alone, share), out, parts, shares = state, [], [], []
            for k, (new, x) in enumerate(zip(first.tolist(), batch.column(value).to_pylist(), strict=True)):
                if new:
                    s, alone, share = begin[k] if begin else None, 0.0, 1.0
                if x is not None:
                    s = x if s is None else keep * s + (1.0 - keep) * x
                    alone, share = keep * alone + (1.0 - keep) * x, keep * share
                out.append(s)
                parts.append(alone)
                shares.append(share)
            state[:] = s, alone, share
            return [pa.array(v, pa.float64()) for v in (out, parts, shares)]

        return step

    return make


def smoothed(df: DataFrame, entity: str, order: list[str], value: str, keep: float = 0.80, limit: int | None = None) -> DataFrame:
    """Rows with ``smoothed``: keep * last + (1 - keep) * value along an entity's order.

    A null value leaves the state as it is. The first of ``order`` is a number or a time.
    """
    rows, many = ranged(df, [F.col(order[0])], [entity], limit)
    added = "smoothed double, __alone double, __share double"
    if not many:
        return ordered_scan(rows.drop("__range"), [entity], order, _exponential(value, keep), added).drop("__alone", "__share")
    # each range as one step: what it adds and which share of its start it keeps; the first range
    # of an entity starts from its first value, so its end is its own
    whole = ordered_scan(rows, [entity, "__range"], order, _exponential(value, keep), added)
    end = F.struct(*order, (-F.col("__share")).alias("__step"))
    ends = whole.groupBy(entity, "__range").agg(*[F.max_by(c, end).alias(c) for c in ("smoothed", "__alone", "__share")])

    def compose() -> Step:
        state: list[float | None] = [None]

        def step(first: np.ndarray, batch: pa.RecordBatch) -> list[pa.Array]:
            s, out = state[0], []
            for new, own, alone, share in zip(first.tolist(), *(batch.column(c).to_pylist() for c in ("smoothed", "__alone", "__share")), strict=True):
                s = None if new else s
                out.append(s)
                s = own if s is None else share * s + alone
            state[0] = s
            return [pa.array(out, pa.float64())]

        return step

    begins = ordered_scan(ends, [entity], ["__range"], compose, "__given double").select(F.col(entity).alias("__e"), F.col("__range").alias("__r"), "__given")
    rows = rows.join(begins, F.col(entity).eqNullSafe(F.col("__e")) & (F.col("__range") == F.col("__r"))).drop("__e", "__r")
    out = ordered_scan(rows, [entity, "__range"], order, _exponential(value, keep, "__given"), added)
    return out.select(*df.columns, "smoothed")


def smoothed_boxes(df: DataFrame, entity: str, order: list[str], width: int, height: int, keep: float = 0.80, keep_reliability: float = 0.82) -> DataFrame:
    """Rows x1, y1, x2, y2, reliability of an entity's boxes with s_x1 to s_y2 and s_reliability.

    Each coordinate is rounded at each step, halves to even, and the box clipped to the image
    and kept a pixel wide and high at least; the first box stays as it is. Rounded steps can't
    be composed, so an entity is scanned by one task, in batches.
    """

    def make() -> Step:
        state: list = [None, None]

        def step(first: np.ndarray, batch: pa.RecordBatch) -> list[pa.Array]:
            box, r = state
            out: list[list] = [[], [], [], [], []]
            values = (batch.column(c).to_pylist() for c in ("x1", "y1", "x2", "y2", "reliability"))
            for new, *b, own in zip(first.tolist(), *values, strict=True):
                if new:
                    box, r = tuple(b), own
                else:
                    x1, y1, x2, y2 = (round(keep * old + (1.0 - keep) * x) for old, x in zip(box, b, strict=True))
                    x1, y1 = max(0, min(x1, width - 1)), max(0, min(y1, height - 1))
                    box = (x1, y1, max(x1 + 1, min(x2, width)), max(y1 + 1, min(y2, height)))
                    r = keep_reliability * r + (1.0 - keep_reliability) * own
                for column, v in zip(out, (*box, r), strict=True):
                    column.append(v)
            state[:] = box, r
            return [*(pa.array(c, pa.int32()) for c in out[:4]), pa.array(out[4], pa.float64())]

        return step

    return ordered_scan(df, [entity], order, make, "s_x1 int, s_y1 int, s_x2 int, s_y2 int, s_reliability double")


def _sweep(kinds: int) -> Callable[[], Step]:
    """Open intervals along the places: how many of each kind, and the largest confidence."""

    def make() -> Step:
        ends: list[tuple[int, int]] = []
        best: list[tuple[float, int]] = []
        counts = [0] * kinds

        def step(first: np.ndarray, batch: pa.RecordBatch) -> list[pa.Array]:
            flags: list[list[bool]] = [[] for _ in range(kinds)]
            most = []
            values = (batch.column(c).to_pylist() for c in ("__place", "__end", "__mask", "__confidence"))
            for new, place, end, mask, confidence in zip(first.tolist(), *values, strict=True):
                if new:
                    ends.clear()
                    best.clear()
                    counts[:] = [0] * kinds
                if mask is not None:
                    heappush(ends, (end, mask))
                    if confidence is not None:
                        heappush(best, (-confidence, end))
                    for k in range(kinds):
                        counts[k] += mask >> k & 1
                elif place is not None:
                    while ends and ends[0][0] < place:
                        gone = heappop(ends)[1]
                        for k in range(kinds):
                            counts[k] -= gone >> k & 1
                    while best and best[0][1] < place:
                        heappop(best)
                there = place is not None
                for k in range(kinds):
                    flags[k].append(there and counts[k] > 0)
                most.append(-best[0][0] if there and best else 0.0)
            return [*(pa.array(f, pa.bool_()) for f in flags), pa.array(most, pa.float64())]

        return step

    return make


def swept(frames: DataFrame, intervals: DataFrame, entity: str, place: str, kinds: dict[str, Column], start: str = "frame_start", end: str = "frame_end", confidence: str = "confidence", limit: int | None = None) -> DataFrame:
    """Rows with a flag per kind (whether an interval of the kind holds the place) and
    ``covering_confidence``, the largest confidence of such an interval; 0 without one.

    kinds: conditions on the intervals by name. Starts of intervals and rows are swept in the
    order of places; open intervals stand in heaps, by end and by confidence. The rows of a
    large entity are swept in ranges of places, and an interval is carried into each range that
    it touches. A row without a place, or of no entity, is held by nothing.
    """
    rows, many = ranged(frames, [F.col(place)], [entity], limit)
    names = [f"__f_{c}" for c in frames.columns]
    rows = rows.select(F.col(entity).alias("__entity"), F.col("__range"), F.col(place).cast("long").alias("__place"), *[F.col(c).alias(n) for c, n in zip(frames.columns, names, strict=True)])
    mask = F.lit(0)
    for k, condition in enumerate(kinds.values()):
        mask = mask + F.when(condition, 1 << k).otherwise(0)
    spans = intervals.where(F.col(entity).isNotNull() & (F.col(start) <= F.col(end))).select(
        F.col(entity).alias("__entity"), F.col(start).cast("long").alias("__place"), F.col(end).cast("long").alias("__end"), mask.alias("__mask"), F.col(confidence).cast("double").alias("__confidence")
    )
    if many:
        bounds = rows.where("__place is not null").groupBy(F.col("__entity").alias("__of"), "__range").agg(F.min("__place").alias("__low"), F.max("__place").alias("__high"))
        touch = (F.col("__entity") == F.col("__of")) & (F.col("__place") <= F.col("__high")) & (F.col("__end") >= F.col("__low"))
        spans = spans.join(bounds, touch).drop("__of", "__low", "__high")
    else:
        spans = spans.withColumn("__range", F.lit(0).cast("long"))
    events = rows.unionByName(spans, allowMissingColumns=True)
    # at one place, intervals open before rows are met
    order = ["__place", F.col("__mask").isNull()]
    added = ", ".join([*(f"`__k_{k}` boolean" for k in range(len(kinds))), "covering_confidence double"])
    out = ordered_scan(events, ["__entity", "__range"], order, _sweep(len(kinds)), added, keep=lambda batch: pc.is_null(batch.column("__mask")))
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, frames.columns, strict=True)], *[F.col(f"__k_{k}").alias(n) for k, n in enumerate(kinds)], "covering_confidence")
