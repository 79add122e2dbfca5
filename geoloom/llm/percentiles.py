"""Percentiles of very large numeric columns by mergeable rank-interval summaries.

A summary is an ascending list of tuples (v, le, lt): at least ``le`` values are
<= v and at most ``lt`` are < v. Between neighbours i and j there may be at most
lt[j] - le[i] further values, which is all that is not known. Summaries of
separate partitions, days or years merge by adding the bounds, so uncertainty
adds and never multiplies; a merged summary is compressed by dropping tuples as
long as the gap stays within what its level permits. With L levels of merging,
level l permits a gap of 2 * eps * n * l / L, hence the result of the last level
is within eps * n ranks, and the gap it really has is reported.

Everything is deterministic: the same rows in the same partitions give the same
summaries, and the bound holds for any partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a task sorts at once.
BUFFER_ROWS = 1 << 20
#: Values in summaries that a task holds before it sends them on.
HELD_VALUES = 4 << 20
#: Slots in which the tasks' summaries of a group are merged first, so that no task merges all of a hot group.
SLOTS = 32
#: Summaries that are merged at a time.
AT_ONCE = 64

Summary = tuple[int, np.ndarray, np.ndarray, np.ndarray]


def compress(s: Summary, allowed: int) -> Summary:
    """Keep the first and last tuple and as few others as leave no gap above ``allowed``."""
    n, v, le, lt = s
    if len(v) <= 2 or allowed <= 0:
        return s
    keep, i, last = [0], 0, len(v) - 1
    while i < last:
        i = min(max(int(np.searchsorted(lt, le[i] + allowed, "right")) - 1, i + 1), last)
        keep.append(i)
    return n, v[keep], le[keep], lt[keep]


def merge(summaries: Sequence[Summary]) -> Summary:
    if len(summaries) == 1:
        return summaries[0]
    v = np.unique(np.concatenate([s[1] for s in summaries]))
    le, lt = np.zeros(len(v), np.int64), np.zeros(len(v), np.int64)
    for n, own, own_le, own_lt in summaries:
        le += np.append(0, own_le)[np.searchsorted(own, v, "right")]
        lt += np.append(own_lt, n)[np.searchsorted(own, v, "left")]
    return sum(s[0] for s in summaries), v, le, lt


def query(s: Summary, p: float) -> tuple[float, int]:
    """The value whose rank is surely nearest to ceil(p * n), and how many ranks it may be off."""
    n, v, le, lt = s
    rank = min(max(int(np.ceil(p * n)), 1), n)
    # What a tuple may be too high by grows along the list and what it may be too low by shrinks; the best is where they cross.
    i = min(int(np.searchsorted(le + lt + 1, 2 * rank)), len(v) - 1)
    off = lambda k: max(0, int(lt[k]) + 1 - rank, rank - int(le[k]))
    best = min((k for k in (i - 1, i) if k >= 0), key=lambda k: (off(k), -k))
    return float(v[best]), off(best)


def _pack_rising(a: np.ndarray) -> bytes:
    """A rising array as its steps, in as few bytes each as they need."""
    step = np.diff(a, prepend=0)
    width = next(w for w in (1, 2, 4, 8) if w == 8 or step.max(initial=0) < 1 << 8 * w)
    return bytes([width]) + step.astype(f"<u{width}").tobytes()


def _unpack_rising(b: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(b, f"<u{b[0]}", offset=1).astype(np.int64))


def _pack(s: Summary) -> tuple[int, bytes, bytes, bytes]:
    return s[0], s[1].tobytes(), _pack_rising(s[2]), _pack_rising(s[3])


def _unpack(n: int, v: bytes, le: bytes, lt: bytes) -> Summary:
    return n, np.frombuffer(v, np.float64), _unpack_rising(le), _unpack_rising(lt)


_FIELDS = [("n", pa.int64()), ("v", pa.binary()), ("le", pa.binary()), ("lt", pa.binary())]


def _rows(keys: Sequence[tuple], kinds: Sequence[tuple[str, pa.DataType]], summaries: Sequence[Summary]) -> pa.RecordBatch:
    columns = zip(*[(*key, *_pack(s)) for key, s in zip(keys, summaries)])
    named = [*kinds, *_FIELDS]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, named)], [n for n, _ in named])


def _leaf(eps: float, levels: int):
    """Summaries of a task's groups, compressed once per buffer; buffers of the same group are merged before they leave the task."""

    def exact(keys: pa.Table, values: np.ndarray) -> Iterator[tuple[tuple, Summary]]:
        codes = np.zeros(len(values), np.int64)
        for name in keys.column_names:
            c = keys[name].combine_chunks().dictionary_encode("encode")
            codes = codes * len(c.dictionary) + c.indices.to_numpy(zero_copy_only=False)
            codes = np.unique(codes, return_inverse=True)[1]
        order = np.lexsort((values, codes))
        values, codes = values[order], codes[order]
        new = np.flatnonzero(np.diff(codes, prepend=-1) | np.append(True, values[1:] != values[:-1]))
        group = np.flatnonzero(np.diff(codes, prepend=-1))
        ends = np.append(group[1:], len(values))
        cut = np.searchsorted(new, np.append(group, len(values)))
        until = np.append(new[1:], len(values))
        firsts = keys.take(pa.array(order[group])).to_pydict()
        for k, key in enumerate(zip(*firsts.values()) if firsts else [()]):
            own = slice(cut[k], cut[k + 1])
            yield key, (int(ends[k] - group[k]), values[new[own]], until[own] - group[k], new[own] - group[k])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        slot = (task.partitionId() if task else 0) % SLOTS
        held: dict[tuple, Summary] = {}
        waiting, rows, kinds = [], 0, []

        def take() -> None:
            t = pa.Table.from_batches(waiting)
            for key, s in exact(t.drop_columns(["__value"]), t["__value"].to_numpy()):
                s = merge([held[key], s]) if key in held else s
                held[key] = compress(s, 2 * int(eps * s[0] / levels))
            waiting.clear()

        def out() -> pa.RecordBatch:
            batch = _rows([(*key, slot) for key in held], [*kinds, ("slot", pa.int64())], list(held.values()))
            held.clear()
            return batch

        for batch in batches:
            kinds = [(f.name, f.type) for f in batch.schema if f.name != "__value"]
            waiting.append(batch)
            rows += len(batch)
            if rows >= BUFFER_ROWS:
                take()
                rows = 0
                if sum(len(s[1]) for s in held.values()) > HELD_VALUES:
                    yield out()
        if rows:
            take()
        if held:
            yield out()

    return run


def _merge_sorted(by: Sequence[str], share: float):
    """Summaries arrive ordered by their group; each group is merged, a few at a time, until its last one is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, keys, done, kinds = None, [], [], [], []

        def merged() -> Summary:
            # What several mergers of one level may add up to is what one of them may, since allowances add up.
            s = merge(held)
            return compress(s, 2 * int(share * s[0]))

        def out() -> pa.RecordBatch:
            batch = _rows(keys, kinds, done)
            keys.clear()
            done.clear()
            return batch

        for batch in batches:
            kinds = [(c, batch.schema.field(c).type) for c in by]
            columns = [batch[c].to_pylist() for c in (*by, *(f for f, _ in _FIELDS))]
            for row in zip(*columns):
                if held and row[: len(by)] != key:
                    keys.append(key)
                    done.append(merged())
                    held = []
                key = row[: len(by)]
                held.append(_unpack(*row[len(by) :]))
                if len(held) >= AT_ONCE:
                    held = [merged()]
            if len(done) >= 256:
                yield out()
        if held:
            keys.append(key)
            done.append(merged())
        if done:
            yield out()

    return run


def _ddl(df: DataFrame, columns: Sequence[str]) -> str:
    kinds = dict(df.dtypes)
    return "".join(f"`{c}` {kinds[c]}, " for c in columns)


_SUMMARY = "n long, v binary, le binary, lt binary"


def summarise(df: DataFrame, by: Sequence[str], value: str, *, eps: float = 0.001, levels: int = 4) -> DataFrame:
    """One summary per group: ``by`` columns, n, v, le, lt; mergeable by ``combine`` up to ``levels`` levels in all.

    Takes three of the levels at any size: tasks, slots of tasks, groups.
    """
    number = F.col(value).cast("double")
    rows = df.select(*by, number.alias("__value")).where(number.isNotNull() & ~F.isnan(number))
    leaves = rows.mapInArrow(_leaf(eps, levels), f"{_ddl(df, by)}slot long, {_SUMMARY}")
    return combine(combine(leaves, [*by, "slot"], eps=eps, level=2, levels=levels), by, eps=eps, level=3, levels=levels)


def combine(summaries: DataFrame, by: Sequence[str], *, eps: float = 0.001, level: int, levels: int = 4) -> DataFrame:
    """Merge the summaries of each group of ``by``; the result is within eps * level / levels of all ranks."""
    ordered = summaries.repartition(*map(F.col, by)).sortWithinPartitions(*map(F.col, by))
    return ordered.mapInArrow(_merge_sorted(list(by), eps * level / levels), f"{_ddl(summaries, by)}{_SUMMARY}")


def percentiles(summaries: DataFrame, by: Sequence[str], ps: Sequence[float]) -> DataFrame:
    """``by`` columns, n, p, percentile and rank_error: the value at rank ceil(p * n), surely off by no more ranks than that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            answers = [query(_unpack(*row), p) for row in zip(*(batch[f].to_pylist() for f, _ in _FIELDS)) for p in ps]
            at = pa.array(np.repeat(np.arange(len(batch)), len(ps)))
            columns = [batch[c].take(at) for c in (*by, "n")]
            columns += [pa.array(np.tile(ps, len(batch))), pa.array([a for a, _ in answers], pa.float64()), pa.array([e for _, e in answers], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*by, "n", "p", "percentile", "rank_error"])

    return summaries.mapInArrow(run, f"{_ddl(summaries, by)}n long, p double, percentile double, rank_error long")


def grouped_percentiles(
    df: DataFrame, by: Sequence[str], value: str, ps: Sequence[float], *, part_by: str | None = None, eps: float = 0.001
) -> DataFrame:
    """Percentiles per group; with ``part_by``, each part (such as a loading day) is summarised first and parts are combined.

    Columns: ``by``, n, p, percentile, rank_error (at most eps * n).

    Defined cases: null and NaN are no values, infinities are; a null in a group
    column is a group of its own, likewise a null part; ties count each; rows
    repeat as often as they occur; groups without values do not appear; an
    empty table gives an empty result; other columns are ignored.
    """
    parts = [*by, part_by] if part_by else list(by)
    summaries = summarise(df, parts, value, eps=eps)
    if part_by:
        summaries = combine(summaries, by, eps=eps, level=4)
    return percentiles(summaries, by, ps)
