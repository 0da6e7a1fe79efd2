"""Top N items within every group, by sorted runs and a loser-tree merge.

Each input partition becomes sorted runs, ordered by the group's slot (a hash), group, score
and ties, of which each group keeps its first N (nothing below can come out). Runs are
written as packed blocks. Their size gives the number of buckets of slots; blocks are cut at
the buckets' bounds, and a bucket's runs are merged by a loser tree, a bounded number of
them at a time; after N items of a group every run seeks to its next group. A group of
millions of items thus reaches its bucket as N items for each run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crosslake.functions.common import Scratch, ship

RUN_ROWS = 200_000
BLOCK_ROWS = 4096
SLOTS = 1 << 20
BUCKET_ROWS = 50_000  # of stored runs, on average
FAN_IN = 64  # runs that are merged at once
HEAD_ROWS = 256  # rows of a run whose keys are Python values at a time


class LoserTree:
    """A tournament over sorted runs: the winner is the least head; losers stay at the nodes, so a new head plays one path."""

    def __init__(self, heads: list) -> None:
        """heads: the first key of each run; None where a run is at its end."""
        self.k = max(1, len(heads))
        self.heads = list(heads) or [None]
        self.tree = [-1] * self.k
        winner = [0] * (2 * self.k)
        winner[self.k :] = range(self.k)
        for node in range(self.k - 1, 0, -1):
            a, b = winner[2 * node], winner[2 * node + 1]
            winner[node], self.tree[node] = (a, b) if self._before(a, b) else (b, a)
        self.tree[0] = winner[1] if self.k > 1 else 0

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None
        return (x, a) < (y, b)

    def winner(self) -> int:
        """The run with the least head, or -1 when all runs are at their ends."""
        w = self.tree[0]
        return w if self.heads[w] is not None else -1

    def replace(self, head: object) -> None:
        """The winner's run goes on with ``head``."""
        w = self.tree[0]
        self.heads[w] = head
        node = (w + self.k) // 2
        while node >= 1:
            if self._before(self.tree[node], w):
                self.tree[node], w = w, self.tree[node]
            node //= 2
        self.tree[0] = w


def _sorted(t: pa.Table, order: list[tuple[str, str]]) -> pa.Table:
    # nulls rank last in either direction
    return t.take(pc.sort_indices(t, sort_keys=order, null_placement="at_end"))


def _cut(t: pa.Table, n: int, keys: list[str]) -> pa.Table:
    """Of a sorted table: copies (all keys equal) once, then the first n rows of each group."""
    if not t.num_rows:
        return t
    codes = [t[c].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False) for c in keys]
    same_group = np.r_[False, codes[0][1:] == codes[0][:-1]]
    copy = same_group.copy()
    for c in codes[1:]:
        copy[1:] &= c[1:] == c[:-1]
    fresh = ~copy
    at = np.cumsum(fresh)
    rank = at - np.maximum.accumulate(np.where(~same_group, at, 0))
    return t.filter(pa.array(fresh & (rank < n)))


class _Run:
    """A sorted run: its table, where its groups start, and the keys of the few rows around the cursor as Python values."""

    def __init__(self, t: pa.Table, order: list[tuple[str, str]]) -> None:
        self.table, self.rows, self.order = t, t.num_rows, order
        self.base = self.stop = 0
        self.keys: list[tuple] = []
        change = np.zeros(max(0, self.rows - 1), bool)
        g = t[order[1][0]].combine_chunks()
        if self.rows > 1:
            change = pc.not_equal(g.slice(1), g.slice(0, self.rows - 1)).to_numpy(zero_copy_only=False)
        self.starts = np.r_[np.flatnonzero(change) + 1, self.rows]

    def next_group(self, i: int) -> int:
        return int(self.starts[np.searchsorted(self.starts, i, "right")])

    def head(self, i: int) -> tuple | None:
        """((slot, group), the other keys) of row ``i``, None at the end."""
        if i >= self.rows:
            return None
        if not self.base <= i < self.stop:
            part = self.table.slice(i, HEAD_ROWS)
            self.base, self.stop = i, i + part.num_rows
            columns = []
            for c, way in self.order:
                v = part[c]
                v = (v.cast(pa.int64()) if pa.types.is_timestamp(v.type) else v).to_pylist()
                columns.append([(True, 0) if x is None else (False, -x if way == "descending" else x) for x in v])
            self.keys = [(k[:2], k[2:]) for k in zip(*columns)]
        return self.keys[i - self.base]


def merge_runs(runs: list[pa.Table], n: int, order: list[tuple[str, str]]) -> pa.Table:
    """The first n rows of each group over runs that are each sorted by ``order`` (whose first keys are the slot and the group), with their rank."""
    cursors = [_Run(r, order) for r in runs]
    pos = [0] * len(runs)
    tree = LoserTree([c.head(0) for c in cursors])
    starts = np.cumsum([0, *[r.num_rows for r in runs]]).tolist()
    take, ranks = [], []
    group, got, last = None, 0, None
    while (w := tree.winner()) >= 0:
        g, key = tree.heads[w]
        if g != group:
            group, got, last = g, 0, None
        i = pos[w]
        if got >= n:
            i = cursors[w].next_group(i)
        else:
            if key != last:
                take.append(starts[w] + i)
                got, last = got + 1, key
                ranks.append(got)
            i += 1
        pos[w] = i
        tree.replace(cursors[w].head(i))
    out = pa.concat_tables(runs).take(pa.array(take, pa.int64()))
    return out.append_column("rank", pa.array(ranks, pa.int32()))


class _Merger:
    """Merges the runs of a bucket as they come, FAN_IN at a time, each time cut to n items a group; so what is held does not grow with the number of runs."""

    def __init__(self, n: int, order: list[tuple[str, str]]) -> None:
        self.n, self.order, self.levels = n, order, [[]]

    def add(self, run: pa.Table, level: int = 0) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == FAN_IN:
            some, self.levels[level] = self.levels[level], []
            self.add(merge_runs(some, self.n, self.order).drop_columns(["rank"]), level + 1)

    def end(self) -> pa.Table | None:
        runs, self.levels = [r for some in self.levels for r in some], [[]]
        return merge_runs(runs, self.n, self.order) if runs else None


def _packed(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    t = t.combine_chunks()
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(t)
    return sink.getvalue().to_pybytes()


def _unpacked(block: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(block.as_buffer()).read_all()


def _rankable(df: DataFrame, score: Column) -> Column:
    """NaN has no rank; it counts as null."""
    kind = df.select(score.alias("s")).schema["s"].dataType
    return F.when(~F.isnan(score), score) if isinstance(kind, (T.DoubleType, T.FloatType)) else score


def top_n(df: DataFrame, group: Column, n: int, score: Column, ties: list[Column], keep: dict[str, Column], run_rows: int = RUN_ROWS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The n rows of each group with the greatest score: group_key, rank (from 1), score and the columns of ``keep``.

    Ties go to the smaller values of ``ties``, in order; a null score or tie ranks last, NaN like null.
    Rows equal in group, score and all ties are copies and count once. Rows with a null
    group are left out. The score must be numeric; ties may be of any ordered type. The
    result is the same however the rows are partitioned. The runs are written first; their
    number of rows gives the number of buckets, of about ``bucket_rows`` each.
    """
    spark = df.sparkSession
    ship(spark)
    tie_names = [f"tie{i}" for i in range(len(ties))]
    if taken := {"group_key", "score", "slot", "rank", *tie_names} & set(keep):
        raise ValueError(f"Names of the result itself: {', '.join(sorted(taken))}")
    flat = df.select(group.cast("string").alias("group_key"), _rankable(df, score).alias("score"), *[t.alias(c) for t, c in zip(ties, tie_names)], *[c.alias(k) for k, c in keep.items()]).where("group_key is not null")
    fields = flat.schema.fields
    flat = flat.withColumn("slot", F.pmod(F.xxhash64("group_key"), F.lit(SLOTS)).cast("int"))
    order = [("slot", "ascending"), ("group_key", "ascending"), ("score", "descending"), *[(c, "ascending") for c in tie_names]]
    keys = [c for c, _ in order[1:]]

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: list[pa.Table] = []
        rows, made = 0, 0

        def cut() -> pa.Table:
            return _cut(_sorted(pa.concat_tables(held), order), n, keys)

        def stored(run: pa.Table) -> pa.RecordBatch:
            blocks = [run.slice(i, BLOCK_ROWS) for i in range(0, run.num_rows, BLOCK_ROWS)]
            number = (TaskContext.get().partitionId() << 32) + made
            columns = {"low": [b["slot"][0].as_py() for b in blocks], "high": [b["slot"][-1].as_py() for b in blocks], "n_rows": [b.num_rows for b in blocks], "run": [number] * len(blocks), "part": range(len(blocks)), "block": map(_packed, blocks)}
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns.values(), (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary()))], names=list(columns))

        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            rows += batch.num_rows
            if rows >= run_rows:
                run = cut()
                if run.num_rows > run_rows // 2:  # many groups: the run is full
                    yield stored(run)
                    held, rows, made = [], 0, made + 1
                else:
                    held, rows = [run], run.num_rows
        if rows:
            yield stored(cut())

    written = Scratch(spark, "topn").write(flat.mapInArrow(runs, "low int, high int, n_rows int, run bigint, part int, block binary"))
    buckets = min(SLOTS, max(1, -(-int(written.agg(F.sum("n_rows")).first()[0] or 0) // bucket_rows)))

    def divide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks cut where a bucket ends."""
        for batch in batches:
            out: list[tuple] = []
            for low, high, run, part, block in zip(*(batch.column(c).to_pylist() for c in ("low", "high", "run", "part")), batch.column("block")):
                if low * buckets // SLOTS == high * buckets // SLOTS:
                    out.append((low * buckets // SLOTS, run, part, block.as_py()))
                    continue
                t = _unpacked(block)
                b = t["slot"].to_numpy().astype(np.int64) * buckets // SLOTS
                at = np.r_[0, np.flatnonzero(np.diff(b)) + 1, len(b)]
                out += [(int(b[i]), run, part, _packed(t.slice(i, j - i))) for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out) if out else [()] * 4, (pa.int32(), pa.int64(), pa.int32(), pa.binary()))], names=["bucket", "run", "part", "block"])

    result = T.StructType([*fields, T.StructField("rank", T.IntegerType())])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come by bucket, run and part
        merger, now, blocks = _Merger(n, order), (None, None), []

        def finished() -> Iterator[pa.RecordBatch]:
            out = merger.end()
            if out is not None:
                yield from out.drop_columns(["slot"]).to_batches(max_chunksize=10_000)

        for batch in batches:
            for bucket, run, block in zip(batch.column("bucket").to_pylist(), batch.column("run").to_pylist(), batch.column("block")):
                if (bucket, run) != now:
                    if blocks:
                        merger.add(pa.concat_tables(blocks))
                    if bucket != now[0]:
                        yield from finished()
                    now, blocks = (bucket, run), []
                blocks.append(_unpacked(block))
        if blocks:
            merger.add(pa.concat_tables(blocks))
        yield from finished()

    divided = written.select("low", "high", "run", "part", "block").mapInArrow(divide, "bucket int, run bigint, part int, block binary")
    return divided.repartition("bucket").sortWithinPartitions("bucket", "run", "part").mapInArrow(merge, result).select("group_key", "rank", "score", *keep)
