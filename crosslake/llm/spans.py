"""Long exact spans shared between records.

Windows of half the asked length come first: of each stretch of the asked length the window
with the least hash (so every shared span keeps at least one window that both texts chose).
Only windows that repeat in another text are extended, by as much text as any window of
twice their length around them could use, and only windows of twice the length that repeat
are shared spans. ``shared_runs`` goes on doubling until no longer run repeats.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crosslake.functions.common import Scratch, checkpointed, ship

PIECE_BYTES = 1 << 20
GROUP_CONTEXTS = 4096  # contexts of one window that one task compares in memory; more are compared by a shuffle
PAIR_CHUNK = 1024  # texts of one class that one task pairs at once
_M = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a * _M[0]
    h += b * _M[1]
    h ^= h >> np.uint64(32)
    h *= _M[2]
    h ^= h >> np.uint64(29)
    return h


def window_hashes(codes: np.ndarray, width: int, second: bool = False) -> np.ndarray:
    """A 64-bit hash of each window of ``width`` code points, by doubling: a window is two windows of half its width. The second hash is independent of the first."""
    h, have = (codes.astype(np.uint64) + second) * _M[3 + second], 1
    h ^= h >> np.uint64(31)
    while have * 2 <= width:
        h, have = _mix(h[: len(h) - have], h[have:]), have * 2
    if have < width and len(h):
        step = width - have
        h = _mix(h[: max(0, len(h) - step)], h[step:])
    return h


def _least(h: np.ndarray, count: int) -> np.ndarray:
    """For each i the position of the least of h[i : i + count], the leftmost of equal ones."""
    v, at, have = h, np.arange(len(h), dtype=np.int64), 1
    while have < count:
        step = min(have, count - have)
        right = v[step:] < v[: len(v) - step]
        v, at = np.where(right, v[step:], v[: len(v) - step]), np.where(right, at[step:], at[: len(at) - step])
        have += step
    return at


def chosen_windows(codes: np.ndarray, lengths: np.ndarray, span: int, width: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, position in it, hash) of the windows of ``width`` (span // 2 by default) that are least in some stretch of ``span``."""
    none = np.zeros(0, np.int64)
    if len(codes) < span:
        return none, none, none.astype(np.uint64)
    half = width or span // 2
    h = window_hashes(codes, half)
    at = _least(h, span - half + 1)  # for each start of a stretch
    ends = np.cumsum(lengths)
    ok = np.zeros(len(codes) + 1, np.int64)
    long = lengths >= span
    np.add.at(ok, (ends - lengths)[long], 1)
    np.add.at(ok, (ends - span + 1)[long], -1)
    at = at[np.cumsum(ok)[: len(at)] > 0]
    at = at[np.r_[True, at[1:] != at[:-1]]] if len(at) else at
    text = np.searchsorted(ends, at, "right")
    return text, at - (ends - lengths)[text], h[at]


def _coded(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, code points of some rows together, their lengths), about PIECE_BYTES at a time."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    cut = np.flatnonzero(np.diff(np.cumsum(size) // PIECE_BYTES)) + 1
    for a, b in zip(np.r_[0, cut], np.r_[cut, len(size)]):
        part = texts.slice(int(a), int(b - a)).to_pylist()
        if part:
            coded = "".join(x for x in part if x).encode("utf-32-le", "surrogatepass")
            yield int(a), np.frombuffer(coded, np.uint32), np.array([len(x) if x else 0 for x in part], np.int64)


def _windows_of(docs: DataFrame, span: int) -> DataFrame:
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, codes, lengths in _coded(b.column(1)):
                text, pos, h = chosen_windows(codes, lengths, span)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), b.column(0).take(pa.array(text + first)), pa.array(pos, pa.int32())], names=["h", "id", "pos"])

    return docs.mapInArrow(run, f"h bigint, id {kind}, pos int")


def _contexts_of(docs: DataFrame, hits: DataFrame, span: int) -> DataFrame:
    """Around each repeated window the text that windows of ``span`` over it can use: h, id, pos, left (text before the window), ctx."""
    kind = docs.schema["id"].dataType.simpleString()
    half, reach = span // 2, span - span // 2
    per_text = hits.groupBy("id").agg(F.collect_list(F.struct("h", "pos")).alias("hits"))  # at most one text's own windows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(0, b.num_rows, 500):
                s = b.slice(r, 500)
                texts, lists = s.column(1).to_pylist(), s.column(2)
                owner = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
                flat = lists.flatten()
                pos = flat.field("pos").to_numpy()
                ctx = [texts[o][max(0, p - reach) : p + half + reach] for o, p in zip(owner.tolist(), pos.tolist())]
                yield pa.RecordBatch.from_arrays([flat.field("h"), s.column(0).take(pa.array(owner)), pa.array(pos, pa.int32()), pa.array(np.minimum(pos, reach), pa.int32()), pa.array(ctx, pa.string())], names=["h", "id", "pos", "left", "ctx"])

    return docs.join(per_text, "id").select("id", "text", "hits").mapInArrow(run, f"h bigint, id {kind}, pos int, left int, ctx string")


def _long_windows(t: pa.Table, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start relative to the half window, two hashes) of all windows of ``span`` in the contexts."""
    rows, starts, hashes, seconds = [], [], [], []
    left = t["left"].to_numpy()
    for first, codes, lengths in _coded(t["ctx"].combine_chunks()):
        w, v = window_hashes(codes, span), window_hashes(codes, span, True)
        n = np.maximum(0, lengths - span + 1)
        begin = np.cumsum(lengths) - lengths
        row = np.repeat(np.arange(len(lengths)), n)
        off = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        rows.append(row + first)
        starts.append(off - left[first + row])
        hashes.append(w[begin[row] + off])
        seconds.append(v[begin[row] + off])
    cat = lambda x, d: np.concatenate(x) if x else np.zeros(0, d)
    return cat(rows, np.int64), cat(starts, np.int64), cat(hashes, np.uint64), cat(seconds, np.uint64)


def _compare(t: pa.Table, span: int) -> Iterator[pa.RecordBatch]:
    """Repeated windows of ``span`` in whole groups of contexts: their classes, and which part of each context they cover.

    Windows are equal when half window, place and both hashes are; one mix of these is sorted,
    and all of them only where the mix alone would not keep equal windows together.
    """
    row, rel, one, two = _long_windows(t, span)
    if not len(row):
        return
    half = t["h"].to_numpy().view(np.uint64)[row]
    key = _mix(one ^ half, rel.view(np.uint64) + two)
    order = np.argsort(key, kind="stable")
    changed = lambda x: x[order[1:]] != x[order[:-1]]
    differ = changed(half) | changed(rel) | changed(one) | changed(two)
    if (differ & ~changed(key)).any():
        order = np.lexsort((rel, two, one, half))
        differ = changed(half) | changed(rel) | changed(one) | changed(two)
    row, rel, two = row[order], rel[order], two[order]
    cls = np.cumsum(np.r_[True, differ]) - 1
    begin = np.flatnonzero(np.r_[True, differ])
    lo = np.minimum.reduceat(t["lo"].to_numpy()[row], begin)
    hi = np.maximum.reduceat(t["hi"].to_numpy()[row], begin)
    repeated = (lo < hi)[cls]
    row, rel, cls = row[repeated], rel[repeated], cls[repeated]
    if not len(row):
        return
    # classes of the same contexts are one
    half = t["h"].to_numpy().view(np.uint64)[row]
    salt = _mix(row.astype(np.uint64), half)
    begin = np.flatnonzero(np.r_[True, cls[1:] != cls[:-1]])
    count = np.diff(np.r_[begin, len(cls)])
    mark = np.add.reduceat(salt, begin), np.add.reduceat(_mix(salt, half), begin)
    by = np.lexsort(mark)
    fresh = np.r_[True, (mark[0][by[1:]] != mark[0][by[:-1]]) | (mark[1][by[1:]] != mark[1][by[:-1]])]
    pick = np.zeros(len(begin), bool)
    pick[by[fresh]] = True
    kept = np.repeat(pick, count)
    names = ("h", "left", "ck")
    member = t.select(names).take(pa.array(row[kept])).combine_chunks()
    ck, left = t["ck"].to_numpy().view(np.uint64)[row], t["left"].to_numpy().astype(np.uint64)[row]
    seen = [np.repeat(np.add.reduceat(_mix(ck + np.uint64(i), left), begin), count)[kept] for i in (0, 1)]
    null = lambda n: pa.nulls(n, pa.int32())
    for i, x in enumerate(seen):
        member = member.append_column(f"cls{i}", pa.array(_mix(x, half[kept]).view(np.int64)))
    yield from member.append_column("a", null(len(member))).append_column("b", null(len(member))).to_batches()
    order = np.lexsort((rel, row))
    row, rel = row[order], rel[order]
    gap = np.r_[True, (row[1:] != row[:-1]) | (rel[1:] > rel[:-1] + 1)]
    begin, end = np.flatnonzero(gap), np.r_[np.flatnonzero(gap)[1:], len(row)] - 1
    part = t.select(names).take(pa.array(row[begin])).combine_chunks()
    cover = part.append_column("cls0", pa.nulls(len(begin), pa.int64())).append_column("cls1", pa.nulls(len(begin), pa.int64())).append_column("a", pa.array(rel[begin], pa.int32())).append_column("b", pa.array(rel[end] + span, pa.int32()))
    yield from cover.to_batches()


def _small_groups(contexts: DataFrame, span: int) -> DataFrame:
    """Compares contexts of the same half window; each partition is read in order of the windows, some whole groups at a time."""
    schema = "h bigint, left int, ck bigint, cls0 bigint, cls1 bigint, a int, b int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            rows += batch.num_rows
            if rows >= 4 * GROUP_CONTEXTS:
                t = pa.concat_tables(held).combine_chunks()
                h = t["h"].to_numpy()
                whole = int(np.searchsorted(h, h[-1]))  # the last group may go on
                if whole:
                    yield from _compare(t.slice(0, whole).combine_chunks(), span)
                held, rows = [t.slice(whole)], len(h) - whole
        if rows:
            yield from _compare(pa.concat_tables(held).combine_chunks(), span)

    return contexts.select("h", "left", "ck", "ctx", "lo", "hi").repartition("h").sortWithinPartitions("h").mapInArrow(run, schema)


def _large_groups(contexts: DataFrame, span: int) -> DataFrame:
    """The same for windows with very many contexts: every window of ``span`` is a row, and a shuffle finds the repeated ones."""
    schema = "h bigint, left int, ck bigint, lo bigint, hi bigint, rel int, w bigint, v bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(0, batch.num_rows, 2000):
                t = pa.Table.from_batches([batch.slice(r, 2000)])
                row, rel, one, two = _long_windows(t, span)
                out = t.select(["h", "left", "ck", "lo", "hi"]).take(pa.array(row)).append_column("rel", pa.array(rel, pa.int32()))
                out = out.append_column("w", pa.array(one.view(np.int64))).append_column("v", pa.array(two.view(np.int64)))
                yield from out.to_batches()

    rows = contexts.select("h", "left", "ck", "ctx", "lo", "hi").mapInArrow(run, schema)
    mark, at = F.xxhash64("left", "ck"), ["h", "rel", "w", "v"]
    classes = rows.groupBy(*at).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.bit_xor(mark).alias("m1"), F.bit_xor(F.xxhash64(mark, F.lit(1))).alias("m2"), F.count(F.lit(1)).alias("n")).where("lo < hi")
    one = classes.groupBy("h", "m1", "m2", "n").agg(F.min(F.struct("rel", "w", "v")).alias("o")).select("h", "o.*")
    null = F.lit(None)
    member = rows.join(one, at).select("h", "left", "ck", F.xxhash64(*at).alias("cls0"), F.xxhash64(*at, F.lit(1)).alias("cls1"), null.cast("int").alias("a"), null.cast("int").alias("b"))
    cover = rows.join(classes.select(*at), at).select("h", "left", "ck", null.cast("bigint").alias("cls0"), null.cast("bigint").alias("cls1"), F.col("rel").alias("a"), (F.col("rel") + span).alias("b"))
    return member.unionByName(cover)


class SharedSpans:
    """The spans of at least ``span`` code points that lie word for word in more than one text.

    docs needs ``id_col`` (unique, of an integral type) and ``text_col``; other columns play
    no part. Null texts and texts shorter than ``span`` share nothing; a span repeated only
    within one text is not shared. Texts are compared exactly as they stand. Windows are
    equal when two independent 64-bit hashes of them are, and that of their half besides.
    """

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, span: int = 200) -> None:
        if span < 2:
            raise ValueError("span must be at least 2")
        ship(docs.sparkSession)
        self.docs = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where("id is not null")
        self.span, self.scratch = span, Scratch(docs.sparkSession, "spans")
        long = self.docs.where(F.length("text") >= span)
        windows = self.scratch.write(_windows_of(long, span))  # read twice, made once
        again = windows.groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("h")
        hits = windows.join(again, "h")
        self.places = self.scratch.write(_contexts_of(long, hits, span).withColumn("ck", F.xxhash64("ctx")))
        contexts = self.places.groupBy("h", "left", "ck", "ctx").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
        contexts = self.scratch.write(contexts)
        many = contexts.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP_CONTEXTS).select("h")
        small = _small_groups(contexts.join(many, "h", "left_anti"), span)
        large = _large_groups(contexts.join(many, "h", "left_semi"), span)
        self.found = self.scratch.write(small.unionByName(large))

    def classes(self) -> DataFrame:
        """The pairs in a form that does not grow with their square: cls0, cls1 (a class's two numbers), id, n (texts of the class).

        The texts of a class all share one span, and each two texts that share a span stand
        in some class together; a text can stand in several. Classes of the same texts are one.
        """
        at, cls = ["h", "left", "ck"], ["cls0", "cls1"]
        member = self.found.where("cls0 is not null").select(*at, *cls).join(self.places.select(*at, "id"), at).select(*cls, "id").distinct()
        member = self.scratch.write(member)
        marks = member.groupBy(*cls).agg(F.bit_xor(F.xxhash64("id")).alias("m1"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("m2"), F.count(F.lit(1)).alias("n"))
        one = marks.groupBy("m1", "m2", "n").agg(F.min(F.struct(*cls)).alias("o")).select("o.*", "n")
        return member.join(one, cls)

    def pairs(self) -> DataFrame:
        """Each two texts that share a span: id_a < id_b.

        The result itself is quadratic in the texts of one span; a class of many texts is
        divided into chunks, and each two chunks are paired by themselves.
        """
        cls = ["cls0", "cls1"]
        m = self.classes().withColumn("chunks", F.ceil(F.col("n") / PAIR_CHUNK)).withColumn("c", F.pmod(F.xxhash64("id", F.lit(2)), "chunks"))
        a = m.select(*cls, F.col("id").alias("x"), F.col("c").alias("c1"), F.explode(F.sequence("c", F.col("chunks") - 1)).alias("c2"))
        b = m.select(*cls, F.col("id").alias("y"), F.col("c").alias("c2"), F.explode(F.sequence(F.lit(0).cast("bigint"), "c")).alias("c1"))
        both = a.join(b, [*cls, "c1", "c2"]).where((F.col("c1") < F.col("c2")) | (F.col("x") < F.col("y")))
        return both.where("x <> y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()

    def spans(self) -> DataFrame:
        """The longest stretches of each text of which every character lies in a shared span: id, start, end (exclusive)."""
        at = ["h", "left", "ck"]
        cover = self.found.where("cls0 is null").join(self.places.select(*at, "id", "pos"), at).select("id", (F.col("pos") + F.col("a")).alias("start"), (F.col("pos") + F.col("b")).alias("end"))
        return _merged(cover)

    def shares(self) -> DataFrame:
        """Every text with its length, its shared characters and their share (0 for empty and null texts): id, n_chars, shared_chars, share."""
        per = self.spans().groupBy("id").agg(F.sum(F.col("end") - F.col("start")).alias("shared"))
        n = F.coalesce(F.length("text"), F.lit(0))
        got = self.docs.select("id", n.alias("n_chars")).join(per, "id", "left").withColumn("shared_chars", F.coalesce("shared", F.lit(0)))
        return got.select("id", "n_chars", "shared_chars", F.when(F.col("n_chars") > 0, F.col("shared_chars") / F.col("n_chars")).otherwise(0.0).alias("share"))


def _common(a: str, b: str) -> int:
    """The length of the common start of two texts."""
    have, most = 0, min(len(a), len(b))
    while have < most:
        step = (most - have + 1) // 2
        if a[have : have + step] == b[have : have + step]:
            have += step
        else:
            most = have + step - 1
    return have


def extents(before: list[str], after: list[str], lo: list[int], hi: list[int]) -> Iterator[tuple[int, int, int]]:
    """(context, left, right): how far each context agrees with one of another text, only where no other agreement reaches further on both sides.

    ``before`` are the texts to the left read backwards, ``after`` those to the right; each
    context stands in the texts ``lo`` to ``hi``. Contexts are joined by falling agreement to
    the left; within what is joined the neighbours in order of ``after`` agree furthest.
    """
    n = len(after)
    alone = [lo[x] == hi[x] for x in range(n)]
    yield from ((x, len(before[x]), len(after[x])) for x in range(n) if not alone[x])
    if n < 2:
        return
    right = sorted(range(n), key=after.__getitem__)
    rank = [0] * n
    for i, x in enumerate(right):
        rank[x] = i
    left = sorted(range(n), key=before.__getitem__)
    reach = [_common(before[left[i]], before[left[i + 1]]) for i in range(n - 1)]
    best, points = [-1] * n, [[] for _ in range(n)]
    owner, groups = list(range(n)), [[rank[x]] for x in left]  # by place in ``left``: the groups of joined neighbours

    def group(i: int) -> int:
        while owner[i] != i:
            owner[i] = owner[owner[i]]
            i = owner[i]
        return i

    def of_one(x: int, y: int) -> bool:
        return alone[x] and alone[y] and lo[x] == lo[y]

    def meet(x: int, y: int, a: int) -> None:
        if not alone[x] or of_one(x, y):
            return
        r = _common(after[x], after[y])
        if r > best[x]:
            best[x] = r
            if points[x] and points[x][-1][0] == a:
                points[x].pop()
            points[x].append((a, r))

    for i in sorted(range(n - 1), key=lambda i: -reach[i]):
        a, b = group(i), group(i + 1)
        small, large = (a, b) if len(groups[a]) < len(groups[b]) else (b, a)
        ranks = groups[large]
        for k in groups[small]:
            at, x = bisect_left(ranks, k), right[k]
            for way in (range(at - 1, -1, -1), range(at, len(ranks))):
                near, seek, serve = None, True, True
                for j in way:
                    y = right[ranks[j]]
                    near = y if near is None else near
                    if serve := serve and (y == near or of_one(y, near)):  # no other text lies between y and x
                        meet(y, x, reach[i])
                    if seek:
                        meet(x, y, reach[i])
                        seek = of_one(x, y)
                    if not seek and not serve:
                        break
        if 8 * len(groups[small]) < len(ranks):
            for k in groups[small]:
                insort(ranks, k)
        else:
            groups[large] = sorted(ranks + groups[small])
        groups[small], owner[small] = [], large
    for x in range(n):
        for a, r in points[x]:
            yield x, a, r


def _run_windows(parts: DataFrame, span: int, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, codes, lengths in _coded(b.column(2)):
                text, pos, h = chosen_windows(codes, lengths, span, width)
                at = pa.array(text + first)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), b.column(0).take(at), b.column(1).take(at), pa.array(pos, pa.int32())], names=["h", "id", "off", "pos"])

    return parts.select("id", "off", "text").mapInArrow(run, "h bigint, id bigint, off int, pos int")


def _run_contexts(parts: DataFrame, hits: DataFrame, span: int, width: int) -> DataFrame:
    """Around each repeated window the text that runs shorter than twice ``span`` can use: h, id, pos (in the whole text), left, ctx."""
    reach = 2 * span - width
    per_part = hits.groupBy("id", "off").agg(F.collect_list(F.struct("h", "pos")).alias("hits"))  # at most one text's own windows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(0, b.num_rows, 100):
                s = b.slice(r, 100)
                texts, lists = s.column(2).to_pylist(), s.column(3)
                owner = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
                flat = lists.flatten()
                pos, off = flat.field("pos").to_numpy(), s.column(1).to_numpy()
                for c in range(0, len(pos), 2000):
                    o, p = owner[c : c + 2000], pos[c : c + 2000]
                    ctx = [texts[i][max(0, q - reach) : q + width + reach] for i, q in zip(o.tolist(), p.tolist())]
                    yield pa.RecordBatch.from_arrays([flat.field("h").slice(c, 2000), s.column(0).take(pa.array(o)), pa.array(p + off[o], pa.int32()), pa.array(np.minimum(p, reach), pa.int32()), pa.array(ctx, pa.string())], names=["h", "id", "pos", "left", "ctx"])

    return parts.join(per_part, ["id", "off"]).select("id", "off", "text", "hits").mapInArrow(run, "h bigint, id bigint, pos int, left int, ctx string")


def _runs_of(contexts: DataFrame, span: int, width: int) -> DataFrame:
    """The runs of at least ``span`` over each repeated window, cut off where the contexts end; all contexts of one window meet in one task, so windows of many places have ``_runs_of_many``."""

    def whole(rows: list[tuple]) -> Iterator[tuple[int, int, int]]:
        same: dict[tuple[int, str], list[tuple[int, int]]] = {}
        for id_, pos, left, ctx in rows:
            same.setdefault((left, ctx), []).append((id_, pos))
        ids = [[i for i, _ in m] for m in same.values()]
        before, after = [c[:k][::-1] for k, c in same], [c[k:] for k, c in same]
        members = list(same.values())
        for x, a, r in extents(before, after, [min(i) for i in ids], [max(i) for i in ids]):
            if r >= width and a + r >= span:
                yield from ((id_, pos - a, pos + r) for id_, pos in members[x])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, rows, out = None, [], set()
        for b in batches:
            for key, *row in zip(*[c.to_pylist() for c in b.columns]):
                if key != h:
                    out.update(whole(rows))
                    h, rows = key, []
                    if len(out) > 50_000:
                        yield _run_batch(out)
                        out = set()
                rows.append(tuple(row))
        out.update(whole(rows))
        yield _run_batch(out)

    return contexts.select("h", "id", "pos", "left", "ctx").repartition("h").sortWithinPartitions("h").mapInArrow(run, 'id bigint, start int, end int')


def _left_marks(contexts: DataFrame, span: int) -> DataFrame:
    """Two hashes of each context's last ``a`` code points before the window, for every ``a`` with which a run of ``span`` fits: h, left, ck, lo, hi, a, w, v."""
    schema = "h bigint, left int, ck bigint, lo bigint, hi bigint, a int, w bigint, v bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(0, batch.num_rows, 500):
                part = batch.slice(r, 500)
                lefts = part.column("left").to_numpy().astype(np.int64)
                for first, codes, lengths in _coded(part.column("ctx")):
                    left = lefts[first : first + len(lengths)]
                    low = np.maximum(0, span - (lengths - left))
                    count = np.maximum(0, left - low + 1)
                    owner = np.repeat(np.arange(len(lengths)), count)
                    a = low[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
                    at = (np.cumsum(lengths) - lengths + left)[owner]  # where the window begins
                    size = np.int64(1) << np.floor(np.log2(np.maximum(a, 1))).astype(np.int64)
                    marks = [np.zeros(len(a), np.uint64), np.zeros(len(a), np.uint64)]
                    for j in np.unique(size[a > 0]).tolist():
                        here = (size == j) & (a > 0)
                        for i, mark in enumerate(marks):
                            w = window_hashes(codes, j, bool(i))
                            mark[here] = _mix(w[(at - a)[here]], w[(at - j)[here]])
                    out = part.select(["h", "left", "ck", "lo", "hi"]).take(pa.array(first + owner))
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.array(a, pa.int32()), *[pa.array(m.view(np.int64)) for m in marks]], names=["h", "left", "ck", "lo", "hi", "a", "w", "v"])

    return contexts.mapInArrow(run, schema)


_EDGE = tuple  # (class, text, tag): a sorted row; the tag is its only text's id, None if it stands in several


class _Near:
    """The last row of a sorted class and the last one of another text: one of them is the nearest that lies in another text than a given row."""

    def __init__(self, one: _EDGE | None = None, two: _EDGE | None = None) -> None:
        self.one, self.two = one, two

    def add(self, row: _EDGE) -> None:
        if self.one is None or self.one[0] != row[0]:
            self.one, self.two = row, None
        elif row[2] is None or self.one[2] != row[2]:
            self.one, self.two = row, self.one
        else:
            self.one = row

    def of(self, row: _EDGE) -> int:
        """How far the row agrees with it."""
        for x in (self.one, self.two):
            if x is not None and x[0] == row[0] and (x[2] is None or x[2] != row[2]):
                return _common(x[1], row[1])
        return 0


def _agreements(sorted_rows: DataFrame) -> DataFrame:
    """Of each row of a class the longest agreement of its text with one of another text: its keys and r.

    The rows are sorted by class and text in fixed partitions, so those that agree furthest
    are neighbours; the first and last rows of the partitions are told to the others first.
    """
    keys, schema = ["h", "a", "w", "v", "t1", "t2"], "h bigint, a int, w bigint, v bigint, t1 bigint, t2 bigint, r int"

    def rows(b: pa.RecordBatch) -> Iterator[_EDGE]:
        for h, a, w, v, text, lo, hi in zip(*[b.column(c).to_pylist() for c in ("h", "a", "w", "v", "right", "lo", "hi")]):
            yield (h, a, w, v), text, lo if lo == hi else None

    def pack(near: _Near) -> list[bytes | None]:
        return [None if x is None else pickle.dumps(x) for x in (near.one, near.two)]

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        head, tail, done = _Near(), _Near(), False
        for b in batches:
            for row in rows(b):
                tail.add(row)
                if head.one is None:
                    head.one = row
                elif not done:
                    if row[0] != head.one[0]:
                        done = True
                    elif row[2] is None or row[2] != head.one[2]:
                        head.two, done = row, True
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), *[pa.array([x], pa.binary()) for x in (*pack(head), *pack(tail))]], names=["p", "h1", "h2", "t1", "t2"])

    found = sorted_rows.mapInArrow(edges, "p int, h1 binary, h2 binary, t1 binary, t2 binary").collect()  # a row for each partition
    load = lambda x: None if x is None else pickle.loads(x)  # noqa: E731, S301 - own rows
    parts = [(r.p, [load(x) for x in (r.h1, r.h2, r.t2, r.t1)]) for r in sorted(found, key=lambda r: r.p)]
    before, after = {}, {}
    for out, order, way in ((before, parts, (2, 3)), (after, parts[::-1], (1, 0))):
        near = _Near()
        for p, ends in order:
            out[p] = (near.one, near.two)
            for i in way:
                if ends[i] is not None:
                    near.add(ends[i])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        p = TaskContext.get().partitionId()
        back, coming = _Near(*before.get(p, (None, None))), _Near(*after.get(p, (None, None)))
        waiting: list[tuple[tuple, _EDGE, int]] = []  # rows of one class and one text, whose next neighbour is still to come
        out: list[tuple] = []

        def settle(nxt: _EDGE | None) -> None:
            for key, row, r in waiting:
                other = _common(nxt[1], row[1]) if nxt is not None and nxt[0] == row[0] else 0
                out.append((*key, max(r, other)))
            waiting.clear()

        for b in batches:
            marks = zip(*[b.column(c).to_pylist() for c in keys])
            for key, row in zip(marks, rows(b)):
                if waiting and (waiting[0][1][0] != row[0] or row[2] is None or row[2] != waiting[0][1][2]):
                    settle(row)
                if row[2] is None:  # the same text stands elsewhere as a whole
                    out.append((*key, len(row[1])))
                else:
                    waiting.append((key, row, back.of(row)))
                back.add(row)
            if len(out) > 20_000:
                yield _table_of(out, schema)
                out = []
        for key, row, r in waiting:
            out.append((*key, max(r, coming.of(row))))
        yield _table_of(out, schema)

    return sorted_rows.mapInArrow(run, schema)


def _table_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32()}
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def _runs_of_many(places: DataFrame, span: int, width: int, scratch: Scratch) -> DataFrame:
    """The same for windows with very many contexts, by shuffles and sorts that divide them.

    Contexts that agree in the last ``a`` code points before the window are a class. Only the
    greatest ``a`` of equal classes of a context counts. Within a class the texts from the
    window on are sorted, and neighbours agree furthest.
    """
    at, cls = ["h", "left", "ck"], ["h", "a", "w", "v"]
    contexts = scratch.write(places.groupBy(*at, "ctx").agg(F.min("id").alias("lo"), F.max("id").alias("hi")))
    marks = scratch.write(_left_marks(contexts, span))
    classes = marks.groupBy(*cls).agg(F.min("lo").alias("least"), F.max("hi").alias("most"), F.count(F.lit(1)).alias("n")).where("least < most")
    met = marks.join(classes.select(*cls, "n"), cls)
    w = Window.partitionBy(*at).orderBy("a")  # one context's own classes
    nxt = F.when(F.lead("a").over(w) == F.col("a") + 1, F.lead("n").over(w))
    last = met.withColumn("next", nxt).where("next is null or next < n").select(*at, "a", "w", "v")
    right = F.expr("substring(ctx, left + 1)")
    members = last.join(contexts.select(*at, right.alias("right"), "lo", "hi"), at).withColumns({"t1": F.xxhash64("right"), "t2": F.xxhash64("right", F.lit(1))})
    members = scratch.write(members)
    texts = members.groupBy(*cls, "t1", "t2").agg(F.first("right").alias("right"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    order = [*cls, "right"]
    far = _agreements(checkpointed(texts.repartitionByRange(*order).sortWithinPartitions(*order)))
    runs = members.select(*at, *cls[1:], "t1", "t2").join(far.where((F.col("r") >= width) & (F.col("a") + F.col("r") >= span)), [*cls, "t1", "t2"]).select(*at, "a", "r")
    return places.select(*at, "id", "pos").join(runs, at).select("id", (F.col("pos") - F.col("a")).alias("start"), (F.col("pos") + F.col("r")).alias("end")).distinct()


def _run_batch(runs: set[tuple[int, int, int]]) -> pa.RecordBatch:
    cols = list(zip(*runs)) if runs else [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32())], names=["id", "start", "end"])


def _merged(runs: DataFrame) -> DataFrame:
    """Overlapping or touching stretches of each text as one."""
    w = Window.partitionBy("id").orderBy("start", "end")  # one text's own spans
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = runs.withColumn("new", (reach.isNull() | (F.col("start") > reach)).cast("int"))
    return new.withColumn("k", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("id", "k").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("k")


def shared_runs(docs: DataFrame, id_col: str, text_col: str, span: int = 200) -> DataFrame:
    """The longest runs of each text that lie as a whole in another text: id, start, end (exclusive).

    A run is reported where it cannot grow on either side and still lie in one other text;
    runs may overlap. Level by level the runs of ``span`` to twice, twice to four times
    ``span`` and so on are found exactly; only stretches under longer runs go to the next
    level, until there are none. Nulls and short texts as in SharedSpans.
    """
    if span < 2:
        raise ValueError("span must be at least 2")
    ship(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "runs")
    long = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull() & (F.length("text") >= span))
    parts, level, width, found = long.select("id", F.lit(0).alias("off"), "text"), span, span // 2, []
    while True:
        windows = scratch.write(_run_windows(parts, level, width))
        again = windows.groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("places")).where("lo < hi")
        many = F.col("places") > GROUP_CONTEXTS
        runs = _runs_of(_run_contexts(parts, windows.join(again.where(~many).select("h"), "h"), level, width), level, width)
        hot = windows.join(again.where(many).select("h"), "h")
        if not hot.isEmpty():
            places = scratch.write(_run_contexts(parts, hot, level, width).withColumn("ck", F.xxhash64("ctx")))
            runs = runs.unionByName(_runs_of_many(places, level, width, scratch))
        runs = scratch.write(runs)
        longer = F.col("end") - F.col("start") >= 2 * level
        found.append(runs.where(~longer))
        rest = runs.where(longer)
        if rest.isEmpty():
            break
        cut = _merged(rest)
        parts = scratch.write(long.join(cut, "id").select("id", F.col("start").alias("off"), F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")).alias("text")))
        level *= 2
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    w = Window.partitionBy("id").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)  # one text's own runs
    reach = F.max("end").over(w)
    return every.withColumn("reach", reach).where("reach is null or end > reach").drop("reach")
