"""Mixing sources to target weights: complete epochs, then a weighted fraction without replacement.

The fraction is an Efraimidis–Spirakis sample: each document has an exponential key divided
by its quality weight, and the documents with the least keys are taken until the source's
budget of tokens is full. The order of keys is never sorted as a whole: sums over ever
finer histograms locate the cut, only its last bin is sorted, and every document then tells
by its own key on which side of the cut it lies.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosslake.functions.common import local_rows

MOST_TARGETS = 10_000
SEED = 7
COARSE, FINE = 256, 4096
SORTED = 10_000  # documents of a bin that are sorted without a finer histogram
GAP_SHARE, FILL = 0.001, 200


@dataclass(frozen=True)
class Plan:
    """What one source is to give."""

    source: str
    target_share: float
    max_repeats: int
    tokens: int
    budget: int
    epochs: int
    rest: int


def source_name(c: Column) -> Column:
    """Sources are the same when they are equal without blanks around them, in lower case, with underscores for hyphens."""
    return F.regexp_replace(F.lower(F.trim(c)), "-", "_")


def make_plan(targets: list[tuple[str, float, int]], tokens: dict[str, int], total: int | None = None) -> list[Plan]:
    """The budget of each source out of ``total`` tokens.

    By default the total is the largest at which every source with texts reaches its share
    within its cap. With a larger total, capped sources fall short and the report shows it.
    A source without texts gives nothing.
    """
    live = [(s, share, cap) for s, share, cap in targets if tokens.get(s, 0) > 0 and share > 0 and cap > 0]
    if total is None:
        total = int(min((tokens[s] * cap / share for s, share, cap in live), default=0))
    out = []
    for s, share, cap in targets:
        have = tokens.get(s, 0)
        budget = round(share * total) if have and share > 0 else 0
        epochs = min(max(cap, 0), budget // have) if have else 0
        rest = budget - epochs * have if epochs < cap else 0
        out.append(Plan(s, share, cap, have, budget, int(epochs), int(max(0, rest))))
    return out


def exponential_key(id_col: Column, weight: Column, seed: int = SEED) -> Column:
    """-ln(u) / weight with u uniform in (0, 1] by a hash of the id. Null weights and weights of 0 or less come last, in random order."""
    u = (F.shiftrightunsigned(F.xxhash64(id_col, F.lit(seed)), 11) + 1) / F.lit(float(1 << 53))
    return F.when(weight > 0, -F.log(u) / weight).otherwise(F.lit(1e300) * (1 + u))


def _cut_bins(part: DataFrame, bin_: Column, start: DataFrame) -> list:
    """The bin of each source in which its running sum reaches ``rest``: source, bin, rest, before (the sum up to it), the bin's extremes of the keys and its documents.

    start: source, rest, before. Bins are few for each source.
    """
    bins = part.groupBy("source", bin_.alias("b")).agg(F.sum("n_tokens").alias("size"), F.min("key").alias("low"), F.max("key").alias("high"), F.count(F.lit(1)).alias("documents"))
    w = Window.partitionBy("source").orderBy("b")
    run = bins.withColumn("run", F.sum("size").over(w)).join(F.broadcast(start), "source")  # a row for each target
    met = run.withColumn("before", F.col("before") + F.col("run") - F.col("size")).where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("size") >= F.col("rest")))
    return met.groupBy("source").agg(F.min_by(F.struct("b", "rest", "before", "low", "high", "documents"), "b").alias("c")).select("source", "c.*").collect()  # a row for each target


_CUT = "source string, b bigint, rest bigint, before bigint, low double, high double, documents bigint"


def _find_cuts(part: DataFrame, rests: DataFrame) -> list[tuple]:
    """(source, key, spread, id, sum) of the last document of each source that the budget holds in the order of key, spread and id.

    A coarse histogram over the logarithms of the keys, a finer one over the keys of its bin
    and, where these are all equal, one over the spread (a hash of the id) locate the cut, as
    far as the bins have more than SORTED documents; the last bin's documents are sorted.
    Where not even the last bin's first document fits, the cut has no id and lies before it.
    """
    spark = part.sparkSession
    coarse = F.floor(F.log2(F.greatest("key", F.lit(1e-300))) * COARSE).cast("bigint")
    at = _cut_bins(part, coarse, rests.withColumn("before", F.lit(0).cast("bigint")))
    columns = ["source", "id", "n_tokens", "key", "spread"]
    found = local_rows(spark, at, _CUT)
    many = lambda: any(r.documents > SORTED for r in at)
    fine = F.when(F.col("high") > F.col("low"), F.floor((F.col("key") - F.col("low")) / (F.col("high") - F.col("low")) * FINE)).otherwise(F.lit(0)).cast("bigint")
    kept = part.join(F.broadcast(found.select("source", "b", "low", "high")), "source").where(coarse == F.col("b")).withColumn("bin", fine).select(*columns, "bin")
    if many():
        at = _cut_bins(kept, F.col("bin"), found.select("source", "rest", "before"))
        found = local_rows(spark, at, _CUT)
        kept = kept.join(F.broadcast(found.select("source", "b", "low", "high")), "source").where("bin = b")
    if many() and any(r.low == r.high for r in at):
        kept = kept.withColumn("bin", F.when(F.col("low") == F.col("high"), F.shiftright("spread", 52 - 12)).otherwise(F.lit(0).cast("bigint"))).select(*columns, "bin")
        at = _cut_bins(kept, F.col("bin"), found.select("source", "rest", "before"))
        found = local_rows(spark, at, _CUT)
        kept = kept.join(F.broadcast(found.select("source", "b")), "source").where("bin = b")
    run = kept.select(*columns).join(F.broadcast(found.select("source", "rest", "before")), "source")
    w = Window.partitionBy("source").orderBy("key", "spread", "id")  # one bin's documents
    run = run.withColumn("run", F.sum("n_tokens").over(w) + F.col("before")).withColumn("place", F.struct("key", "spread", "id"))
    last = run.groupBy("source").agg(F.max_by(F.struct("key", "spread", "id", "run"), F.when(F.col("run") <= F.col("rest"), F.col("place"))).alias("last"), F.min("place").alias("first"), F.min("before").alias("before"))
    return [(r.source, r["last"].key, r["last"].spread, r["last"].id, r["last"].run) if r["last"] else (r.source, r["first"].key, r["first"].spread, None, r.before) for r in last.collect()]  # a row for each target


def _fill(missing: int, sizes: list[tuple[int, object]]) -> list:
    """What of the next documents goes into the gap: each that still fits, in order, and at last the one nearest to what is then missing, if that is nearer than none."""
    taken = []
    for n, id_ in sizes:
        if 0 < n <= missing:
            taken.append(id_)
            missing -= n
    held = set(taken)
    off, _, last = min(((abs(missing - n), i, id_) for i, (n, id_) in enumerate(sizes) if id_ not in held), default=(missing, 0, None))
    return [*taken, last] if off < missing else taken


def mix(docs: DataFrame, mix_targets: DataFrame, total: int | None = None, tokens: dict[str, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(chosen: id, source, n_tokens, uses; report: a row for each target).

    docs: id, source (source_name), n_tokens, key (exponential_key); it is read several
    times, so it should be a written table; ``tokens`` has the sum of each source where the
    caller knows them. Targets repeated with the same source count
    once, the one with the greatest share. Documents of sources without a target, or with a
    null source, are not chosen. Of each source's fraction the documents in order of key are
    taken while the budget holds them; where more than GAP_SHARE of it is then missing, the
    next FILL documents are taken as far as they still fit, and one more if that brings the
    source nearer to its budget. uses never exceeds max_repeats. Equal keys go by a hash of
    the id, then by id.

    The report has source, target_share, actual_share (of all chosen tokens, repeats
    included), tokens, chosen_tokens, epochs and max_repeats.
    """
    spark, docs = docs.sparkSession, docs.select("id", "source", "n_tokens", "key")
    rows = mix_targets.groupBy(source_name(F.col("source")).alias("source")).agg(F.max_by(F.struct("target_share", "max_repeats"), F.struct("target_share", "max_repeats")).alias("t")).where("source is not null").select("source", "t.*").limit(MOST_TARGETS + 1).collect()
    if len(rows) > MOST_TARGETS:
        raise ValueError(f"over {MOST_TARGETS} targets")
    targets = sorted((r.source, float(r.target_share or 0), int(r.max_repeats or 0)) for r in rows)
    names = local_rows(spark, [(s,) for s, _, _ in targets], "source string")
    wanted = docs.join(F.broadcast(names), "source")  # at most MOST_TARGETS rows
    if tokens is None:
        tokens = {r.source: int(r.n or 0) for r in wanted.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}  # a row for each target
    plan = make_plan(targets, tokens, total)
    frame = local_rows(spark, [(p.source, p.epochs, p.rest) for p in plan], "source string, epochs int, rest bigint")
    base = wanted.withColumn("spread", F.shiftrightunsigned(F.xxhash64("id", F.lit(SEED + 1)), 12)).join(F.broadcast(frame), "source")  # 52 bits
    cuts = _find_cuts(base.where("rest > 0").select("source", "id", "n_tokens", "key", "spread"), frame.where("rest > 0").select("source", "rest"))
    kind = docs.schema["id"].dataType.simpleString()
    cut = F.broadcast(local_rows(spark, cuts, f"source string, cut_key double, cut_spread bigint, cut_id {kind}, taken bigint"))  # a row for each target
    marked = base.join(cut, "source", "left")
    first = (F.col("spread") < F.col("cut_spread")) | ((F.col("spread") == F.col("cut_spread")) & (F.col("id") <= F.col("cut_id")))
    inside = F.coalesce((F.col("rest") > 0) & ((F.col("key") < F.col("cut_key")) | ((F.col("key") == F.col("cut_key")) & first)), F.lit(False))
    rest = {p.source: p.rest for p in plan}
    gap = {s: rest[s] - taken for s, _, _, _, taken in cuts if rest[s] - taken > GAP_SHARE * rest[s]}
    fill: list[tuple] = []
    if gap:
        near = marked.where(F.col("source").isin(*gap) & ~inside).select("source", "key", "spread", "id", "n_tokens")
        w = Window.partitionBy("source").orderBy("key", "spread", "id")  # the limit holds before the shuffle too
        sizes: dict[str, list] = {s: [] for s in gap}
        for r in near.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= FILL).orderBy("source", "rn").collect():  # FILL rows for each target
            sizes[r.source].append((r.n_tokens, r.id))
        fill = [(s, id_) for s in gap for id_ in _fill(gap[s], sizes[s])]
    filled = marked.join(F.broadcast(local_rows(spark, fill, f"source string, id {kind}").withColumn("fills", F.lit(1))), ["source", "id"], "left")
    uses = F.col("epochs") + F.when(inside | F.col("fills").isNotNull(), 1).otherwise(0)
    chosen = filled.select("id", "source", "n_tokens", uses.cast("int").alias("uses")).where("uses > 0")
    plan_frame = local_rows(spark, [(p.source, p.target_share, p.max_repeats, p.tokens, p.epochs) for p in plan], "source string, target_share double, max_repeats int, tokens bigint, epochs int")
    got = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("chosen_tokens"), F.count(F.lit(1)).alias("documents"))
    report = plan_frame.join(got, "source", "left").fillna(0, ["chosen_tokens", "documents"])
    everything = F.sum("chosen_tokens").over(Window.partitionBy(F.lit(1)))  # a row for each target
    report = report.withColumn("actual_share", F.when(everything > 0, F.col("chosen_tokens") / everything).otherwise(0.0))
    return chosen, report.select("source", "target_share", "actual_share", "tokens", "chosen_tokens", "documents", "epochs", "max_repeats")
