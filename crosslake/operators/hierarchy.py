"""Parent–child links to full hierarchies: root, depth, nested-set ranges, paths, cycles.

Subtree sizes are summed upward, sibling ranges are laid out downward by prefix sums, and
the range of a node holds exactly its descendants. Both directions double their reach in
each round, so trees of height h need about log2(h) rounds, not h. Nodes that still have an
ancestor when a round settles none of them are on a cycle or below one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crosslake.functions.common import Scratch

SIBLING_GROUP = 100_000  # children of one parent that are numbered together, on average; more are dealt into groups


def _number(nodes: DataFrame, edges: DataFrame, s: Scratch) -> tuple[DataFrame, DataFrame, int]:
    """(nodes with a number each, links child -> parent, their number). Ids are text of any length; numbers keep the rounds small."""
    one = nodes.where("key is not null").groupBy("scope", "key").agg(F.min("graph").alias("graph"), F.min("node_id").alias("node_id"))
    numbered = s.write(one.withColumn("v", F.monotonically_increasing_id()))
    key = numbered.select("scope", "key", "v")
    pairs = edges.where("source is not null and target is not null").select("scope", "source", "target").distinct()
    got = pairs.join(key.select("scope", F.col("key").alias("source"), F.col("v").alias("p")), ["scope", "source"]).join(key.select("scope", F.col("key").alias("target"), "v"), ["scope", "target"])
    return numbered, *s.write_counted(got.groupBy("v").agg(F.min_by("p", "source").alias("a")))


def _ascend(links: DataFrame, count: int, s: Scratch) -> tuple[list[DataFrame], DataFrame]:
    """The rounds upward: tables (v, a, size) of the nodes that have an ancestor ``a`` 2^k above, and the nodes that never run out of ancestors."""
    rounds: list[DataFrame] = []
    now = links.withColumn("size", F.lit(1).cast("bigint"))
    while count:
        rounds.append(now)
        add = now.groupBy(F.col("a").alias("v")).agg(F.sum("size").alias("add"))
        up = now.select(F.col("v").alias("a"), F.col("a").alias("next"))
        now, left = s.write_counted(now.join(up, "a").join(add, "v", "left").select("v", F.col("next").alias("a"), (F.col("size") + F.coalesce("add", F.lit(0))).alias("size")))
        if left == count:
            break
        count = left
    return rounds, now.select("v")


def _offsets(links: DataFrame, sizes: DataFrame, endless: DataFrame, count: int) -> DataFrame:
    """(v, a, size, offset): where a child's range starts within its parent's, after the parent itself and its earlier siblings."""
    own = links.join(endless, "v", "left_anti").join(sizes, "v", "left").select("v", "a", F.coalesce("size", F.lit(1)).alias("size"))
    own = own.withColumn("b", F.pmod(F.xxhash64("v"), F.lit(-(-count // SIBLING_GROUP) or 1)))
    first = own.groupBy("a", "b").agg(F.sum("size").alias("all"))
    first = first.select("a", "b", (F.sum("all").over(Window.partitionBy("a").orderBy("b")) - F.col("all")).alias("before"))
    inside = F.sum("size").over(Window.partitionBy("a", "b").orderBy("v")) - F.col("size")
    return own.withColumn("inside", inside).join(first, ["a", "b"]).select("v", "a", "size", (F.col("inside") + F.col("before") + 1).alias("offset"))


def hierarchies(nodes: DataFrame, edges: DataFrame, paths: bool = False, separator: str = " / ") -> DataFrame:
    """One row for each node of each graph.

    nodes: scope and key (equal for equal ids), graph and node_id (as written in the
    result; of copies the smallest); edges: scope, source (parent's key), target (child's
    key). Edges whose ends are not both nodes do not count; repeated edges count once; of
    several different parents the one with the smallest key counts; null keys are no nodes.

    Result: graph, node_id, root_id, depth, lft, rgt, n_descendants, and with ``paths``
    parent_id and the path of node ids from the root. A node's descendants are the nodes of its
    root with lft in (lft, rgt]. Nodes on or below a cycle have root_id ``cycle``, depth -1
    and no range. Siblings come in no particular order.
    """
    spark = nodes.sparkSession
    s = Scratch(spark, "hierarchy")
    numbered, links, count = _number(nodes, edges, s)
    rounds, endless = _ascend(links, count, s)
    endless = endless if rounds else links.select("v").limit(0)
    size = None
    for t in rounds:
        part = t.select(F.col("a").alias("v"), "size")
        size = part if size is None else size.union(part)
    sizes = (size if size is not None else links.select("v", F.lit(0).cast("bigint").alias("size"))).groupBy("v").agg((F.sum("size") + 1).alias("size"))
    sizes = s.write(sizes)
    offs = s.write(_offsets(links, sizes, endless, count))
    s.drop(*rounds[1:])
    name = numbered.select("v", F.col("node_id").alias("path")) if paths else None
    roots = numbered.select("v").join(links.select("v"), "v", "left_anti").select("v", F.lit(0).cast("bigint").alias("lft"), F.lit(0).alias("depth"), F.col("v").alias("root"))
    acc = offs.select("v", "a", F.col("offset").alias("lft"))
    if paths:
        roots, acc = roots.join(name, "v"), acc.join(name, "v")
    done = [s.write(roots)]
    walk = ["path"] if paths else []
    acc = s.write(acc) if paths else acc
    nothing = [F.lit(None).cast("int").alias("depth"), F.lit(None).cast("bigint").alias("root")]
    for k in range(len(rounds)):
        # an ancestor 2^k above is settled, or hands over to the one 2^k above itself
        upper = acc.select("v", "lft", *nothing, F.col("a").alias("next"), *walk)
        for t in done:
            upper = upper.unionByName(t.select("v", "lft", "depth", "root", F.lit(None).cast("bigint").alias("next"), *walk))
        joined = [F.concat(F.col("up.path"), F.lit(separator), F.col("acc.path")).alias("path")] if paths else []
        met = acc.alias("acc").join(upper.alias("up"), F.col("acc.a") == F.col("up.v")).select("acc.v", F.col("up.next").alias("a"), (F.col("acc.lft") + F.col("up.lft")).alias("lft"), (F.col("up.depth") + (1 << k)).alias("depth"), "up.root", *joined)
        met = s.write(met)
        done.append(met.where("depth is not null").drop("a"))
        acc = met.where("depth is null").drop("depth", "root")
    every = done[0]
    for t in done[1:]:
        every = every.unionByName(t)
    every = every.join(sizes, "v", "left").withColumn("size", F.coalesce("size", F.lit(1)))
    lost = endless.select("v", F.lit(None).cast("bigint").alias("lft"), F.lit(-1).alias("depth"), F.lit(None).cast("bigint").alias("root"), *([F.lit(None).cast("string").alias("path")] if paths else []), F.lit(None).cast("bigint").alias("size"))
    names = numbered.select("v", "graph", "node_id")
    root_name = names.select(F.col("v").alias("root"), F.col("node_id").alias("root_id"))
    got = names.join(every.unionByName(lost), "v").join(root_name, "root", "left")
    if paths:
        parent_name = links.join(names.select(F.col("v").alias("a"), F.col("node_id").alias("parent_id")), "a").select("v", "parent_id")
        got, walk = got.join(parent_name, "v", "left"), ["parent_id", "path"]
    return got.select(
        "graph", "node_id", F.coalesce("root_id", F.lit("cycle")).alias("root_id"), "depth", "lft",
        (F.col("lft") + F.col("size") - 1).alias("rgt"), (F.col("size") - 1).alias("n_descendants"), *walk,
    )


def descendants(tree: DataFrame) -> DataFrame:
    """Each node with each of its descendants: graph, root_id, node_id, descendant_id, distance.

    A node's range is split into its dyadic blocks, at most two of each size; a descendant
    lies in one block of each size, so an equality join on (root, size, block) gives exactly
    the pairs, without comparing others, and a large tree spreads over its blocks.
    """
    own = tree.where("depth >= 0")
    ranges = own.where("n_descendants > 0").select("graph", "root_id", "node_id", F.col("depth").alias("d"), F.explode(F.expr(_DYADIC)).alias("x"))
    ranges = ranges.select("graph", "root_id", "node_id", "d", F.col("x.j").alias("j"), F.col("x.blk").alias("blk"))
    top = F.expr("cast(floor(log2(lft)) as int)")  # blocks of ranges begin at 2^j or later
    leaves = own.where("depth > 0").select("graph", "root_id", F.col("node_id").alias("descendant_id"), "depth", F.explode(F.sequence(F.lit(0), top)).alias("j"), "lft")
    leaves = leaves.withColumn("blk", F.expr("shiftright(lft, j)"))
    return ranges.join(leaves, ["graph", "root_id", "j", "blk"]).select("graph", "root_id", "node_id", "descendant_id", (F.col("depth") - F.col("d")).alias("distance"))


# the dyadic blocks of lft+1 .. rgt: at size 2^j a block is taken where the bound is not aligned to the next size
_DYADIC = """
filter(flatten(transform(sequence(0, cast(floor(log2(rgt + 1)) as int)), j -> array(
  if(shiftright(lft + shiftleft(1L, j), j) < shiftright(rgt + 1, j) and shiftright(lft + shiftleft(1L, j), j) % 2 = 1,
     struct(j as j, shiftright(lft + shiftleft(1L, j), j) as blk), null),
  if(shiftright(lft + shiftleft(1L, j), j) < shiftright(rgt + 1, j) and shiftright(rgt + 1, j) % 2 = 1,
     struct(j as j, shiftright(rgt + 1, j) - 1 as blk), null)))), x -> x is not null)
"""
