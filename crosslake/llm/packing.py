"""Filling fixed-capacity containers: first-fit decreasing with a tournament tree, in random groups of documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosslake.functions.common import ship

GROUP_ITEMS = 20_000
SEED = 11


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The container of each item of ``sizes`` (which must descend, none above ``capacity``).

    A tournament tree holds in each node the most free space below it, so the leftmost
    container with enough space is found, and filled, along one path.
    """
    leaves = 1
    while leaves < max(1, len(sizes)):
        leaves *= 2
    free = [capacity] * (2 * leaves)
    out = []
    for size in sizes:
        node = 1
        while node < leaves:
            node *= 2
            if free[node] < size:
                node += 1
        out.append(node - leaves)
        free[node] -= size
        node //= 2
        while node:
            a, b = free[2 * node], free[2 * node + 1]
            most = a if a > b else b
            if free[node] == most:
                break
            free[node] = most
            node //= 2
    return out


def pack(items: DataFrame, id_col: str, size_col: str, capacity: int, group_items: int = GROUP_ITEMS, seed: int = SEED) -> DataFrame:
    """The container of each item: ``id_col``, piece, start, size, container_id.

    Items are dealt at random (by a hash of the id) into groups of about ``group_items``,
    whose number follows the table's; each group is packed by itself, so a group always fits
    a task, and the last, half-empty container of a group is the only cost. An item above
    the capacity is divided into full pieces and a rest, ``start`` is where a piece begins;
    no other item is divided. Items of size 0, null or less take a place without space. Rows
    with the same id are items of their own; ties in size go by id, then piece, so that the
    result does not depend on partitions. An empty table has no containers.
    """
    ship(items.sparkSession)
    n = items.count()
    groups = max(1, -(-n // group_items))
    kind = items.schema[id_col].dataType.simpleString()
    dealt = items.select(F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(groups)).alias("g"), F.col(id_col).alias("id"), F.greatest(F.coalesce(F.col(size_col), F.lit(0)), F.lit(0)).cast("bigint").alias("size"))

    def fill(t: pa.Table) -> pa.Table:
        t = t.sort_by([("size", "descending"), ("id", "ascending")])
        size = t["size"].to_numpy()
        pieces = np.maximum(1, -(-size // capacity))
        row = np.repeat(np.arange(len(size)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        part = np.minimum(capacity, size[row] - piece * capacity)
        order = np.argsort(-part, kind="stable")
        where = np.empty(len(row), np.int64)
        where[order] = first_fit_decreasing(part[order].tolist(), capacity)
        base = t["g"][0].as_py() << 32 if len(size) else 0
        return pa.table({"id": t["id"].take(pa.array(row)), "piece": pa.array(piece, pa.int32()), "start": piece * capacity, "size": part, "container_id": where + base})

    out = dealt.groupBy("g").applyInArrow(fill, f"id {kind}, piece int, start bigint, size bigint, container_id bigint")
    return out.withColumnRenamed("id", id_col)


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, the least number that could hold the same, total size, and the share of unused space."""
    per = packed.groupBy("container_id").agg(F.sum("size").alias("used"), F.count(F.lit(1)).alias("items"))
    return per.agg(
        F.count(F.lit(1)).alias("containers"), F.ceil(F.sum("used") / capacity).alias("least_containers"), F.sum("items").alias("items"), F.sum("used").alias("total_size"),
        F.max("used").alias("fullest"), (1 - F.sum("used") / (F.count(F.lit(1)) * F.lit(float(capacity)))).alias("unused_share"),
    )
