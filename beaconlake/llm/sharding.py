"""Byte-balanced shards for indivisible groups by Karmarkar-Karp differencing.

A partial partition is a tuple of shard sums. The two partial partitions with the largest spread
are combined again and again, the large sums of one with the small sums of the other, until
one is left. Groups are differenced in blocks, one task each; the blocks' partial partitions are
then combined in the same way, level by level, so that no task sees more than a block of them.
"""

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from beaconlake.llm.common import UID, digest
from beaconlake.session import materialise

#: Partial partitions that one task combines.
FAN_IN = 1024


def difference(sums: np.ndarray) -> np.ndarray:
    """Combine partial partitions, one per row of ``sums``; the final shard of each of their parts.

    ``sums`` has a column per shard. Entry ``(i, p)`` of the result is the shard that part ``p`` of
    row ``i`` ends up in. Equal spreads are taken in the order of their creation.
    """
    count, shards = sums.shape
    nodes = [np.sort(row)[::-1] for row in sums]
    heap = [(int(row[-1] - row[0]), i) for i, row in enumerate(nodes)]
    heapq.heapify(heap)
    children: list[tuple[int, int, np.ndarray]] = []
    while len(heap) > 1:
        (_, left), (_, right) = heapq.heappop(heap), heapq.heappop(heap)
        joined = nodes[left] + nodes[right][::-1]
        order = np.argsort(-joined, kind="stable")
        joined = joined[order]
        nodes[left] = nodes[right] = None
        children.append((left, right, order))
        nodes.append(joined)
        heapq.heappush(heap, (int(joined[-1] - joined[0]), len(nodes) - 1))
    shard_of: dict[int, np.ndarray] = {len(nodes) - 1: np.arange(shards)}
    for node in range(len(nodes) - 1, count - 1, -1):
        left, right, order = children[node - count]
        of = shard_of.pop(node)
        shard_of[left], shard_of[right] = np.empty(shards, int), np.empty(shards, int)
        shard_of[left][order] = of
        shard_of[right][shards - 1 - order] = of
    result = np.empty((count, shards), dtype=int)
    for i, row in enumerate(sums):
        result[i, np.argsort(-row, kind="stable")] = shard_of[i]
    return result


def _difference_groups(shards: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["bytes", "group"], ascending=[False, True], ignore_index=True)
        sums = np.zeros((len(frame), shards), dtype=np.int64)
        sums[:, 0] = frame["bytes"]
        return frame.assign(part=difference(sums)[:, 0])[["block", "group", "bytes", "part"]]

    return run


def _difference_blocks(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("block", ignore_index=True)
    of = difference(np.array(frame["sums"].tolist(), dtype=np.int64))
    return pd.DataFrame({"block": frame["block"], "parent": frame["parent"], "shard_of": list(of)})


def _block_sums(assigned: DataFrame, shards: int) -> DataFrame:
    """One row per block: its sums, a part without groups counting zero."""
    sums = assigned.groupBy("block", "part").agg(F.sum("bytes").alias("bytes"))
    by_part = F.map_from_entries(F.collect_list(F.struct("part", "bytes")))
    return sums.groupBy("block").agg(by_part.alias("m")).selectExpr(
        "block", f"transform(sequence(0, {shards - 1}), p -> coalesce(m[p], 0L)) AS sums"
    )


def balanced_groups(groups: DataFrame, shards: int, fan_in: int = FAN_IN) -> DataFrame:
    """``group, shard`` for a table ``group, bytes`` with one row per indivisible group."""
    blocks = max(1, math.ceil(groups.count() / fan_in))
    assigned = materialise(
        groups.withColumn("block", F.pmod(F.xxhash64("group"), F.lit(blocks)))
        .groupBy("block")
        .applyInPandas(_difference_groups(shards), "block long, group string, bytes long, part int"),
        "shard-groups",
    )
    while blocks > 1:
        parents = math.ceil(blocks / fan_in)
        merged = materialise(
            _block_sums(assigned, shards)
            .withColumn("parent", F.expr(f"block % {parents}"))
            .groupBy("parent")
            .applyInPandas(_difference_blocks, "block long, parent long, shard_of array<int>"),
            "shard-blocks",
        )
        assigned = materialise(
            assigned.join(merged, "block").selectExpr(
                "parent AS block", "group", "bytes", "shard_of[part] AS part"
            ),
            "shard-groups",
        )
        blocks = parents
    return assigned.select("group", F.col("part").alias("shard"))


def byte_shards(documents: DataFrame, shards: int = 40, overhead: int = 16) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row of ``documents``.

    Rows with equal texts stay in one shard; their sizes (UTF-8 bytes plus ``overhead``) are summed
    and the groups spread by differencing, so the shards' bytes are near equal unless one group alone
    is larger than a shard. Missing texts are one group, apart from empty ones, with size
    ``overhead`` and crc 0. Repeated rows count each; a missing ``doc_id`` stays missing. An
    empty table gives no rows. Columns other than ``doc_id`` and ``text`` are ignored.
    ``slot`` numbers the rows of a shard without gaps; ``law`` is ``bytes`` and
    ``grown_shard`` null, as a further shard would move rows between all shards.
    """
    rows = documents.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(digest(F.col("text")), F.lit("missing")).alias("group"),
    ).withColumn("size", F.col("size") + overhead)
    rows = materialise(rows, "shard-rows")
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes"))
    placed = materialise(
        rows.join(balanced_groups(groups, shards), "group")
        .drop("group")
        .withColumn(UID, F.monotonically_increasing_id()),
        "shard-placed",
    )
    return _numbered(placed, max(64, placed.count() // 20_000)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _numbered(placed: DataFrame, buckets: int) -> DataFrame:
    """Add ``slot``: rows are numbered in buckets and shifted by the rows of earlier buckets."""
    rows = placed.withColumn("bucket", F.pmod(F.xxhash64(UID), F.lit(buckets)))
    earlier = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    starts = starts.select("shard", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy("shard", "bucket").orderBy(UID)
    return rows.join(starts, ["shard", "bucket"]).withColumn(
        "slot", (F.col("start") + F.row_number().over(inside) - 1).cast("long")
    )
