"""Consistent-hash ring with virtual nodes and bounded loads.

Every key hashes to one of ``CELLS`` ring cells. Each shard owns ``vnodes`` points of the ring;
a key belongs to the next point clockwise. A shard takes keys up to its bound and keys beyond it
go on clockwise, nearest points first, until a shard has room.

Only the count of each cell reaches the driver (at most ``CELLS`` numbers, whatever the corpus
holds). The driver walks the ring once and returns, for each cell, which ranks go to which shard;
that plan (cells plus splits, a proven bound) is broadcast and every row finds its place by its
rank in its own cell. A cell is ordered in ``PARTS`` parts, so one key that a third of all rows have
is not ordered in one task, and parts are even because rows are hashed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from .common import drop_internal, materialize, with_outputs

CELLS = 16384
PARTS = 8  #: of a cell, by the hash of what its rows hold beside the key


def _point(label: str) -> int:
    return int(hashlib.md5(label.encode()).hexdigest()[:8], 16)


def ring_points(n_shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node in clockwise order."""
    points = sorted((_point(f"shard {s} node {v}"), s) for s in range(n_shards) for v in range(vnodes))
    return [(p * CELLS >> 32, s) for p, s in points]


def bounds(total: int, n_shards: int, slack: float) -> list[int]:
    """Rows each shard may take: the mean rounded so that the bounds differ by one at most, times ``slack``."""
    if slack > 1:
        return [-int(-total * slack // n_shards)] * n_shards
    return [total // n_shards + (s < total % n_shards) for s in range(n_shards)]


def ring_plan(counts: dict[int, int], n_shards: int, vnodes: int, slack: float) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, end rank, shard, first slot) for each piece of a cell."""
    points = ring_points(n_shards, vnodes)
    free = bounds(sum(counts.values()), n_shards, slack)
    # Cells of each arc: a key goes to the first point at or after its cell, past the end to the first.
    cells_of: list[list[int]] = [[] for _ in points]
    at = 0
    for cell in sorted(counts):
        while at < len(points) and points[at][0] < cell:
            at += 1
        cells_of[at % len(points)].append(cell)
    left = [sum(counts[c] for c in cells) for cells in cells_of]
    shares: list[list[tuple[int, int]]] = [[] for _ in points]
    waiting = [i for i, n in enumerate(left) if n]
    for step in range(len(points)):
        for i in waiting:
            shard = points[(i + step) % len(points)][1]
            if take := min(left[i], free[shard]):
                shares[i].append((take, shard))
                left[i] -= take
                free[shard] -= take
        waiting = [i for i in waiting if left[i]]
        if not waiting:
            break
    slots = [0] * n_shards
    plan = []
    for cells, pieces in zip(cells_of, shares):
        queue = iter(pieces)
        room, shard = 0, -1
        for cell in cells:
            rank = 0
            while rank < counts[cell]:
                if not room:
                    room, shard = next(queue)
                take = min(room, counts[cell] - rank)
                plan.append((cell, rank, rank + take, shard, slots[shard]))
                slots[shard] += take
                rank += take
                room -= take
    return plan


def shard_rows(df: DataFrame, key: Column, n_shards: int = 16, vnodes: int = 64, slack: float = 1.0, ties: Sequence[str] | None = None) -> DataFrame:
    """Add ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard).

    ``slack`` is the bound as a multiple of the mean load. At 1 every shard is filled to the mean
    and counts differ by one at most; above 1 fewer keys leave their home, and less moves when a
    shard is added. Rows of one key are ranked by ``ties`` (all columns that can be ordered, unless
    given), so a task that runs again gives the same places; rows equal in these are
    interchangeable and each gets a slot. A null key counts as the empty string. An empty table
    gives an empty result. Columns of ``df`` named shard or slot are replaced.
    """
    spark = df.sparkSession
    hashed = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    cell = (F.shiftright(F.conv(F.substring(hashed, 1, 8), 16, 10).cast("long") * F.lit(CELLS), 32)).cast("int")
    if ties is None:
        ties = [f"`{f.name}`" for f in df.schema.fields if isinstance(f.dataType, AtomicType)]
    placed = df.withColumns({"__gw_cell": cell, "__gw_hash": hashed, "__gw_part": F.pmod(F.xxhash64(*ties), F.lit(PARTS)).cast("int") if ties else F.lit(0)})
    sizes = placed.groupBy("__gw_cell", "__gw_part").agg(F.count("*").alias("__gw_n"))
    held = materialize(sizes, "cells")  # CELLS x PARTS rows at most
    counts = {r[0]: r[1] for r in held.groupBy("__gw_cell").agg(F.sum("__gw_n")).collect()}
    before = held.select("__gw_cell", "__gw_part", (F.sum("__gw_n").over(W.partitionBy("__gw_cell").orderBy("__gw_part")) - F.col("__gw_n")).alias("__gw_before"))
    plan = spark.createDataFrame(ring_plan(counts, n_shards, vnodes, slack), "__gw_c int, __gw_lo long, __gw_hi long, __gw_shard int, __gw_slot long")
    order = W.partitionBy("__gw_cell", "__gw_part").orderBy("__gw_hash", *ties)
    ranked = placed.withColumn("__gw_rank", F.row_number().over(order) - 1).join(F.broadcast(before), ["__gw_cell", "__gw_part"]).withColumn("__gw_rank", F.col("__gw_rank") + F.col("__gw_before"))
    on = (F.col("__gw_cell") == F.col("__gw_c")) & (F.col("__gw_rank") >= F.col("__gw_lo")) & (F.col("__gw_rank") < F.col("__gw_hi"))
    found = ranked.join(F.broadcast(plan), on)
    return drop_internal(with_outputs(found, {"shard": F.col("__gw_shard"), "slot": F.col("__gw_slot") + F.col("__gw_rank") - F.col("__gw_lo")}))


def shard_documents(docs: DataFrame, n_shards: int = 16, vnodes: int = 64, slack: float = 1.0) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``rows``: with ``slack`` 1 the shards' counts are one apart at most. A null text has
    no bytes (size 1, checksum 0).
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = shard_rows(narrow, F.col("doc_id"), n_shards, vnodes, slack)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
