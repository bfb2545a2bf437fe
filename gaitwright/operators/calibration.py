"""Isotonic calibration of each group: the non-decreasing step that is nearest to the labels.

Pooling adjacent violators is associative: the blocks of two neighbouring ranges of scores, pooled
again, are the blocks of both together. So a group's scores are cut into ranges, every range is
pooled alone, and the blocks that are left, mostly few, are pooled in one task for each group.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .order import RANGES


def pool(low: np.ndarray, high: np.ndarray, weight: np.ndarray, total: np.ndarray) -> np.ndarray:
    """[block, (low, high, weight, total)] with increasing means, from blocks in order of score."""
    out: list[list[float]] = []
    for block in zip(low.tolist(), high.tolist(), weight.tolist(), total.tolist()):
        out.append(list(block))
        while len(out) > 1 and out[-2][3] * out[-1][2] >= out[-1][3] * out[-2][2]:
            _, end, w, s = out.pop()
            out[-1][1:] = [end, out[-1][2] + w, out[-1][3] + s]
    return np.array(out).reshape(-1, 4)


def _edges(df: DataFrame, by: Sequence[str], score: str) -> DataFrame:
    return df.groupBy(*by).agg(F.percentile_approx(score, [i / RANGES for i in range(1, RANGES)], 1000).alias("__gw_e"))


def _ranged(df: DataFrame, edges: DataFrame, by: Sequence[str], score: str) -> DataFrame:
    """``df`` with ``__gw_r``, the range of its score by ``edges``; rows of groups without edges leave."""
    on = df.join(edges, list(by)) if by else df.crossJoin(F.broadcast(edges))
    return on.withColumn("__gw_r", F.size(F.filter("__gw_e", lambda e: e < F.col(score)))).drop("__gw_e")


_BLOCK = ("low", "high", "weight", "total")


def isotonic_blocks(train: DataFrame, by: Sequence[str], label: str = "y_true", score: str = "y_pred", weight: str | None = None) -> DataFrame:
    """(by, low, high, weight, value): the blocks of each group, by score; equal scores are one point.
    Rows without label or score do not count."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    ok = train.filter(F.col(label).isNotNull() & F.col(score).isNotNull() & ~F.isnan(label) & ~F.isnan(score) & (w > 0))
    points = ok.groupBy(*by, F.col(score).cast("double").alias("low")).agg(F.sum(w).alias("weight"), F.sum(w * F.col(label)).alias("total")).withColumn("high", F.col("low"))
    keys = list(by)
    kinds = ", ".join([*(f"`{c}` {train.schema[c].dataType.simpleString()}" for c in by), *(f"{c} double" for c in _BLOCK)])

    def pooled(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("low")
        blocks = pd.DataFrame(pool(*(part[c].to_numpy(float) for c in _BLOCK)), columns=list(_BLOCK))
        return blocks.assign(**dict(zip(keys, key)))[[*keys, *_BLOCK]]

    ranged = _ranged(points, _edges(points, by, "low"), by, "low")
    local = ranged.groupBy(*by, "__gw_r").applyInPandas(pooled, kinds)
    return local.groupBy(*by).applyInPandas(pooled, kinds).select(*by, "low", "high", "weight", (F.col("total") / F.col("weight")).alias("value"))


def isotonic_calibrated(rows: DataFrame, blocks: DataFrame, by: Sequence[str], score: str = "y_pred", name: str = "calibrated") -> DataFrame:
    """``rows`` with the value at their score: a block's inside it, in proportion between two blocks, the
    first or last one's beyond. Null where a group has no block or the score is null or nan.

    Rows and blocks meet inside ranges of scores; a range knows the last block before and the first after it.
    """
    keys = list(by)
    whole = rows.withColumn("__gw_x", F.col(score).cast("double"))
    ends = F.array(*(F.struct(F.col(c).alias("x"), F.col("value").alias("v")) for c in ("low", "high")))
    steps = blocks.select(*keys, F.explode(F.array_distinct(ends)).alias("__gw_p")).select(*keys, F.col("__gw_p.x").alias("__gw_x"), "__gw_p")
    edges = _edges(steps, by, "__gw_x")
    placed = _ranged(steps, edges, by, "__gw_x")
    bounds = placed.groupBy(*keys, "__gw_r").agg(F.min_by("__gw_p", "__gw_x").alias("first"), F.max_by("__gw_p", "__gw_x").alias("last"))
    grid = edges.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(RANGES - 1))).alias("__gw_r")).join(bounds, [*keys, "__gw_r"], "left")
    along = W.partitionBy(*keys).orderBy("__gw_r")
    near = grid.select(*keys, "__gw_r", F.last("last", True).over(along.rowsBetween(W.unboundedPreceding, -1)).alias("__gw_before"), F.first("first", True).over(along.rowsBetween(1, W.unboundedFollowing)).alias("__gw_after"))
    known = F.col("__gw_x").isNotNull() & ~F.isnan("__gw_x")
    mine = _ranged(whole.filter(known), edges, by, "__gw_x")
    both = mine.withColumn("__gw_p", F.lit(None).cast(placed.schema["__gw_p"].dataType)).withColumn("__gw_row", F.lit(True)).unionByName(placed.withColumn("__gw_row", F.lit(False)), allowMissingColumns=True)
    inside = W.partitionBy(*keys, "__gw_r")
    # The next step is the last one from above: a frame that ends behind its rows is read again for each of them.
    upto = lambda order: F.last("__gw_p", True).over(inside.orderBy(order).rangeBetween(W.unboundedPreceding, W.currentRow))
    seen = both.withColumns({"__gw_a": upto(F.col("__gw_x")), "__gw_b": upto(F.desc("__gw_x"))}).filter("__gw_row").join(near, [*keys, "__gw_r"])
    a, b = F.coalesce("__gw_a", "__gw_before"), F.coalesce("__gw_b", "__gw_after")
    a, b = F.coalesce(a, b), F.coalesce(b, a)
    share = F.when(b["x"] > a["x"], (F.col("__gw_x") - a["x"]) / (b["x"] - a["x"])).otherwise(0.0)
    value = F.when(F.col("__gw_x") <= a["x"], a["v"]).when(F.col("__gw_x") >= b["x"], b["v"]).otherwise(a["v"] + share * (b["v"] - a["v"]))
    done = seen.withColumn(name, value).select(*rows.columns, name)
    lone = whole.filter(~F.coalesce(known, F.lit(False)))
    lone = lone if not by else lone.unionByName(whole.filter(known).join(edges.select(*keys), keys, "left_anti"))
    return done.unionByName(lone.select(*rows.columns, F.lit(None).cast("double").alias(name)))
