"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

A source's target is its weighted share of all words, stopped at ``cap`` times what the source
holds; the excess goes to the others by weight. Each document of a source expects
``target / source_size`` copies. Documents of a source stand in one order (size class, hash,
size), their expected copies are prefix-summed, one offset per source is added, and a document is
taken once for every integer its interval crosses. Because the order goes by size, every size
class is thinned or repeated at the same rate, so the words taken stay near the target.

The prefix sum never orders a source in one task: rows are ranked inside cells of (source, size
class, hash digits) and cells carry the counts that precede them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop_internal, with_outputs

WORD = r"[^\x20\x09-\x0D]+"


def size_class(size: Column) -> Column:
    """Sizes below 16 as they are, above in classes an eighth of a power of two wide."""
    shift = F.length(F.bin(size)) - 4
    return F.when(size < 16, size).otherwise(shift * 8 + F.call_function("shiftright", size, shift.cast("int")))


def source_targets(sizes: DataFrame, source: str, weights: Sequence[int], cap: int) -> DataFrame:
    """``sizes`` (source, source_size) with ``target``.

    Weights repeat over the sources in code-point order, null last. One task orders the sources;
    it gets one row per source.
    """
    every = W.partitionBy()
    by_name = W.orderBy(F.col(source).asc_nulls_last())
    weight = F.element_at(F.array(*(F.lit(int(w)) for w in weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("__gw_w", weight).withColumn("__gw_total", F.sum("source_size").over(every))
    # From the source that reaches its stop first: what earlier ones got, and the weight from here on.
    fill = W.orderBy((F.col("source_size") / F.col("__gw_w")).asc(), F.col(source).asc_nulls_last())
    before = F.coalesce(F.sum(F.col("source_size") * cap).over(fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("__gw_w").over(fill.rowsBetween(0, W.unboundedFollowing))
    level = (F.col("__gw_total") - before) / rest
    stopped = ranked.withColumn("__gw_stop", level * F.col("__gw_w") > F.col("source_size") * cap)
    given = F.coalesce(F.sum(F.when(F.col("__gw_stop"), F.col("source_size") * cap)).over(every), F.lit(0))
    open_w = F.sum(F.when(~F.col("__gw_stop"), F.col("__gw_w"))).over(every)
    share = ((F.col("__gw_total") - given) / open_w) * F.col("__gw_w")
    target = F.when(F.col("__gw_stop"), (F.col("source_size") * cap).cast("double")).otherwise(F.least(share, (F.col("source_size") * cap).cast("double")))
    return stopped.withColumn("target", target)


def mix(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", weights: Sequence[int] = (1, 2, 3), cap: int = 3, seed: str = "mix") -> DataFrame:
    """All rows of ``docs`` with size, source_size, target, copies and taken (``copies * size``).

    A null or empty text has size 0; documents of size 0 are copied like others and take no words.
    A source without words has target 0. A null source is a source of its own. Rows that repeat
    are counted one by one. Columns named like an output are replaced; other columns stay.
    """
    size = F.regexp_count(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit(WORD)).cast("long")
    hashed = F.md5(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")))
    rows = docs.withColumns({"__gw_size": size, "__gw_source": F.col(f"`{source}`"), "__gw_hash": hashed, "__gw_key": F.col(f"`{key}`")})
    rows = rows.withColumns({"__gw_class": size_class(F.col("__gw_size")).cast("int"), "__gw_digits": F.substring("__gw_hash", 1, 2)})
    cell_of = ["__gw_source", "__gw_class", "__gw_digits"]
    cells = rows.groupBy(*cell_of).agg(F.count("*").alias("n"), F.sum("__gw_size").alias("words"))
    classes = cells.groupBy(*cell_of[:2]).agg(F.sum("n").alias("class_n"), F.sum("words").alias("class_words"))
    below = W.partitionBy("__gw_source").orderBy("__gw_class").rowsBetween(W.unboundedPreceding, -1)
    classes = classes.withColumn("class_before", F.coalesce(F.sum("class_n").over(below), F.lit(0)))
    targets = source_targets(classes.groupBy("__gw_source").agg(F.sum("class_words").alias("source_size")), "__gw_source", weights, cap)
    prior = W.partitionBy(*cell_of[:2]).orderBy("__gw_digits").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.withColumn("cell_before", F.coalesce(F.sum("n").over(prior), F.lit(0)))
    # Cells know their source's target and the rows that precede them; rows then join one cell each.
    c, k, t = cells.alias("c"), classes.alias("k"), targets.alias("t")
    c = c.join(k, F.col("c.__gw_source").eqNullSafe(F.col("k.__gw_source")) & (F.col("c.__gw_class") == F.col("k.__gw_class")))
    c = c.join(t, F.col("c.__gw_source").eqNullSafe(F.col("t.__gw_source")))
    c = c.select(*(F.col(f"c.{n}").alias(f"__gw_c{i}") for i, n in enumerate(cell_of)), (F.col("class_before") + F.col("cell_before")).alias("__gw_before"), F.col("source_size").alias("__gw_source_size"), F.col("target").alias("__gw_target"))
    inside = W.partitionBy(*cell_of).orderBy("__gw_size", "__gw_hash", "__gw_key")
    rows = rows.withColumn("__gw_rank", F.row_number().over(inside))
    rows = rows.join(c, F.col("__gw_source").eqNullSafe(F.col("__gw_c0")) & (F.col("__gw_class") == F.col("__gw_c1")) & (F.col("__gw_digits") == F.col("__gw_c2")))
    rate = F.when(F.col("__gw_source_size") > 0, F.col("__gw_target") / F.col("__gw_source_size")).otherwise(0.0)
    digits = F.conv(F.substring(F.md5(F.concat(F.lit(seed + "/"), F.coalesce(F.col("__gw_source").cast("string"), F.lit("")))), 1, 4), 16, 10)
    offset = (digits.cast("double") + 0.5) / 65536
    upto = F.col("__gw_before") + F.col("__gw_rank")
    rows = rows.withColumn("__gw_copies", F.floor(offset + rate * upto) - F.floor(offset + rate * (upto - 1)))
    out = {"size": F.col("__gw_size"), "source_size": F.col("__gw_source_size"), "target": F.col("__gw_target"), "copies": F.col("__gw_copies"), "taken": F.col("__gw_copies") * F.col("__gw_size")}
    return drop_internal(with_outputs(rows, out))


def emit_copies(mixed: DataFrame) -> DataFrame:
    """One row per copy; documents that the mix does not take leave."""
    taken = mixed.filter(F.col("copies") > 0)
    return taken.withColumn("__gw_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("__gw_copy")


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS w,
             (sum(source_size) OVER ())::BIGINT AS total FROM s),
f AS (SELECT *, (total - coalesce(sum(source_size * 3) OVER (ORDER BY source_size / w, source NULLS LAST
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)::DOUBLE
                / (sum(w) OVER (ORDER BY source_size / w, source NULLS LAST
                      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM w),
g AS (SELECT *, level * w > source_size * 3 AS stopped FROM f),
t AS (SELECT source, source_size,
        CASE WHEN stopped THEN (source_size * 3)::DOUBLE ELSE least(
          ((total - coalesce(sum(CASE WHEN stopped THEN source_size * 3 END) OVER (), 0)::BIGINT)::DOUBLE
            / (sum(CASE WHEN NOT stopped THEN w END) OVER ())::DOUBLE) * w, (source_size * 3)::DOUBLE) END AS target,
        ((strpos('0123456789abcdef', substr(md5('mix/' || coalesce(source, '')), 1, 1)) - 1) * 4096
        + (strpos('0123456789abcdef', substr(md5('mix/' || coalesce(source, '')), 2, 1)) - 1) * 256
        + (strpos('0123456789abcdef', substr(md5('mix/' || coalesce(source, '')), 3, 1)) - 1) * 16
        + (strpos('0123456789abcdef', substr(md5('mix/' || coalesce(source, '')), 4, 1)) - 1) + 0.5::DOUBLE) / 65536 AS u
      FROM g),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.u,
        CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
        row_number() OVER (PARTITION BY d.source ORDER BY
          CASE WHEN d.size < 16 THEN d.size ELSE (length(bin(d.size)) - 4) * 8 + (d.size >> (length(bin(d.size)) - 4)) END,
          substr(d.h, 1, 2), d.size, d.h, d.doc_id) AS k
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       ((floor(u + rate * k) - floor(u + rate * (k - 1)))::BIGINT * size)::BIGINT AS taken
FROM r
"""
