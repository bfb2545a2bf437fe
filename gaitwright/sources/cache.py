"""Results of trials kept between runs: what has not changed is read, the rest is computed.

A trial's key is a hash of its files and of the parameters that its result depends on. The table
lies in ``PARTS`` folders by a hash of the trial. A run reads the rows whose key is still the
trial's, computes the others, and rewrites the folders of those alone, so stale rows and broken files
go with the first change near them. Every row carries a hash of its columns. A file that cannot be
read and a row whose hash is wrong are as if they were not there.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaitwright.session import cut

PARTS = 256
_KEY, _CHECK, _PART = "__gw_key", "__gw_check", "__gw_part"


class TrialCache:
    """A table of results under ``root``, one or more rows for each trial ``by``. ``close`` (or leaving a
    ``with`` block) frees what :meth:`held` keeps in memory; files stay."""

    def __init__(self, root: str, by: Sequence[str], parts: int = PARTS):
        self.root, self.by, self.parts = root.rstrip("/"), list(by), parts
        self._held: list[DataFrame] = []
        self.computed = 0  #: trials that the last :meth:`load` computed

    def __enter__(self) -> TrialCache:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        while self._held:
            self._held.pop().unpersist()

    def _exists(self, spark) -> bool:
        at = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(*self.by), F.lit(self.parts)).cast("int")

    def load(self, keys: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The rows of all trials of ``keys`` (by, key), from the table where their key is there.

        ``compute`` gets the trials (by, key) that are missing or changed and returns their rows, ``by`` and the
        same columns at every call; a trial that it gives no row for is asked for again the next time. Null
        ids are no trials. A row's hash covers columns of any kind but maps.
        """
        spark = keys.sparkSession
        keys = keys.select(*self.by, "key").dropna().distinct()
        shape = compute(keys.limit(0))
        names = [c for c in shape.columns if c not in self.by]
        check = F.xxhash64(*self.by, _KEY, *names)
        if self._exists(spark):
            kinds = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in shape.schema), f"{_KEY} string, {_CHECK} long, {_PART} int"])
            there = spark.read.schema(kinds).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).parquet(self.root).filter(F.col(_CHECK) == check)
        else:
            there = shape.limit(0).select("*", F.lit("").alias(_KEY), F.lit(0).cast("long").alias(_CHECK), F.lit(0).alias(_PART))
        own = keys.withColumnRenamed("key", _KEY)
        valid = there.join(own, [*self.by, _KEY], "left_semi")
        wanted = cut(own.join(valid.select(*self.by, _KEY).distinct(), [*self.by, _KEY], "left_anti"))
        self.computed = wanted.count()
        if not self.computed:
            return valid.select(*shape.columns)
        fresh = compute(wanted.withColumnRenamed(_KEY, "key")).join(wanted, self.by)
        fresh = fresh.select(*shape.columns, _KEY, check.alias(_CHECK), self._part().alias(_PART))
        # What stays in the folders that change; the checkpoint ends their lineage before they are rewritten.
        touched = wanted.select(self._part().alias(_PART)).distinct()
        kept = cut(valid.join(F.broadcast(touched), _PART, "left_semi").select(*fresh.columns))  # one row a folder at most
        rows = kept.unionByName(fresh).repartition(_PART)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(_PART).parquet(self.root)
        whole = spark.read.schema(rows.schema).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).parquet(self.root)
        return whole.filter(F.col(_CHECK) == check).join(own, [*self.by, _KEY], "left_semi").select(*shape.columns)

    def held(self, keys: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """:meth:`load`, kept in executor memory as well until the cache is closed."""
        out = self.load(keys, compute).persist()
        self._held.append(out)
        return out
