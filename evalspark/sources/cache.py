"""Incremental feature cache: one shard per append, cut by key hash, listed in a log of commits."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.session import durable

BUCKETS = 64
_COMMIT = "seq long, shard string, compacts boolean, schema string"


def representation_key(family: str, options: dict) -> str:
    """Family prefix plus 16 hex digits of the sha256 of the sorted options."""
    return f"{family}_{hashlib.sha256(json.dumps(options, sort_keys=True).encode()).hexdigest()[:16]}"


class FeatureCache:
    """``compute`` maps a one-column frame of keys to (key, features); only keys never seen are computed.

    An append writes a shard folder below ``shards`` (subfolders by key hash) and then its commit below ``commits``, named
    by the next free number. Readers see committed shards only, so a shard whose job died is never read and its keys
    count as missing again. Commit files are created, never overwritten: of two writers at one number the second takes
    the next one. The copy with the lowest number is the first one and wins; within a shard the smallest features by hash.

    ``fetch`` reads only the subfolders that hold requested keys, and groups only the rows of requested keys. Null keys
    are never computed and get null features. ``compact`` writes one shard with the first copies; later readers start there.
    """

    def __init__(self, spark: SparkSession, root: str, representation: str, key: str = "entity_key", buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.buckets = spark, f"{root}/representation={representation}", key, buckets

    # --- the log ----------------------------------------------------------------------------------------------------

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commits")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _numbers(self) -> list[int]:
        fs, path = self._files()
        return sorted(int(f.getPath().getName().split(".")[0]) for f in fs.listStatus(path)) if fs.exists(path) else []

    def commits(self) -> list:
        """Commits in force, oldest first: those since the last compaction (one small driver row per append)."""
        if not self._numbers():
            return []
        rows = self.spark.read.schema(_COMMIT).json(f"{self.path}/commits").where("seq IS NOT NULL").orderBy("seq").collect()
        start = max((i for i, c in enumerate(rows) if c.compacts), default=0)
        return rows[start:]

    def _commit(self, shard: str, schema: T.StructType, compacts_after: int | None = None) -> int:
        """Publishes a shard under the next free number. A compaction fails if anything was committed since it was read."""
        fs, folder = self._files()
        while True:
            seq = max(self._numbers(), default=-1) + 1
            if compacts_after is not None and seq != compacts_after + 1:
                raise RuntimeError("the cache has grown during its compaction; compact again")
            line = json.dumps({"seq": seq, "shard": shard, "compacts": compacts_after is not None, "schema": schema.json()})
            try:
                out = fs.create(self.spark._jvm.org.apache.hadoop.fs.Path(folder, f"{seq:012d}.json"), False)
            except Py4JJavaError as taken:
                if "AlreadyExists" not in str(taken.java_exception.getClass().getName()):
                    raise
                continue
            out.write(bytearray(line.encode()))
            out.close()
            return seq

    # --- shards -----------------------------------------------------------------------------------------------------

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame) -> str:
        shard = f"shard={uuid.uuid4().hex}"
        rows.withColumn("bucket", self._bucket()).write.partitionBy("bucket").parquet(f"{self.path}/shards/{shard}")
        return shard

    def _read(self, commits: list) -> DataFrame:
        """Rows of committed shards with ``bucket`` (a folder, so filters on it skip files) and the number ``seq``."""
        schema = T.StructType.fromJson(json.loads(commits[0].schema)).add("bucket", T.IntegerType()).add("shard", T.StringType())
        paths = [f"{self.path}/shards/{c.shard}" for c in commits]
        rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/shards").parquet(*paths)
        numbers = [(c.shard.split("=")[1], c.seq) for c in commits]
        return rows.join(F.broadcast(self.spark.createDataFrame(numbers, "shard string, seq long")), "shard").drop("shard")

    def _first_copies(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in (self.key, "bucket", "seq")]
        first = F.min_by(F.struct(*rest), F.struct("seq", F.xxhash64(*rest))).alias("_first")
        return rows.groupBy(self.key).agg(first).select(self.key, *[F.col(f"_first.`{c}`").alias(c) for c in rest])

    def stored(self) -> DataFrame | None:
        """First copy of every committed key; None before the first commit."""
        commits = self.commits()
        return self._first_copies(self._read(commits)) if commits else None

    def _known(self, keys: DataFrame, commits: list) -> DataFrame:
        """First copies of the requested keys, from the subfolders of their hashes alone."""
        wanted = [r[0] for r in keys.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        rows = self._read(commits).where(F.col("bucket").isin(wanted))
        return self._first_copies(rows.join(keys, [self.key, "bucket"], "left_semi"))

    # --- use --------------------------------------------------------------------------------------------------------

    def fetch(self, wanted: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
        """(features for every wanted row, keys computed now). ``wanted`` may repeat keys and carry other columns."""
        keys = durable(wanted.select(self.key).where(F.col(self.key).isNotNull()).distinct().withColumn("bucket", self._bucket()))
        commits = self.commits()
        missing = keys
        if commits:
            missing = durable(keys.join(self._known(keys, commits).select(self.key), self.key, "left_anti"))
        fresh = compute(missing.select(self.key))
        self._check_schema(fresh, commits)
        if missing.isEmpty():
            added = fresh.select(self.key).limit(0)
        else:
            shard = self._write(fresh)
            seq = self._commit(shard, fresh.schema)
            commits = self.commits()
            self._check_schema(fresh, commits)
            added = self._read([c for c in commits if c.seq == seq]).select(self.key).distinct()
        known = self._known(keys, commits) if commits else fresh
        return wanted.join(known, self.key, "left"), added

    def _check_schema(self, fresh: DataFrame, commits: list) -> None:
        kinds = lambda s: [(f.name, f.dataType) for f in s.fields]
        for c in commits[:1]:
            have = T.StructType.fromJson(json.loads(c.schema))
            if kinds(have) != kinds(fresh.schema):
                raise ValueError(f"stored schema {have.simpleString()} differs from {fresh.schema.simpleString()}")

    def compact(self) -> int | None:
        """Writes the first copies as one shard from which readers start; old shards stay for running readers."""
        seen, commits = max(self._numbers(), default=-1), self.commits()
        if not commits:
            return None
        schema = T.StructType.fromJson(json.loads(commits[0].schema))
        shard = self._write(self._first_copies(self._read(commits)).select(*schema.fieldNames()))
        return self._commit(shard, schema, seen)


def feature_schema(key: str, dtype: T.DataType = T.FloatType()) -> T.StructType:
    return T.StructType([T.StructField(key, T.StringType()), T.StructField("features", T.ArrayType(dtype))])
