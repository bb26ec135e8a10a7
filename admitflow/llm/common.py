"""Shared helpers: scratch tables in the cluster's checkpoint folder, running
totals over numbered parts, and binary codecs used inside tasks."""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir


class Scratch:
    """Parquet tables of one operator run, in a folder of its own below
    ``spark.checkpoint.dir``, which driver and executors share. Written
    tables survive lost executors; ``drop`` removes one that is used up."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def table(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        """Write ``df`` and read it back: the lineage ends here."""
        df.write.mode("overwrite").option("compression", codec).parquet(self.path(name))
        return self.read(name, df.schema)

    def read(self, name: str, schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for n in names:
            p = jvm.org.apache.hadoop.fs.Path(self.path(n))
            p.getFileSystem(conf).delete(p, True)


def shuffle_partitions(spark: SparkSession) -> int:
    """The cluster's setting; it is sized with the data there."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def range_bounds(df: DataFrame, col: str, parts: int) -> list[int]:
    """At most ``parts - 1`` ascending cut values of a long column, from an
    approximate quantile sketch over all its rows (one aggregate, a bounded
    result)."""
    if parts < 2:
        return []
    qs = [i / parts for i in range(1, parts)]
    got = df.select(F.percentile_approx(F.col(col), qs, 10 * max(parts, 1000)).alias("q")).first()["q"]
    return sorted(set(got or []))


def bucket_of(col, bounds: list[int]):
    """Number of cut values at or below the column: ranges (, b0), [b0, b1), ...
    A binary search, so a row costs the logarithm of the ranges' number."""
    if not bounds:
        return F.lit(0)
    cuts = F.lit(np.asarray(bounds, dtype="int64"))
    steps = F.lit(np.asarray([1 << k for k in reversed(range(len(bounds).bit_length()))], dtype="int32"))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(cuts, at + step - 1) <= col, at + step).otherwise(at))


def pack_ints(a: np.ndarray, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(np.ascontiguousarray(a).tobytes())


def unpack_ints(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(b)), dtype=dtype)


def crc(data) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF
