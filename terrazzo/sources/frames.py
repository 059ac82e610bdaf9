"""Tables in: schema resolution, stable row ids, deterministic sampling, fingerprints."""

from __future__ import annotations

import tempfile
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import normalized

_NUMERIC = ("byte", "short", "integer", "long", "float", "double", "decimal")


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder, NaN normalized to NULL."""
    return normalized(spark.read.parquet(f"{folder}/{name}.parquet"))


def from_pandas(spark: SparkSession, frame) -> DataFrame:
    """An in-memory frame or 2-d array; unnamed columns become x0, x1, ..."""
    import pandas as pd

    if not isinstance(frame, pd.DataFrame):
        frame = pd.DataFrame(frame)
        frame.columns = [f"x{i}" for i in range(frame.shape[1])]
    return normalized(spark.createDataFrame(frame))


def row_id(df: DataFrame) -> DataFrame:
    """``df`` with row_id, a hash of all its columns: the same after any recomputation."""
    return df.withColumn("row_id", F.xxhash64(*df.columns))


#: Fixed value: the prime below which numbers of rows are drawn.
PRIME = 2**31 - 1


def hash31(*key: Column) -> Column:
    """A number below ``PRIME`` from an MD5 digest of the key, which SQL engines can repeat."""
    digest = F.md5(F.concat_ws("|", *(k.cast("string") for k in key)).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint") % F.lit(PRIME)


def unit_hash(*key: Column, seed: int = 0) -> Column:
    """A number in [0, 1) from a digest of seed and key: the engine's only source of chance."""
    return hash31(F.lit(seed), *key).cast("double") / float(PRIME)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage through the folder that the driver and all executors share (``spark.checkpoint.dir``).

    Only on one machine a temporary folder takes its place where that is unset;
    on a cluster without one, ``df`` keeps its lineage.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            return df
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="terrazzo-"))
    return df.checkpoint(eager=True)


@dataclass(frozen=True)
class Schema:
    continuous: tuple[str, ...]
    categorical: tuple[str, ...]

    @property
    def names(self) -> tuple[str, ...]:
        return self.continuous + self.categorical


def resolve(df: DataFrame, features: list[str | int], categorical: list[str | int] = ()) -> Schema:
    """Features by name or position; booleans, non-numbers and those declared are categorical."""
    name = lambda f: df.columns[f] if isinstance(f, int) else f
    kinds = {f.name: f.dataType.typeName() for f in df.schema}
    names, declared = [name(f) for f in features], {name(f) for f in categorical}
    unknown = [n for n in [*names, *declared] if n not in kinds]
    if unknown:
        raise ValueError(f"unknown columns {unknown}")
    is_category = lambda n: n in declared or not kinds[n].startswith(_NUMERIC)
    return Schema(tuple(n for n in names if not is_category(n)), tuple(n for n in names if is_category(n)))


def split(df: DataFrame, shares: dict[str, float], key: str = "row_id", seed: int = 0) -> dict[str, DataFrame]:
    """Disjoint parts by hash; the shares must not exceed one in total, the rest is "fit"."""
    if sum(shares.values()) >= 1 or min(shares.values(), default=0) < 0:
        raise ValueError("shares must leave rows to fit")
    place, low, parts = unit_hash(F.col(key), seed=seed), 0.0, {}
    for name, share in shares.items():
        parts[name] = df.where((place >= low) & (place < low + share))
        low += share
    return parts | {"fit": df.where(place >= low)}


def subsample(df: DataFrame, share: float, key: str = "row_id", seed: int = 0) -> DataFrame:
    return df.where(unit_hash(F.col(key), seed=seed) < share)


def bootstrap(df: DataFrame, replicates: int, key: str = "row_id", seed: int = 0) -> DataFrame:
    """``df`` once for each replicate and draw: with column ``replicate``, each row Poisson(1) times."""
    u = unit_hash(F.col("replicate"), F.col(key), seed=seed)
    cdf, p, total = [], 0.36787944117144233, 0.0
    for k in range(12):
        p = p if k == 0 else p / k
        total += p
        cdf.append(total)
    times = sum((F.when(u >= c, 1).otherwise(0) for c in cdf[1:]), F.when(u >= cdf[0], 1).otherwise(0))
    dealt = df.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("_times", times)
    return dealt.where("_times > 0").withColumn("_draw", F.explode(F.sequence(F.lit(1), F.col("_times")))).drop("_times", "_draw")


def undersample(df: DataFrame, label: str, key: str = "row_id", seed: int = 0) -> DataFrame:
    """Each class cut to about the rarest class's count: rows with the least hashes, by a threshold for each class, not by a window."""
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}  # one row for each class
    least = min(counts.values(), default=0)
    share = F.lit(0.0)
    for value, n in counts.items():
        same = F.col(label).isNull() if value is None else F.col(label) == F.lit(value)
        share = F.when(same, F.lit(least / n)).otherwise(share)
    return df.where(unit_hash(F.col(key), seed=seed) < share)


def fingerprint(df: DataFrame) -> DataFrame:
    """n_rows, n_columns and an order-free checksum."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).cast("string").alias("checksum"))
