"""Helpers shared by the operators: shared storage, word splitting, folds."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six characters that separate words: space, tab, LF, VT, FF, CR.
WORD_SEPARATORS = " \t\n\x0b\f\r"
WORD_SPLIT = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is the session's ``spark.checkpoint.dir``. Where that is unset, a
    temporary folder takes its place if all executors run on this machine
    (``local`` masters), else this raises: a cluster's executors would each
    write to a disk of their own.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = context.getCheckpointDir()
        if not folder:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="terrazzo-")
            context.setCheckpointDir(folder)
    elif not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage through the shared folder; Spark's cleaner removes the files."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once as compressed Parquet in the shared folder and reads it back.

    The files live until the Python process ends, because plans of the caller
    may read them at any time before.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/terrazzo-staged/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    remove_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # noqa: BLE001  the session has already ended
        pass


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path of the shared folder."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def remove_at_end(spark: SparkSession, path: str) -> None:
    """Deletes a path of the shared folder when the Python process ends."""
    atexit.register(_remove, spark, path)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until ``df`` has no column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null or blank: an empty array."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(WORD_SEPARATORS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WORD_SPLIT))


def held_out(doc_id: Column) -> Column:
    """True for the fold that no label is learned from; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fits_broadcast(df: DataFrame, most_rows: int) -> bool:
    """Whether ``df`` has at most ``most_rows`` rows, without counting beyond that."""
    return df.limit(most_rows + 1).count() <= most_rows
