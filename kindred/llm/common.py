"""What the operators of this subpackage share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def bounded_batches(spark: SparkSession, mib: int = 4) -> None:
    """Arrow batches of at most ``mib`` MiB, so that a Python worker's memory
    doesn't depend on how long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mib << 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5000")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, which the cluster shares. One is made here only where the
    session names none and runs on this machine alone, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
            import tempfile

            path = tempfile.mkdtemp(prefix="kindred-checkpoint-")
        sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def until_exit(spark: SparkSession, path: str) -> None:
    """The folder, which must be there, goes when the driver ends."""
    files, place = _file_system(spark, path)
    files.deleteOnExit(place)


def delete(spark: SparkSession, path: str) -> None:
    files, place = _file_system(spark, path)
    files.delete(place, True)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder, in a columnar, compressed table, and read it back.
    This cuts the lineage at files that survive a lost executor. The table goes with
    ``discard``, or when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    until_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    vars(out)["_stored_at"] = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete what ``stored`` wrote; nothing that is still to be read may derive from it."""
    for table in tables:
        if table is not None and (path := vars(table).pop("_stored_at", None)):
            delete(table.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files and broadcasts of rounds that are over.
    It acts when the driver has collected the objects that stood for them, which a small
    driver of a long iteration may otherwise not do for half an hour."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def id_and_text(df: DataFrame, id_col: str, text_col: str, binary: bool = False) -> DataFrame:
    """The key and the text alone, as ``doc_id`` and ``text``; other columns,
    whatever their names, can't clash with what an operator adds."""
    text = F.col(text_col).cast("string")
    return df.select(F.col(id_col).cast("long").alias("doc_id"), (text.cast("binary") if binary else text).alias("text"))


def held_out(id_column, folds: int = 5):
    """True where crc32 of the key's decimal text is 0 modulo ``folds``; false for a null key."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % folds == 0, F.lit(False))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
