"""What the corpus operators share: session settings and tables written to the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of one Arrow batch, whichever is reached first. Texts can be long, so it is the bytes that bound their batches.
ARROW_ROWS, ARROW_BYTES = 8192, 4 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Sets the Arrow batch size for tables of texts; call it before a plan that sends texts to Python."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Where it is unset and the master is local, as in tests, a folder of our own is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="linesmith-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


#: Spark then deletes the shuffle files of an execution as it ends; what it wrote is read from the shared folder.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _write(df: DataFrame, path: str) -> DataFrame:
    spark = df.sparkSession
    before = spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEAN_UP)
        else:
            spark.conf.set(_CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def stored(df: DataFrame) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts the lineage, survives the loss of executors, and frees the shuffle files."""
    return _write(df, f"{shared_dir(df.sparkSession)}/linesmith-{uuid.uuid4().hex}")


class Scratch:
    """Stored tables of one run of an operator, of which those that nothing reads any more are deleted."""

    def __init__(self, spark: SparkSession) -> None:
        self._folder = f"{shared_dir(spark)}/linesmith-{uuid.uuid4().hex}"
        self._spark = spark
        self._paths: list[tuple[DataFrame, str]] = []

    def stored(self, df: DataFrame) -> DataFrame:
        path = f"{self._folder}/{len(self._paths)}"
        out = _write(df, path)
        self._paths.append((out, path))
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables; whatever was made from them must be stored by now."""
        for table in tables:
            path = self._spark._jvm.org.apache.hadoop.fs.Path(next(p for df, p in self._paths if df is table))
            path.getFileSystem(self._spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
