"""Tables that an operator writes for itself, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and the master is local, as in tests, a folder of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="linesmith-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder; cuts the lineage and survives the loss of executors."""
    path = f"{shared_dir(df.sparkSession)}/linesmith-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Committed:
    """Tables of numbered batches in a folder, of which readers see only whole ones.

    A batch is written to a folder of its own; then a small file that names it is moved into place, which either happens or does not.
    A batch that fails on its way leaves nothing that is read, and one that is repeated takes its former self's place.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self._spark, self._folder = spark, folder
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = lambda name: hadoop.Path(f"{folder}/{name}")
        self._files = hadoop.Path(folder).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def write(self, df: DataFrame, number: int) -> None:
        data, draft, place = f"data/{number}-{uuid.uuid4().hex}", self._path(f"_draft-{uuid.uuid4().hex}"), self._path(f"committed/{number}")
        df.write.parquet(f"{self._folder}/{data}")
        out = self._files.create(draft)
        out.write(bytearray(data, "utf-8"))
        out.close()
        self._files.mkdirs(place.getParent())
        self._files.delete(place, False)
        if not self._files.rename(draft, place):
            raise OSError(f"batch {number} was written but could not be committed in {self._folder}")

    def numbers(self) -> list[int]:
        """The committed batches in order."""
        parent = self._path("committed")
        found = self._files.listStatus(parent) if self._files.exists(parent) else []
        return sorted(int(f.getPath().getName()) for f in found if f.getPath().getName().isdigit())

    def _data(self, number: int) -> str:
        file = self._files.open(self._path(f"committed/{number}"))
        try:
            return f"{self._folder}/{bytes(file.readAllBytes()).decode()}"
        finally:
            file.close()

    def read(self, number: int, schema=None) -> DataFrame:
        reader = self._spark.read.schema(schema) if schema is not None else self._spark.read
        return reader.parquet(self._data(number))

    def read_all(self, schema=None) -> DataFrame:
        """The rows of all committed batches; without any, an empty table of the schema."""
        numbers = self.numbers()
        if not numbers:
            return self._spark.createDataFrame([], schema)
        reader = self._spark.read.schema(schema) if schema is not None else self._spark.read
        return reader.parquet(*(self._data(n) for n in numbers))
