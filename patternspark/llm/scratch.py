"""Tables written between the steps of an operator, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows in one Arrow batch, and its bytes, so that long texts don't add up in a Python worker.
ARROW_ROWS = 2000
ARROW_BYTES = 4 << 20

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a temporary folder where that is unset (local runs, tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="patternspark-"))
    return _own[0]


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever they start."""
    if getattr(spark.sparkContext, "_patternspark_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="patternspark-zip-"), "patternspark_workers.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))
    spark.sparkContext._patternspark_shipped = True


def bound_batches(spark: SparkSession) -> None:
    """Bounds for what Python workers get at once; they hold for the session, as plans read them when they run."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """A folder of written tables: losing an executor loses none of them, and lineage ends there.

    Operators delete tables that nothing reads any more. Those that a result still reads stay until clear().
    """

    made: list[str] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        Scratch.made.append(self.path)

    def written(self, df: DataFrame, name: str) -> DataFrame:
        self._n += 1
        path = f"{self.path}/{self._n:03d}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        """Delete written tables that no later plan reads."""
        for table in tables:
            for path in {f.rpartition("/")[0] for f in table.inputFiles()}:
                _delete(self.spark, path)


def clear(spark: SparkSession) -> None:
    """Delete the folders of all operators that this process has run: to be called when their results are written."""
    while Scratch.made:
        _delete(spark, Scratch.made.pop())
