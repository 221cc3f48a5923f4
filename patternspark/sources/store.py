"""Tables of rules and trials."""

from __future__ import annotations

import hashlib
import json
import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TRIALS = ", ".join((
    "config_hash string, config string, cuts int, selected int, rules int, accuracy double, f1 double, train_accuracy double",
    "gap double, tp long, fp long, fn long, tn long, soft_accuracy double, healthy_accuracy double, sick_accuracy double",
    "seconds double, status string, error string, ts timestamp",
))


_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; with a local master and none set, a temporary folder."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", "") or sc.getConf().get("spark.checkpoint.dir", "")
    if folder:
        return folder.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="patternspark-cut-"))
    return _own[0]


def cut(df: DataFrame) -> DataFrame:
    """df checkpointed in the session's shared folder, so that plans of many rounds stay small and survive lost executors."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A table with a header; without a schema its types are inferred, which reads the files once more."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def config_hash(config: dict) -> str:
    return hashlib.md5(json.dumps(config, sort_keys=True).encode()).hexdigest()[:20]


def log_trials(spark: SparkSession, path: str, rows: list[tuple]) -> None:
    spark.createDataFrame(rows, TRIALS).coalesce(1).write.mode("append").parquet(path)


def latest(log: DataFrame) -> DataFrame:
    """The last row of every configuration."""
    w = Window.partitionBy("config_hash").orderBy(F.desc("ts"))
    return log.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def trials(spark: SparkSession, path: str) -> DataFrame:
    return latest(spark.read.schema(TRIALS).parquet(path))


def leaderboard(log: DataFrame, n: int = 20) -> DataFrame:
    return log.where("status = 'ok'").orderBy(F.desc("accuracy"), F.desc("f1"), "config_hash").limit(n)


def status_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("status").agg(F.count("*").alias("n"))


def top_configs(log: DataFrame, n: int = 5) -> DataFrame:
    """rank, json of the n best trials."""
    # n rows
    best = leaderboard(log, n).withColumn(
        "rank", F.row_number().over(Window.orderBy(F.desc("accuracy"), F.desc("f1"), "config_hash"))
    )
    return best.select("rank", F.to_json(F.struct(*(c for c in log.columns if c != "ts"))).alias("json"))


def save(table: DataFrame, path: str) -> None:
    """A table of rules or cuts."""
    table.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a stored table of rules or cuts, in whatever file system it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
