"""Reading tables, and a catalogue of what was read as a DataFrame."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: The tables of the test data.
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalogue(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, ordinal, column_name, type, nullable) of each table, from schemas alone: no data is read."""
    rows = [(t, k + 1, f.name, f.dataType.simpleString(), f.nullable) for t, df in tables.items() for k, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "table_name string, ordinal long, column_name string, type string, nullable boolean")


def checkpoint_dir(spark) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session. Where it is unset, one is made if Spark runs in this process alone, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        at = spark.sparkContext.getCheckpointDir()
    return at
