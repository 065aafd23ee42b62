"""Session helpers: settings for local runs and the shared checkpoint folder."""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import NullType, StructType


def local_session(cores: str | int = "*", app: str = "chirpframe", **conf: str) -> SparkSession:
    """Session for tests and the local bench. On a cluster use the session you are given."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the session names; make one only for a local master."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not context.master.startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder that all executors share.")
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: written to the shared folder, so lost executors do not matter."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared checkpoint folder, for tables that are written and read back."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def stored_rows(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder, and where: a checkpoint in compressed columns that ``drop_folder`` can delete.

    Columns without a type (all null) are left out; inside others they become text, as files have no such type.
    """
    path = shared_path(df.sparkSession, name)
    df = df.select(*[f.name for f in df.schema if f.dataType != NullType()])
    typed = StructType.fromJson(json.loads(re.sub(r'"(type|elementType|keyType|valueType)":"void"', r'"\1":"string"', df.schema.json())))
    df = df.select(*[df[f.name] if f.dataType == df.schema[f.name].dataType else df[f.name].cast(f.dataType) for f in typed])
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder in the shared folder that nothing will read again."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
