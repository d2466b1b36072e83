"""Session and shared-folder helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

ROCKSDB_PROVIDER = (
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
)

_local_folder: str | None = None


def local_session(cores: int | str = 8, name: str = "wardlight", **conf) -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
        # Rank before the shuffle for limits up to the rate limit, not only 1000.
        .config("spark.sql.optimizer.windowGroupLimitThreshold", "10000")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, from ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster a
    machine-local path would be lost with its executor.
    """
    global _local_folder
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="wardlight-")
    return _local_folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh sub-folder of the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def checkpointed(df):
    """Reliable checkpoint in the shared folder; survives executor loss."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def local_table(spark: SparkSession, rows: list[tuple], ddl: str):
    """Rows held in code as a DataFrame with an exact size.

    Going through Arrow gives a local relation, so Spark knows how small it is
    and broadcasts it by its own size check.
    """
    import pyarrow as pa
    from pyspark.sql import types as T

    schema = T._parse_datatype_string(ddl)
    columns = list(zip(*rows)) if rows else [[] for _ in schema.fields]
    arrow_types = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
    table = pa.table(
        {
            f.name: pa.array(list(values), type=arrow_types[f.dataType.simpleString()])
            for f, values in zip(schema.fields, columns)
        }
    )
    return spark.createDataFrame(table)
