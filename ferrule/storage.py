"""Tables by name, and intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Only a session in one process may do without; it gets a local folder."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = getattr(spark, "_ferrule_dir", None)
        if not at:
            at = spark._ferrule_dir = "file://" + tempfile.mkdtemp(prefix="ferrule-")
    return at.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet and read back: its lineage ends there, so a lost executor costs a re-read."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._ferrule_path = path
    return out


def free(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` made, once nothing that is still to run reads them."""
    for df in tables:
        if path := getattr(df, "_ferrule_path", None):
            context = df.sparkSession.sparkContext
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


PIECE, MOST = 32 << 20, 100_000  # bytes of input, as stored, of a task after an exchange; tasks (Spark calls a size that it doesn't know enormous)


def spread(df: DataFrame, *keys: str, small: bool = False) -> DataFrame:
    """``df`` spread by the keys: over the session's number of tasks, which Spark may lessen, or over more where these would be too few
    for the size of the tables that are read. ``small``: tasks that hold what they get aren't put together, so Spark must not lessen them."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    n = -(-sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())) // PIECE)
    own = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys) if own < n <= MOST else df.repartition(own, *keys) if small else df.repartition(*keys)


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(docs: DataFrame) -> DataFrame:
    """``docs``; texts go to the Python workers in batches of some 8 MB, unless the session says otherwise. The number of rows
    alone, by which batches are cut without this, doesn't bound what a batch of long texts takes."""
    conf = docs.sparkSession.conf
    if conf.get(_BATCH, "1") == "1":  # unset
        conf.set(_BATCH, str(8 << 20))
    return docs
