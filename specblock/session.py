"""SparkSession factory and session-scoped helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that suit a local run; a cluster sets its own with spark-submit.
LOCAL_CONF = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "8g",
}


def local_session(cores: str = "*", app: str = "specblock", **conf: str) -> SparkSession:
    """A local session with the settings above, overridden by conf."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in {**LOCAL_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints.

    A cluster names it in ``spark.checkpoint.dir``.  Only where nothing names
    one, as in local tests, a fresh temporary folder of this machine is set.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        named = tempfile.mkdtemp(prefix="specblock-checkpoint-")
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df computed once, written to the shared checkpoint folder and read from it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_afresh(df: DataFrame) -> DataFrame:
    """cut() for loops: what comes back forgets the estimated size too.

    A checkpoint keeps the estimate of its plan, and a join's is the product of
    its sides'.  Over rounds of joins the number of digits grows by a constant
    factor, until planning takes longer than the work.
    """
    spark, done = df.sparkSession, cut(df)
    return DataFrame(spark._jsparkSession.createDataFrame(done._jdf.javaRDD(), done._jdf.schema()), spark)


def _on_its_store(spark: SparkSession, path: str):
    """A path and its file system, as Hadoop sees them."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there, there.getFileSystem(spark._jsc.hadoopConfiguration())


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read again; deleted when the session ends, or by discard()."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    there, store = _on_its_store(spark, path)
    store.deleteOnExit(there)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what stored() wrote; df must not be read any more."""
    there, store = _on_its_store(df.sparkSession, df._stored_path)
    store.delete(there, True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one; deleted when the session ends."""
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    there, store = _on_its_store(spark, path)
    store.mkdirs(there)
    store.deleteOnExit(there)
    return path
