"""Session settings and the shared scratch folder."""

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_session(app="threadloom", master=None, **conf):
    """Session with adaptive execution on and UTC as the session zone.

    Shuffle partitions stay at Spark's default here: adaptive execution coalesces them.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # split a hot key even where that costs one more shuffle
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.session.timeZone": "UTC",
        # ids remembered by a stream live on disk, not on the heap
        "spark.sql.streaming.stateStore.providerClass": (
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
        ),
        **{key.replace("__", "."): value for key, value in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark, label):
    """New folder for intermediate tables, under the shared ``spark.checkpoint.dir``.

    A temporary folder of this machine is used only in local mode with that setting unset.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.gettempdir()
    return f"{base.rstrip('/')}/threadloom/{label}-{uuid.uuid4().hex}"


def materialize(frame, label):
    """Write ``frame`` once as parquet in the shared folder and read it back.

    Cuts the lineage in a way that survives lost executors.
    """
    path = scratch_dir(frame.sparkSession, label)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def _path(spark, path):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()), found


def path_exists(spark, path):
    store, found = _path(spark, path)
    return store.exists(found)


def is_written(spark, path):
    """Whether a write to ``path`` ran to its end."""
    return path_exists(spark, f"{path}/_SUCCESS")


def remove_path(spark, path):
    """Remove a folder with all it holds, if it is there."""
    store, found = _path(spark, path)
    store.delete(found, True)
