"""Session settings and the shared scratch folder."""

import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cpus="*", partitions=8, name="podium"):
    """A session for tests and the bench; on a cluster pass your own session instead."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark):
    """The folder all executors can reach: ``spark.checkpoint.dir``.

    Only where none is set and Spark runs on one machine (tests) a local folder is made.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    named = named or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors reach")
        named = tempfile.mkdtemp(prefix="podium-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def scratch(spark, name):
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/podium-{uuid.uuid4().hex}/{name}"


def subfolders(spark, path):
    """Names of the folders directly in ``path``, on any store that Spark reads; none if absent."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(place):
        return []
    return [f.getPath().getName() for f in store.listStatus(place) if f.isDirectory()]


def pinned(rows):
    """Write ``rows`` to the shared folder once and go on from the files.

    Needed where a later step must see exactly the same partitioning again.
    """
    shared_dir(rows.sparkSession)
    return rows.checkpoint()
