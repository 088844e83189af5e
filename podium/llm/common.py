"""Helpers the operators of this folder share."""

from pathlib import Path

from pyarrow import fs

from podium.session import scratch

ROOT = str(Path(__file__).resolve().parents[2])


def importable(spark):
    """Let Python workers that start from now on import this package from where it is here.

    On a cluster the package is installed or sent with --py-files; then this changes nothing.
    """
    paths = spark.sparkContext.environment
    if ROOT not in paths.get("PYTHONPATH", "").split(":"):
        paths["PYTHONPATH"] = ":".join(filter(None, [paths.get("PYTHONPATH"), ROOT]))


def mapped(rows, work, schema):
    """``rows`` through a function over Arrow batches, in tasks."""
    importable(rows.sparkSession)
    return rows.mapInArrow(work, schema)


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(rows, name):
    """Write ``rows`` as Parquet to the shared folder and go on from the files.

    Later steps then neither compute them again nor depend on the executors that made them.
    """
    path = scratch(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def filesystem(path):
    """(file system, path in it) of a path or URI that tasks on any machine can open."""
    if path.startswith("file:"):
        path = "/" + path[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(path)


def in_tasks(files):
    """The rows of a manifest of files spread over the tasks, about one file for each."""
    return files.repartition(max(1, files.count()))


def utf8(text):
    """The UTF-8 bytes of a text; null has none."""
    return b"" if text is None else text.encode()


def free(columns, *names):
    """``names`` changed so that they clash with none of ``columns``."""
    taken = {c.lower() for c in columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found
