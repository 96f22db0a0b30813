"""Make this package importable in Python workers."""

from __future__ import annotations

import atexit
import os
import shutil
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def prepare_workers(spark: SparkSession) -> None:
    """Add the folder of this package to the path of the session's Python workers.

    It is needed where the package isn't installed; on a cluster that ships it with
    ``--py-files`` the additional entry has no effect.
    """
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in known:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, known)])


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; a temporary one only
    in local mode."""
    import tempfile

    if given := spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return given
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    path = tempfile.mkdtemp(prefix="chirpline-")
    atexit.register(shutil.rmtree, path, True)
    return path


def committed(spark: SparkSession, path: str) -> list[str]:
    """The folders below a path that a writer has completed, by name."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    top = hadoop.Path(path)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(top):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(top) if fs.exists(hadoop.Path(s.getPath(), "_SUCCESS")))


def removed_at_exit(path: str) -> str:
    """A local folder that goes when Python ends; others are left to the cluster's own rules."""
    atexit.register(shutil.rmtree, path.removeprefix("file://"), True)
    return path
