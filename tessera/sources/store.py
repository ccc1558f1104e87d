"""Small files of the catalogue, through Hadoop's file systems, so that any store Spark can write holds them."""

from __future__ import annotations

import re
import tempfile
import threading
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

#: A claim on a file is held for one read and one write; one that is older was left by a writer that died.
CLAIM_SECONDS = 60
_HERE = threading.Lock()


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write beside the file and rename over it, so that a reader sees the old or the new text."""
    fs, p = _fs(spark, f"{path}.next")
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()
    jvm = spark.sparkContext._jvm
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(p, _fs(spark, path)[1], options)


def _claimed(fs, claim) -> bool:
    """Whether this writer made the claim file, which only one can."""
    try:
        fs.create(claim, False).close()
        return True
    except Py4JJavaError as e:
        if not re.search("AlreadyExists|AlreadyBeingCreated", str(e.java_exception)):
            raise
    for f in fs.globStatus(claim) or []:  # none, if it has been given up by now
        if time.time() - f.getModificationTime() / 1000 > CLAIM_SECONDS:
            fs.delete(claim, False)
    return False


def swap(spark: SparkSession, path: str, text: str, unchanged: Callable[[str | None], bool]) -> bool:
    """Write the file if its text is still as the writer knows it, and tell whether it was: check and write are one step.

    Writers exclude each other by a claim file, which the store makes only where there is none; threads of one process
    by a lock, as a local file system looks and makes in two steps.
    """
    fs, claim = _fs(spark, f"{path}.claim")
    with _HERE:
        while not _claimed(fs, claim):
            time.sleep(0.02)
        try:
            if not unchanged(read_text(spark, path)):
                return False
            write_text(spark, path, text)
            return True
        finally:
            fs.delete(claim, False)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def size(spark: SparkSession, path: str) -> int:
    fs, p = _fs(spark, path)
    return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


def names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []


def workspace(spark: SparkSession) -> str:
    """A new folder below the one that all executors share. Where spark.checkpoint.dir is unset, a session on one machine (tests)
    gets a local one; on a cluster that is an error."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared}/engine-{uuid.uuid4().hex}"
