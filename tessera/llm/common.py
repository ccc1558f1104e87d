"""What the operators share: reading tables, cutting lineage in shared storage, private column names."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Prefix of every column that an operator adds for its own use; input columns may bear any other name.
OWN = "__tsr_"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a session on one machine (tests)
    gets a folder of its own; on a cluster that is an error, as executors would not see such a folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Bytes of rows that go to a Python worker at a time; a row beyond that goes alone.
BATCH_BYTES = 8 << 20


def lean_batches(spark: SparkSession) -> None:
    """Hold Arrow batches to BATCH_BYTES in this session, if they aren't held to less: long texts are common here."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def slices(batches: Iterator[pa.Array], size: int) -> Iterator[pa.Array]:
    """The same rows in arrays of about `size` bytes of text, or of one row."""
    for a in batches:
        end = np.cumsum(pc.fill_null(pc.binary_length(a), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 8)
        cuts = [*np.unique(end // size, return_index=True)[1].tolist(), len(a)]
        for x, y in zip(cuts, cuts[1:]):
            yield a.slice(x, y - x)


def written(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: it is computed once, survives lost executors, and has a known size.

    files: how many at most, for tables that are small beside the shuffle partitions they come from: a file costs a task, a
    round trip to the store and, in local ones, a process. The files go when the application ends (best effort).
    """
    df = df.coalesce(files) if files else df
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete the files behind a table made by written(), once nothing will read it again."""
    for f in {x.rpartition("/")[0] for x in df.inputFiles()}:
        _remove(df.sparkSession, f)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit; the folder's owner cleans up then
        pass


def pieces(n: int, per: int, least: int = 1) -> int:
    """Into how many parts n rows go at about `per` rows a part."""
    return max(least, -(-n // per))


def words_of(col):
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(col, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
