"""Session-level helpers: shared materialisation and skew-safe joins.

Nothing here keeps state on an executor. Lineage is cut only by tables written to the folder every
executor shares (``spark.checkpoint.dir``); losing an executor never loses an intermediate result.
"""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


ROOT = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Give this package to the workers, once a context, unless their path has it already."""
    home = str(ROOT.parent)
    sc = spark.sparkContext
    if home in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_weftmark_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="weftmark-ship-")) / "weftmark.zip"
    with zipfile.ZipFile(target, "w") as z:
        for path in sorted(ROOT.rglob("*.py")):
            z.write(path, path.relative_to(ROOT.parent))
    sc.addPyFile(str(target))
    sc._weftmark_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session. A private one is made only where the session names none and runs on this machine
    alone (tests); on a cluster it would be lost with its machine, so there it is an error."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="weftmark-")
    sc.setCheckpointDir(made)
    return made


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of it.

    Its size is that of the compressed files: a bound on nothing that is exploded from it. Joins with such a side take a
    merge hint or a counted size.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weftmark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._weftmark_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete a table made by ``materialize`` that no later plan reads."""
    path = getattr(df, "_weftmark_path", None)
    if path:
        _delete(df.sparkSession, path)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the session may have ended; the folder belongs to it
            return


def skew_join(big: DataFrame, small: DataFrame, key: str, weight: str, parts: int = 2000) -> DataFrame:
    """Inner join of ``big`` with ``small`` on ``key`` where few keys may hold most of ``big``.

    ``small`` carries in ``weight`` how many rows of ``big`` have its key. Keys over 1/``parts`` of the
    summed weight (at most ``parts`` of them) are joined by a broadcast, so their rows never meet in one
    task; the others are joined by a shuffle. ``small`` must be unique on ``key``, or hold few rows a key.
    """
    total = small.agg(F.sum(weight)).scalar()
    hot = small.withColumn("_hot", F.col(weight) * parts > total)
    hot_keys = hot.filter("_hot").drop("_hot")
    rest = hot.filter(~F.col("_hot")).drop("_hot")
    flags = hot_keys.select(F.col(key).alias("_k")).distinct()
    a = big.join(F.broadcast(hot_keys), key)
    cold = big.join(F.broadcast(flags), F.col(key) == F.col("_k"), "left_anti")
    b = cold.join(rest, key)
    return a.unionByName(b)
