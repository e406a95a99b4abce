"""Session helpers shared by the whole library: shared folder, written intermediates, shipping the package."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent
#: Folders of the tables that written() made and remove() has not deleted, as Spark names them.
_written: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir where the session sets it, else (tests, local runs) a local one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    local = f"file://{tempfile.gettempdir()}/tabularium-{os.getuid()}-{spark.sparkContext.applicationId}"
    spark.conf.set("spark.checkpoint.dir", local)
    return local


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors, is computed once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _written.update(x.rsplit("/", 1)[0] for x in out.inputFiles())
    return out


@contextmanager
def setting(spark: SparkSession, name: str, value: object) -> Iterator[None]:
    """A setting of the session for the jobs that are run inside; what it was before comes back."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(value))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def remove(df: DataFrame) -> None:
    """Delete the files of all tables made by written() that df reads, once nothing reads them any more; other inputs stay."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(f)
        if f not in _written:
            continue
        _written.discard(f)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of jobs that are over: Spark's cleaner deletes them once the driver has collected its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, where PYTHONPATH does not already."""
    on_path = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if str(PACKAGE.parent) in on_path or getattr(spark.sparkContext, "_tabularium_shipped", False):
        return
    out = Path(tempfile.mkdtemp(prefix="tabularium-")) / "tabularium_pkg.zip"
    with zipfile.ZipFile(out, "w") as z:
        for f in sorted(PACKAGE.rglob("*.py")):
            z.write(f, f"{PACKAGE.name}/{f.relative_to(PACKAGE)}")
    spark.sparkContext.addPyFile(str(out))
    spark.sparkContext._tabularium_shipped = True
