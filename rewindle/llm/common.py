"""Intermediate tables and small column helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that ends a word: blank and the control characters 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path under ``spark.checkpoint.dir``; the setting is made here only where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="checkpoint-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends there, and rows stay as they are."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def small_batches(spark: SparkSession, most: str = "8m") -> Iterator[None]:
    """Inside, Spark hands Python at most about ``most`` bytes at once, not only 10,000 rows, which may hold long lists."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, most)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by ``written`` once nothing reads it any more."""
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    with contextlib.suppress(Exception):
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = hadoop(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


_SHIPPED: set[str] = set()

def ready(spark: SparkSession) -> None:
    """Give executors this package, once per application."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        top = Path(__file__).resolve().parents[1]
        to = tempfile.mkdtemp(prefix="package-")
        copy = shutil.copytree(top, Path(to, "code", top.name), ignore=shutil.ignore_patterns("__pycache__"))
        context.addPyFile(shutil.make_archive(str(Path(to, top.name)), "zip", copy.parent))
        _SHIPPED.add(context.applicationId)


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have, whatever its own columns are called."""
    taken = {c.lower() for c in df.columns}
    out: list[str] = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def batches(rows: Iterator, size: int) -> Iterator[list]:
    """Lists of at most ``size`` items."""
    held: list = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield held
            held = []
    if held:
        yield held
