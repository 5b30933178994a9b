"""What several operators share: word rule, shared folders, small file helpers."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from typing import ClassVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

#: Characters that part words, lines' ends to strip; and the words themselves.
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A document without an id ranks after all others.
LAST_ID = 9223372036854775807


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.  Where that is unset: a folder of our own with a local
    master (tests), an error with any other, as executors would not see it."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    root = getattr(shared_root, "own", None)
    if root is None:
        path = tempfile.mkdtemp(prefix="quire-")
        atexit.register(shutil.rmtree, path, True)
        root = shared_root.own = f"file://{path}"
        spark.sparkContext.setCheckpointDir(root)
    return root


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh name below the shared folder."""
    return f"{shared_root(spark)}/quire/{label}-{uuid.uuid4().hex}"


def stash(df: DataFrame, path: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Workspace:
    """The folder of one run below the shared folder.  It goes at the end, also after a failure; what
    ``result`` stores stays until the program ends, as the rows returned are read from there."""

    kept: ClassVar[list[tuple[SparkSession, str]]] = []

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.label, self.folder = spark, label, new_folder(spark, label)

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, kind, *_) -> None:
        with contextlib.suppress(*((Exception,) if kind else ())):  # a failed run's own error matters more
            remove(self.spark, self.folder)

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def stash(self, df: DataFrame, name: str) -> DataFrame:
        return stash(df, self.path(name))

    def drop(self, *names: str) -> None:
        remove(self.spark, *map(self.path, names))

    def result_folder(self) -> str:
        """A folder beside this one, removed at the program's end."""
        if not self.kept:
            atexit.register(self._forget)
        path = new_folder(self.spark, f"{self.label}-result")
        self.kept.append((self.spark, path))
        return path

    def result(self, df: DataFrame) -> DataFrame:
        return stash(df, self.result_folder())

    @classmethod
    def _forget(cls) -> None:
        for spark, path in cls.kept:
            with contextlib.suppress(Exception):  # the JVM may be gone
                remove(spark, path)


def fresh(name: str, taken: list[str]) -> str:
    """name, with as many underscores behind it as make it differ from all names taken."""
    lowered = {t.lower() for t in taken}
    while name.lower() in lowered:
        name += "_"
    return name


def whole(name: str = "row") -> Column:
    """All columns as one struct, so that no column of ours can clash with one of theirs."""
    return F.struct("*").alias(name)


def row_key(docs: DataFrame, row: str = "row") -> Column:
    """128 bits of all columns of the struct ``row`` (of docs' columns): rows with one key are equal in
    every column and can stand for each other.  Nulls count, also within nested values."""
    parts = []
    for f in docs.schema.fields:
        c = F.col(row)[f.name]
        parts += [c.isNull(), c if isinstance(f.dataType, AtomicType) else F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"})]
    return F.struct(F.xxhash64(F.lit(1), *parts).alias("k1"), F.xxhash64(F.lit(7), *parts).alias("k2"))


def release(spark: SparkSession) -> None:
    """Ask the driver's JVM to drop shuffle files that nothing refers to any more."""
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
