"""What the operators share: the shared folder, cut lineage, and string helpers."""

from __future__ import annotations

import atexit
import re
import tempfile
import unicodedata
import uuid
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Code points below this (Latin Extended-A is the last block) are handled by our own fast paths, which tests hold against the libraries.
LATIN_END = 0x180
NOT_LATIN = re.compile(f"[^\x00-{chr(LATIN_END - 1)}]")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset (tests).

    Only a local master may do without the setting: on a cluster a folder of one machine would split a table.
    """
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="verdigris-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Rows and bytes of an Arrow batch of documents.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python in batches of bounded size: the session's settings are lowered where they're higher."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key).lower().removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def lean(run):
    """A function for mapInArrow that gives its memory back to the system when its task ends: Python workers live on."""

    def wrapped(batches):
        import ctypes
        import gc

        import pyarrow

        try:
            yield from run(batches)
        finally:
            gc.collect()
            pyarrow.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # not every C library has it
                pass

    return wrapped


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def open_fs(path: str) -> tuple:
    """(file system, path in it) of a path in the shared folder, for Python code on driver or executors."""
    import pyarrow.fs

    if path.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(path)


#: Paths written and not yet removed, in the order of writing.
KEPT: dict[str, None] = {}


def new_path(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder, removed by drop_since or when the driver's process ends."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    KEPT[path] = None
    return path


def drop_paths(paths: Iterable[str]) -> None:
    for path in list(paths):
        KEPT.pop(path, None)
        try:
            if (spark := SparkSession.getActiveSession()) is not None:
                drop_path(spark, path)
        except Exception:  # noqa: BLE001  the JVM may have gone before
            pass


atexit.register(lambda: drop_paths(KEPT))


def stored(df: DataFrame, what: str, clear: Iterable[str] = ()) -> DataFrame:
    """The rows, written once as Parquet to the shared folder and read again: cuts lineage and survives lost executors.

    clear: paths that nothing reads once the rows are written; they're removed.
    """
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.parquet(path)
    drop_paths(p for p in clear if p != path)
    return spark.read.schema(df.schema).parquet(path)


def kept_since(before: Iterable[str]) -> list[str]:
    """Paths written after the snapshot (list(KEPT)) was taken."""
    known = set(before)
    return [p for p in KEPT if p not in known]


def free_name(df: DataFrame, *names: str) -> list[str]:
    """Column names that df doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def broadcast_if_small(df: DataFrame, rows: int, row_bytes: int, limit: int = 32 << 20) -> DataFrame:
    """A broadcast hint where rows * row_bytes, measured by the caller, is under limit; else Spark's shuffle join."""
    return F.broadcast(df) if rows * row_bytes <= limit else df


def quoted(name: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """docs with a column `name` (struct of two numbers) that tells rows apart and is the same whenever they're read.

    Rows of files are told by their file and place in it, which costs nothing; where Spark has no such place (rows that
    are computed, or a column _metadata of the caller's own), they're numbered and written first.
    """
    spark = docs.sparkSession
    if not any(c.lower() == "_metadata" for c in docs.columns):
        try:
            place = docs.select("*", F.struct(F.xxhash64("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("r")).alias(name))
            place.schema  # noqa: B018  resolved here, so that a missing place shows
            return place
        except AnalysisException:
            pass
    row = F.struct(F.lit(0).cast("long").alias("f"), F.monotonically_increasing_id().alias("r"))
    return stored(docs.select("*", row.alias(name)), "numbered")


def without_rows(docs: DataFrame, rows: DataFrame, name: str) -> DataFrame:
    """Numbered docs without the rows whose number is among rows (one column), and without the number.

    The numbers are written first, so that Spark knows their size: below its limit they're broadcast and the documents
    aren't shuffled; beyond, both sides are.
    """
    known = stored(rows.toDF(name).distinct(), "dropped")
    return docs.join(known, docs[name] == known[name], "left_anti").drop(name)


def char_class(prefix: str, end: int = LATIN_END) -> str:
    """A regular expression's class of the characters below end whose Unicode category starts with prefix."""
    return "".join(re.escape(chr(c)) for c in range(end) if unicodedata.category(chr(c)).startswith(prefix))
