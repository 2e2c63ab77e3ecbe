"""Helpers shared by the text operators: where intermediate tables go, and small Column idioms."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, and its complement, as the contracts define words.
SPACE_CLASS = "\\x20\\x09-\\x0D"
WORD_PATTERN = f"[^{SPACE_CLASS}]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. A temporary one is made only for a local master, where driver and executors
    are one process; a cluster without the setting is refused, as its executors could not read each other's files."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    found = tempfile.mkdtemp(prefix="factorloom-")
    spark.sparkContext.setCheckpointDir(found)
    return found


#: Paths of the tables stored inside ``released``, while it runs.
_held: ContextVar[list[str] | None] = ContextVar("held", default=None)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a Parquet table in the shared folder and reads it back, which cuts the lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (held := _held.get()) is not None:
        held.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Removes the tables that are stored in its body when that ends. What is to last must have been written by then."""
    paths: list[str] = []
    before = _held.set(paths)
    try:
        yield
    finally:
        _held.reset(before)
        for path in paths:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once for each row, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, start: Column, add: Callable[[Column, Column], Column], block: int = 128) -> Column:
    """The running fold of an array by an associative ``add`` whose neutral element is ``start``.

    ``aggregate`` would copy its result for every element. Here elements are folded inside blocks, and only one
    element a block is appended, so that an array of n costs n * block / 2 + (n / block) ** 2 / 2 steps.
    """

    def whole(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / block).cast("int")), lambda k: F.slice(v, k * block + 1, block))

        def of_blocks(parts: Column) -> Column:
            totals = F.transform(parts, lambda p: F.aggregate(p, start, add))
            before = F.aggregate(totals, F.array(start), lambda acc, t: F.concat(acc, F.array(add(F.get(acc, F.size(acc) - 1), t))))
            return let(
                before,
                lambda base: F.flatten(
                    F.transform(parts, lambda p, k: F.transform(p, lambda x, i: F.aggregate(F.slice(p, 1, i + 1), F.get(base, k), add)))
                ),
            )

        return F.when(F.size(v) > 0, let(blocks, of_blocks)).otherwise(F.slice(v, 1, 0))

    return let(values, whole)


def text_or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, in order."""
    return F.filter(F.split(text, f"[{SPACE_CLASS}]+"), lambda w: w != "")



def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
