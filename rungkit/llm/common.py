"""Shared helpers: keyed column selection, scratch tables, exact k-th key."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rungkit.operators.materialize import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_shipped: set[str] = set()

#: rows that share a crc32 remainder of 2 are held out of every fit
HELD_OUT_MOD, HELD_OUT_REMAINDER = 4, 2


ARROW_BYTES = 8 << 20


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""
    def deco(fn):
        def run(spark, sf_dir):
            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def ship_package(spark: SparkSession) -> None:
    """Hand the package's modules to the Python workers through Spark's own
    file distribution, so that executors need no checkout on their path."""
    import rungkit
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(rungkit.__file__).parent
    folder = tempfile.mkdtemp(prefix="rungkit-py-")       # read by the driver only
    target = os.path.join(folder, "rungkit.zip")
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def keyed(df: DataFrame, *cols: str) -> DataFrame:
    """Only ``cols``, under the internal names c0, c1, ... (no clash with
    anything else the input carries)."""
    return df.select(*[df[c].alias(f"c{i}") for i, c in enumerate(cols)])


def held_out(id_col: Column) -> Column:
    """crc32 of the id's decimal text, modulo 4, equals 2 (null id: not held out)."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % HELD_OUT_MOD == HELD_OUT_REMAINDER,
                      F.lit(False))


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write under ``spark.checkpoint.dir`` and read back: computed once,
    lineage cut, safe against lost executors.  Rows reach Python in batches of
    at most ARROW_BYTES meanwhile."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    before = conf.get(key, None)
    conf.set(key, str(min(ARROW_BYTES, int(before or ARROW_BYTES))))
    try:
        return materialize(df, f"llm-{name}")
    finally:
        conf.unset(key) if before is None else conf.set(key, before)


_slot: list = [None, None]


def worker_memo(owner: str | None, make: Callable | None = None):
    """What a Python worker keeps from task to task: one object at a time, so
    that an operator's memo goes when the next operator begins.  ``owner``
    names it (None: nothing is kept); ``make()`` gives a new one."""
    if _slot[0] != owner:
        _slot[:] = [None, None]
        _slot[:] = [owner, make() if make else None]
    return _slot[1]


def discard(df: DataFrame) -> None:
    """Delete the written table ``df`` reads, once all that was made of it is
    written itself."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/rungkit/llm-" in folder:                   # only what saved() wrote
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def uniform_open(*cols: Column, seed: int) -> Column:
    """Deterministic uniform in (0, 1) from the key columns and a seed."""
    h = F.xxhash64(F.lit(seed), *cols)
    return (F.shiftrightunsigned(h, 11).cast("double") + F.lit(0.5)) / F.lit(float(2 ** 53))


def kth_largest(df: DataFrame, col: str, k: int, bits: int = 16) -> float | None:
    """The k-th largest :func:`grid_value` of a double column, None if the
    table has fewer than k rows.

    Radix selection: each round counts rows by the next ``bits`` bits of an
    order-preserving integer image of the double, so at most 2**bits counts
    reach the driver and no task sorts or holds the column.
    """
    v = df.select(_ordered_bits(F.col(col)).alias("v")).where("v is not null")
    lo, hi, left = -(2 ** 62), 2 ** 62, k
    while True:
        width = max(0, (hi - lo).bit_length() - bits)
        part = v.where((F.col("v") >= F.lit(lo)) & (F.col("v") <= F.lit(hi)))
        counts = {r["b"]: r["count"] for r in
                  part.groupBy(F.shiftright("v", width).alias("b")).count().collect()}
        for b in sorted(counts, reverse=True):
            if counts[b] >= left:
                break
            left -= counts[b]
        else:
            return None
        lo, hi = max(lo, b << width), min(hi, ((b + 1) << width) - 1)
        if width == 0:
            return lo / 2 ** 32


def _ordered_bits(c: Column) -> Column:
    """The double on a grid of 2**-32, as bigint; beyond +-2**30 it is cut off."""
    at = F.greatest(F.least(c, F.lit(float(2 ** 30))), F.lit(-float(2 ** 30)))
    return F.when(c.isNotNull(), F.round(at * F.lit(float(2 ** 32))).cast("bigint"))


def grid_value(c: Column) -> Column:
    """The value :func:`kth_largest` compares."""
    return _ordered_bits(c).cast("double") / F.lit(float(2 ** 32))
