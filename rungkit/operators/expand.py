"""Prefix expansion: one row -> base row + rows with growing revealed prefixes.

Pure generator expressions (``posexplode`` of a step sequence, ``slice``,
``array_join``), so expansion is map-only; the global running index over
the expanded rows is a prefix sum of per-parent row counts (no window
over the whole output).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rungkit.functions import text as tx
from rungkit.operators.ordering import key_bucket, prefix_offsets


def _join_slice(arr: Column, start: Column, length: Column, sep: str) -> Column:
    return F.array_join(F.slice(arr, start, length), sep)


def expand_steps(df: DataFrame, answer: str = "answer", first_step: int = 0, sep: str = "\n") -> DataFrame:
    """Line-step expansion.

    ``first_step=0``: base row, then j = 0..n-1 (j=0 repeats the base with an
    empty partial). ``first_step=1``: base row, then j = 1..n (portion 1.0
    with an empty completion). Adds ``j`` (NULL on the base row),
    ``partial_answer``, ``completion``, ``portion``, ``n_steps``, ``pos``.
    """
    steps = F.split(F.col(answer), tx.regex_escape(sep), -1)
    d = df.withColumn("_steps", steps).withColumn("n_steps", F.size("_steps").cast("bigint"))
    last = F.col("n_steps") - (1 if first_step == 0 else 0)
    d = d.select("*", F.posexplode(F.sequence(F.lit(first_step - 1).cast("bigint"), last)).alias("pos", "_j"))
    is_base = F.col("pos") == 0
    j = F.col("_j").cast("int")
    partial = _join_slice(F.col("_steps"), F.lit(1), j, sep)
    completion = _join_slice(F.col("_steps"), j + 1, F.greatest(F.col("n_steps").cast("int") - j, F.lit(0)), sep)
    return d.select(*df.columns, "n_steps", F.col("pos").cast("bigint").alias("pos"),
                    F.when(~is_base, F.col("_j")).alias("j"),
                    F.when(~is_base, partial).alias("partial_answer"),
                    F.when(~is_base, completion).alias("completion"),
                    F.when(~is_base, F.col("_j") / F.col("n_steps")).alias("portion"))


def expand_words_k(df: DataFrame, answer: str = "solution", k: int = 4) -> DataFrame:
    """Word-prefix expansion: base row, then (when there are words) j = 1..k with
    cutoff = ceil(j*n/k) words joined by single spaces; portion = cutoff/n."""
    d = df.withColumn("_w", tx.words(answer)).withColumn("n_words", F.size("_w").cast("bigint"))
    hi = F.when(F.col("n_words") > 0, F.lit(k)).otherwise(F.lit(0))
    d = d.select("*", F.posexplode(F.sequence(F.lit(0), hi)).alias("pos", "_j"))
    is_base = F.col("pos") == 0
    cutoff = F.floor((F.col("_j") * F.col("n_words") + F.lit(k - 1)) / F.lit(k)).cast("int")
    partial = _join_slice(F.col("_w"), F.lit(1), cutoff, " ")
    completion = _join_slice(F.col("_w"), cutoff + 1, F.greatest(F.col("n_words").cast("int") - cutoff, F.lit(0)), " ")
    return d.select(*df.columns, "n_words", F.col("pos").cast("bigint").alias("pos"),
                    F.when(~is_base, cutoff.cast("bigint")).alias("cutoff"),
                    F.when(~is_base, partial).alias("partial_answer"),
                    F.when(~is_base, completion).alias("completion"),
                    F.when(~is_base, cutoff / F.col("n_words")).alias("portion"))


def expansion_offsets(parents: DataFrame, parent_key: str, rows_per_parent: Column, partition_by=(),
                      out: str = "_base", extra: dict | None = None) -> DataFrame:
    """Before expanding: each parent's first index among base + partial rows
    (prefix sum of rows per parent in key order), so that after the explode
    ``index = base + pos`` with no join back. ``extra`` adds more running
    sums in the same pass (e.g. the parent's own position)."""
    parts = [partition_by] if isinstance(partition_by, str) else list(partition_by)
    return prefix_offsets(key_bucket(parents, parent_key), [parent_key], F.col("_kb"), parts,
                          weight=rows_per_parent, out=out, extra=extra).drop("_kb")


def reindex_expanded(df: DataFrame, parent_key: str, rows_per_parent: Column, partition_by=(),
                     out: str = "index", parents: DataFrame | None = None) -> DataFrame:
    """Running index over an already expanded table (when the parents were
    not offset before the explode): offsets over one row per parent, joined
    back by parent key. Prefer :func:`expansion_offsets` before expanding."""
    parts = [partition_by] if isinstance(partition_by, str) else list(partition_by)
    src = parents if parents is not None else df.dropDuplicates([parent_key])
    off = expansion_offsets(src.select(parent_key, *parts, rows_per_parent.alias("_rows")), parent_key,
                            F.col("_rows"), parts)
    return df.join(off.select(parent_key, "_base"), parent_key) \
             .withColumn(out, F.col("_base") + F.col("pos")).drop("_base")
