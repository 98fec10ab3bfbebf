"""Cut a reasoning text at a portion (op 32) and the history bypass (op 23d)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rungkit.functions import text as tx


def cut_columns(text: Column, portion: Column, mode: str | None = None) -> tuple[Column, Column]:
    """(partial, completion) for ``mode``: 'char' (characters), a separator
    string, or None (``\\S+\\s*`` chunks). Cut index = int(len(pieces) * p)."""
    if mode == "char":
        cut = F.floor(F.length(text) * portion).cast("int")
        return F.substr(text, F.lit(1), cut), F.substr(text, cut + 1)
    if mode is None:
        pieces, sep = tx.chunks(text), ""
    else:
        pieces, sep = F.split(text, tx.regex_escape(mode), -1), mode
    n = F.size(pieces)
    cut = F.floor(n * portion).cast("int")
    return (F.array_join(F.slice(pieces, 1, cut), sep),
            F.array_join(F.slice(pieces, cut + 1, F.greatest(n - cut, F.lit(0))), sep))


def cut_by_portion(df: DataFrame, answer: str, portion: Column, mode: str | None = None) -> DataFrame:
    """Record ``portion``; when it is > 0 and the cut is non-empty set
    ``partial_answer`` and ``completion`` (else both stay NULL)."""
    d = df.withColumn("portion", portion.cast("double"))
    part, comp = cut_columns(F.col(answer), F.col("portion"), mode)
    d = d.withColumn("_part", F.when(F.col("portion") > 0, part)).withColumn("_comp", comp)
    keep = F.col("_part").isNotNull() & (F.col("_part") != "")
    return d.withColumn("partial_answer", F.when(keep, F.col("_part"))) \
            .withColumn("completion", F.when(keep, F.col("_comp"))).drop("_part", "_comp")


def cut_modes(df: DataFrame, answer: str, portion: Column, modes: dict[str, str | None]) -> DataFrame:
    """Rows cut in several ways in one scan: one row per input row and entry
    of ``modes`` (label: mode of :func:`cut_columns`), with ``mode``,
    ``portion``, ``partial_answer`` and ``completion`` as in
    :func:`cut_by_portion`."""
    d = df.withColumn("portion", portion.cast("double"))
    cuts = []
    for label, mode in modes.items():
        part, comp = cut_columns(F.col(answer), F.col("portion"), mode)
        cuts.append(F.struct(F.lit(label).alias("mode"), F.when(F.col("portion") > 0, part).alias("part"), comp.alias("comp")))
    d = d.withColumn("_cut", F.explode(F.array(*cuts)))
    keep = F.col("_cut.part").isNotNull() & (F.col("_cut.part") != "")
    return d.withColumns({"mode": F.col("_cut.mode"), "partial_answer": F.when(keep, F.col("_cut.part")),
                          "completion": F.when(keep, F.col("_cut.comp"))}).drop("_cut")


def apply_curriculum(df: DataFrame, answer: str, portion: Column, mode: str | None = None,
                     partial: str = "partial_answer") -> DataFrame:
    """Rows that already carry a partial answer bypass the curriculum (``''``
    is not NULL, so an empty prefix also bypasses); others are cut."""
    has = F.col(partial).isNotNull()
    pc, cc = cut_columns(F.col(answer), portion.cast("double"), mode)
    p = portion.cast("double")
    new_part = F.when((p > 0) & (pc != ""), pc)
    new_comp = F.when((p > 0) & (pc != ""), cc)
    return df.withColumn("bypass", has) \
             .withColumn("portion", F.when(has, F.col("portion")).otherwise(p)) \
             .withColumn("completion", F.when(has, F.col("completion")).otherwise(new_comp)) \
             .withColumn(partial, F.when(has, F.col(partial)).otherwise(new_part))
