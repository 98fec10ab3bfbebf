"""Nested projection and chat rendering (ops 21, 22)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _unwrap(c: Column, dtype) -> tuple[Column, object]:
    """Unwrap length-1 sequences; null and empty ones give NULL, a longer one
    has no single value and fails the job."""
    while isinstance(dtype, T.ArrayType):
        many = F.raise_error(F.lit("cannot take one value of a sequence of several")).cast(dtype.elementType)
        c = F.when(F.size(c) == 1, F.try_element_at(c, F.lit(1))).when(F.size(c) > 1, many)
        dtype = dtype.elementType
    return c, dtype


def nested_column(df: DataFrame, top: str, keys=()) -> Column:
    """``df[top]`` drilled through ``keys``, unwrapping length-1 sequences first."""
    c, dtype = F.col(top), df.schema[top].dataType
    for k in keys:
        c, dtype = _unwrap(c, dtype)
        if not isinstance(dtype, T.StructType):
            raise TypeError(f"cannot take key {k!r} of {dtype.simpleString()}")
        c, dtype = c.getField(k), dtype[k].dataType
    c, dtype = _unwrap(c, dtype)
    return c


def nested_project(df: DataFrame, spec: dict[str, tuple[str, list]], keep=()) -> DataFrame:
    """``spec`` = {out_name: (top_column, [nested keys])}."""
    return df.select(*keep, *[nested_column(df, top, keys).alias(name) for name, (top, keys) in spec.items()])


def render_chat(prompt: Column, add_generation_prompt: bool = True, partial: Column | None = None) -> Column:
    """Fallback chat template: one ``role: content`` line per message; then an
    open ``assistant: `` turn, carrying the partial answer when there is one."""
    body = F.array_join(F.transform(prompt, lambda m: F.concat(m["role"], F.lit(": "), m["content"], F.lit("\n"))), "")
    if partial is not None:
        return F.when(partial.isNotNull(), F.concat(body, F.lit("assistant: "), partial)) \
                .otherwise(F.concat(body, F.lit("assistant: " if add_generation_prompt else "")))
    return F.concat(body, F.lit("assistant: " if add_generation_prompt else ""))
