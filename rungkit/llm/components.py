"""Connected components of an edge table by alternating large-star and
small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rungkit.llm.common import saved


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges``: columns u, v (bigint; order, repeats and loops are free).
    Returns ``node``, ``component`` (the smallest node reachable) for every
    node that has an edge to another one.

    Every step is a partial aggregate (smallest neighbour of each node) joined
    back to the edges, so a hub of any degree is split by the skew join; each
    round is written under the checkpoint folder.  Only a row count and a
    checksum of each round reach the driver.
    """
    e = saved(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
              .where("u > v").distinct(), "cc")
    before = None
    while (now := _state(e)) != before:
        before = now
        e = saved(_small_star(_large_star(e)), "cc")
    return (e.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .union(e.select("v", "v").distinct()))


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    return (e.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least).distinct())


def local_components(n: int, a: np.ndarray, b: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """Smallest index reachable for each of 0..n-1 over the links a[i]-b[i];
    ``labels`` carries the result of earlier links on."""
    lab = np.arange(n) if labels is None else labels
    while True:
        la, lb = lab[a], lab[b]
        differ = la != lb
        if not differ.any():
            return lab
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        np.minimum.at(lab, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = lab[lab]
            if (up == lab).all():
                break
            lab = up
