"""Positional operators without a one-partition sort.

A contiguous 0-based rank in an explicit order is built in two passes:

1. every row gets a *bucket* that is monotone in the order (a range of
   a dense integer key, or the high bits of a 32-bit hash),
2. bucket sizes are counted (a table of at most ``n_buckets`` rows per
   partition group, broadcast back), turned into exclusive offsets, and
   added to a ``row_number`` computed inside each bucket.

Work per task is bounded by the bucket width, not by the table, so the
rank survives a hot partition group and needs no driver loop. Keys of any
spread are ranked by sampled ranges of the key column instead
(:func:`assign_index`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rungkit.functions.hashing import hash_key
from rungkit.operators.materialize import materialize

HASH_BUCKET_SHIFT = 20          # 2**32 >> 20 = 4096 hash buckets
DEFAULT_KEY_BUCKETS = 4096
NULL_BUCKET = -(2 ** 63)         # rows without a key or bucket come first in their group


def _cols(xs) -> list:
    if xs is None:
        return []
    if isinstance(xs, (str, Column)):
        return [xs]
    return list(xs)


def key_bucket(df: DataFrame, key: str, n_buckets: int = DEFAULT_KEY_BUCKETS,
               range_from: DataFrame | None = None) -> DataFrame:
    """Add ``_kb``: range bucket of a dense integer key.

    The key range comes from a one-row aggregate joined back lazily (no
    driver round trip), taken over ``range_from`` when given (any cheaper
    frame whose keys are a superset, e.g. the input before an expensive
    filter). For unique keys a bucket holds at most
    ``ceil(range / n_buckets)`` rows. Rows without a key share a bucket
    before all others.
    """
    src = range_from if range_from is not None else df
    stats = src.agg(F.min(key).alias("_kmin"), F.max(key).alias("_kmax"))
    d = df.crossJoin(F.broadcast(stats))   # one-row side
    width = F.greatest(F.lit(1), F.ceil((F.col("_kmax") - F.col("_kmin") + 1) / F.lit(n_buckets)))
    place = F.floor((F.col(key) - F.col("_kmin")) / width).cast("bigint")
    return d.withColumn("_kb", F.coalesce(place, F.lit(NULL_BUCKET))).drop("_kmin", "_kmax")


def prefix_offsets(df: DataFrame, order: Sequence, bucket: Column, partition_by=(),
                   weight: Column | None = None, out: str = "offset", bounded: bool = True,
                   extra: dict | None = None, total_out: str | None = None) -> DataFrame:
    """Add ``out`` = exclusive prefix sum of ``weight`` (default 1) in
    ``order`` within each ``partition_by`` group.

    ``extra`` adds more running sums in the same pass ({name: weight});
    ``total_out`` adds the group total of ``weight``.

    ``bucket`` must be non-decreasing along ``order`` inside a group. The
    input is exchanged once by (group, bucket); the bucket-size aggregate
    and the in-bucket window both read that one exchange.

    The offsets table has one row per (group, bucket). Without groups,
    key-range and hash buckets make at most 4,096 rows, which are broadcast;
    with groups, or with data-derived buckets (``bounded=False``), its size
    is known only at run time and adaptive execution chooses the join.

    Rows with a NULL group form a group of their own. No row is lost, as
    long as ``bucket`` is not NULL.
    """
    parts = _cols(partition_by)
    order = _cols(order)
    sums = {out: (weight if weight is not None else F.lit(1))}
    sums.update(extra or {})
    names = list(sums)
    d = df.withColumn("_bk", bucket).withColumns({f"_w{i}": sums[n].cast("bigint") for i, n in enumerate(names)})
    d = d.repartition(*parts, "_bk")
    sizes = d.groupBy(*parts, "_bk").agg(*[F.sum(f"_w{i}").alias(f"_s{i}") for i in range(len(names))])
    wb = Window.partitionBy(*parts).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    cols = {f"_o{i}": F.coalesce(F.sum(f"_s{i}").over(wb), F.lit(0)) for i in range(len(names))}
    if total_out:
        cols["_tot"] = F.sum("_s0").over(Window.partitionBy(*parts))
    offsets = sizes.withColumns(cols).drop(*[f"_s{i}" for i in range(len(names))])
    inner = Window.partitionBy(*parts, "_bk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumns({f"_i{i}": F.coalesce(F.sum(f"_w{i}").over(inner), F.lit(0)) for i in range(len(names))})
    if parts:
        offsets = offsets.withColumnsRenamed({c: f"_g{i}" for i, c in enumerate([*parts, "_bk"])})
        same = F.lit(True)
        for i, c in enumerate([*parts, "_bk"]):
            same = same & (d[c] == offsets[f"_g{i}"] if c == "_bk" else d[c].eqNullSafe(offsets[f"_g{i}"]))
        joined = d.join(offsets, same).drop(*[f"_g{i}" for i in range(len(parts) + 1)])
    else:
        joined = d.join(F.broadcast(offsets) if bounded else offsets, on="_bk")
    outs = {n: (F.col(f"_o{i}") + F.col(f"_i{i}")).cast("bigint") for i, n in enumerate(names)}
    if total_out:
        outs[total_out] = F.col("_tot").cast("bigint")
    drop = ["_bk", "_tot"] + [f"_{k}{i}" for k in "wosi" for i in range(len(names))]
    return joined.withColumns(outs).drop(*drop)


def key_offsets(df: DataFrame, key: str, partition_by=(), out: str = "index") -> DataFrame:
    """One row per distinct (group, key): ``_k0``.. (group columns), ``_key``
    and ``out``, the rows of the group with a smaller key.

    Only the key column moves: keys are counted, dealt into ranges by
    splitters that Spark samples (even whatever the keys' spread: one outlier
    does not empty the other ranges), and their counts summed up to each.
    """
    parts = _cols(partition_by)
    names = [f"_k{i}" for i in range(len(parts))]
    counts = df.select(*[F.col(c).alias(n) for c, n in zip(parts, names)], F.col(key).alias("_key")) \
               .groupBy(*names, "_key").agg(F.count(F.lit(1)).alias("_n"))
    ranges = materialize(materialize(counts, "key_counts").repartitionByRange(*names, "_key")
                         .withColumn("_range", F.spark_partition_id()), "key_ranges")
    return prefix_offsets(ranges, ["_key"], F.col("_range"), names, weight=F.col("_n"), out=out,
                          bounded=False).select(*names, "_key", out)


def assign_index(df: DataFrame, key: str, partition_by=(), out: str = "index") -> DataFrame:
    """Contiguous 0-based index in ``key`` order, restarted per ``partition_by``.

    Places are worked out on the key column (:func:`key_offsets`) and joined
    to the rows, which are exchanged once; rows with one key stand in any
    order, rows without a key or group are a key or group of their own, first.
    """
    parts = _cols(partition_by)
    at = key_offsets(df, key, parts, out="_before")
    same = df[key].eqNullSafe(at["_key"])
    for i, c in enumerate(parts):
        same = same & df[c].eqNullSafe(at[f"_k{i}"])
    within = F.row_number().over(Window.partitionBy(*parts, key).orderBy(F.lit(0))) - 1
    d = df.join(at, same).drop("_key", *[f"_k{i}" for i in range(len(parts))])
    return d.withColumn(out, (F.col("_before") + within).cast("bigint")).drop("_before")


def hash_order(seed, key: str) -> Column:
    return hash_key(F.lit(seed), F.col(key))


def hash_rank(df: DataFrame, key: str, seed, partition_by=(), out: str = "rank",
              total_out: str | None = None) -> DataFrame:
    """Rank in a seeded pseudo-random order (hash of seed:key, ties by key)."""
    d = df.withColumn("_h", hash_order(seed, key))
    r = prefix_offsets(d, ["_h", key], F.shiftright(F.col("_h"), HASH_BUCKET_SHIFT), partition_by, out=out,
                       total_out=total_out)
    return r.drop("_h")


def group_sizes(df: DataFrame, partition_by=(), out: str = "n") -> DataFrame:
    parts = _cols(partition_by)
    return df.groupBy(*parts).agg(F.count(F.lit(1)).cast("bigint").alias(out))


def take_first_n(df: DataFrame, key: str, n: int, strict: bool = True) -> DataFrame:
    """First ``n`` rows in ``key`` order (a distributed top-k, never a bare limit).

    ``strict``: fewer than ``n`` rows fail the job when it runs (an empty
    input gives an empty result).
    """
    top = df.orderBy(F.col(key).asc()).limit(n)
    if not strict:
        return top
    short = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))      # over n rows
    wrong = F.raise_error(F.concat(F.lit(f"asked for {n} rows, found "), F.col("_have").cast("string")))
    return top.withColumn("_have", short).filter(F.when(F.col("_have") < n, wrong.cast("string")).isNull()).drop("_have")


def split_train_test(df: DataFrame, key: str, test_share: float, seed=42,
                     partition_by=()) -> DataFrame:
    """Exact-size shuffled split: test = first ceil(n * p) rows in hash order."""
    r = hash_rank(df, key, seed, partition_by, out="_r", total_out="_n")
    n_test = F.ceil(F.col("_n") * F.lit(float(test_share)))
    return r.withColumn("split", F.when(F.col("_r") < n_test, "test").otherwise("train")) \
            .drop("_r", "_n")


def shuffle_batches(df: DataFrame, key: str, batch_size: int, seed=1, shuffle: bool = True,
                    partition_by=()) -> DataFrame:
    """batch_id / position by seeded hash order (or key order); incomplete last batch dropped."""
    if shuffle:
        r = hash_rank(df, key, seed, partition_by, out="_r", total_out="_n")
    else:
        r = prefix_offsets(key_bucket(df, key), [key], F.col("_kb"), partition_by, out="_r",
                           total_out="_n").drop("_kb")
    B = F.lit(int(batch_size))
    r = r.withColumn("batch_id", F.floor(F.col("_r") / B).cast("bigint")) \
         .withColumn("batch_pos", (F.col("_r") % B).cast("bigint"))
    return r.filter(F.col("batch_id") < F.floor(F.col("_n") / B)).drop("_r", "_n")


def val_single_batch(df: DataFrame, key: str) -> DataFrame:
    """Validation = one unshuffled batch holding every row."""
    r = assign_index(df, key, out="batch_pos")
    return r.withColumn("batch_id", F.lit(0).cast("bigint"))


def rank_shards(df: DataFrame, key: str, world: int, global_batch: int, micro: int,
                epoch: int = 0, seed: int = 0) -> DataFrame:
    """Data-parallel sharding with per-epoch reshuffle and drop_last.

    rank = r % world, slot = r div world, kept while slot < n div world;
    per-rank batches of global_batch/world, micro-batches of ``micro``.
    """
    if global_batch % world:
        raise ValueError("global batch must be divisible by world size")
    per_rank = global_batch // world
    if per_rank % micro:
        raise ValueError("per-rank batch must be divisible by micro batch")
    r = hash_rank(df, key, f"{seed}-{epoch}", out="_r", total_out="_n")
    W = F.lit(int(world))
    r = r.withColumn("dp_rank", (F.col("_r") % W).cast("bigint")) \
         .withColumn("slot", F.floor(F.col("_r") / W).cast("bigint")) \
         .filter(F.col("slot") < F.floor(F.col("_n") / W))
    r = r.withColumn("_nslot", F.floor(F.col("_n") / W))
    r = r.withColumn("batch_id", F.floor(F.col("slot") / F.lit(per_rank)).cast("bigint")) \
         .withColumn("micro_id", F.floor((F.col("slot") % F.lit(per_rank)) / F.lit(micro)).cast("bigint"))
    # drop incomplete per-rank batches (DataLoader drop_last)
    r = r.filter(F.col("batch_id") < F.floor(F.col("_nslot") / F.lit(per_rank)))
    return r.drop("_r", "_n", "_nslot")
