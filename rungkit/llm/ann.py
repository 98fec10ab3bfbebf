"""Approximate nearest neighbours: NN-descent and greedy graph search.

The graph holds for every vector its ``DEGREE`` nearest found so far.  It
starts from neighbours inside buckets of random projections, and each round
joins neighbours of neighbours: both directions of every edge are gathered at
their common end, and the vectors that meet there are compared with each
other (a bounded list, so a round is linear in the number of vectors).  Edges
that were there a round ago are old: only lists with a new edge are gathered,
and two ends of old edges are not compared again.  Each vector tells the others
how near its worst neighbour is, so only improvements leave the task.

A query starts at its entry points and repeatedly expands what it has not
expanded yet among the ``BEAM`` nearest found, along edges in both directions,
until nothing is left to expand.  A warning says so when ROUNDS or
SEARCH_ROUNDS ended a run that had not settled.  Every round is a join of the queries'
frontier with the graph and with the vectors.

Graph and search compare unit vectors in double precision, so that nearness
inside a crowd of near copies is not lost to rounding; the beam's vectors are
then compared on the original components.

Equal vectors are one node that keeps its smallest ids, so a vector with any
number of copies neither crowds a bucket nor hides its ties.

Edge cases: vectors that are null, empty, zero or hold null or non-finite
components, and rows with a null id, take no part; vectors are compared with
those of their own length only; with fewer candidates than asked for, all are
returned; an empty table gives an empty table.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from rungkit.llm.common import saved
from rungkit.llm.embed_dedup import unit_matrix, vector_rows

DEGREE = 24            # neighbours kept of each vector
REVERSE = 24           # incoming edges followed of each vector
TABLES = 4             # bucketings of the first graph
BUCKET_ROWS = 96       # vectors of a bucket, about; larger ones are split
ROUNDS = 6             # rounds of NN-descent at most
SETTLED = 0.02         # rounds end when a smaller share of the edges changes
PER_MEETING = 6        # neighbours one meeting reports of each vector
BEAM = 160
SEARCH_ROUNDS = 12
SEED = 2


def _batches(batches: Iterator[pa.RecordBatch], names: list[str]):
    """Rows of list columns as numpy slices; lists of binary values of equal
    length become one matrix per batch."""
    for batch in batches:
        cols = {}
        for name in names:
            c = batch.column(batch.schema.get_field_index(name))
            if pa.types.is_list(c.type):
                off = c.offsets.to_numpy() - c.offsets[0].as_py()
                flat = c.flatten()
                cols[name] = (off, _bytes_matrix(flat) if pa.types.is_binary(flat.type) else flat.to_numpy(zero_copy_only=False))
            elif pa.types.is_binary(c.type):
                cols[name] = _bytes_matrix(c)
            else:
                cols[name] = c.to_numpy(zero_copy_only=False)
        yield batch.num_rows, cols


def _bytes_matrix(c: pa.Array) -> np.ndarray:
    if not len(c):
        return np.empty((0, 1))
    return np.frombuffer(b"".join(c.to_pylist())).reshape(len(c), -1)


def build_graph(nodes: DataFrame, dim: int) -> DataFrame:
    """``nodes``: node, vec (unit vector, doubles).  Returns edges ``u``, ``v``, ``sim``, ``new``
    (found in the last round)."""
    rng = np.random.default_rng(SEED)
    total = nodes.count()
    bits = max(0, int(np.ceil(np.log2(max(total, 1) / BUCKET_ROWS))))
    planes = rng.standard_normal((TABLES, bits, dim))
    shared = nodes.sparkSession.sparkContext.broadcast(planes)

    def bucket(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.frombuffer(b"".join(pdf["vec"])).reshape(len(pdf), -1)
            for t, p in enumerate(shared.value):
                code = ((x @ p.T > 0) @ (1 << np.arange(bits))).astype(np.int64) if bits else np.zeros(len(x), np.int64)
                yield pd.DataFrame({"t": np.int32(t), "code": code, "node": pdf["node"], "vec": pdf["vec"]})

    dealt = saved(nodes.mapInPandas(bucket, "t int, code bigint, node bigint, vec binary"), "ann-bucket")
    sizes = dealt.groupBy("t", "code").count()
    # a crowded bucket is dealt over several, at random
    part = F.pmod(F.xxhash64("node", "t"), F.greatest(F.lit(1), F.ceil(F.col("count") / (2 * BUCKET_ROWS))))
    groups = (dealt.join(sizes, ["t", "code"]).withColumn("part", part)
              .groupBy("t", "code", "part")
              .agg(F.collect_list(F.struct("node", F.lit(-1.0).alias("worst"), "vec")).alias("met")))
    groups = groups.withColumn("met", F.transform("met", lambda x: x.withField("new", F.lit(True))))
    edges = saved(_nearest(_meet(groups, DEGREE // 2), None), "ann-graph")
    for _ in range(ROUNDS):
        met = _meet(_meetings(edges, nodes), PER_MEETING)
        edges = saved(_nearest(met, edges), "ann-graph")
        changed = edges.where("new").count()
        if changed <= SETTLED * total * DEGREE:
            break
    else:
        warnings.warn(f"the graph still changed in {changed} of {total * DEGREE} edges after {ROUNDS} rounds", stacklevel=2)
    return edges


def _both_ways(edges: DataFrame) -> DataFrame:
    """Outgoing edges and at most REVERSE incoming ones of every node (those
    that come first by a hash)."""
    rank = F.row_number().over(Window.partitionBy("v").orderBy(F.xxhash64("u", "v")))
    back = (edges.withColumn("r", rank).where(F.col("r") <= REVERSE)
            .select(F.col("v").alias("u"), F.col("u").alias("v"), "new"))
    return edges.select("u", "v", "new").union(back).groupBy("u", "v").agg(F.max("new").alias("new"))


def _meetings(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """For every node the list of its neighbours, each with its vector and the
    nearness of its worst neighbour."""
    worst = edges.groupBy("u").agg(F.min("sim").alias("worst"), F.count("*").alias("n"))
    worst = worst.select(F.col("u").alias("node"), F.when(F.col("n") < DEGREE, F.lit(-1.0)).otherwise(F.col("worst"))
                         .alias("worst"))
    known = nodes.join(worst, "node", "left").select(
        F.col("node").alias("v"), F.coalesce("worst", F.lit(-1.0)).alias("worst"), "vec")
    ends = saved(_both_ways(edges), "ann-ends")
    live = ends.groupBy("u").agg(F.max("new").alias("any")).where("any").select("u")
    return (ends.join(live, "u", "left_semi").join(known, "v").groupBy("u")
            .agg(F.collect_list(F.struct(F.col("v").alias("node"), "worst", "vec", "new")).alias("met")))


def _meet(groups: DataFrame, per_meeting: int) -> DataFrame:
    """Compare the members of each list: improvements ``u``, ``v``, ``sim``."""
    flat = groups.select(F.col("met.node").alias("node"), F.col("met.worst").alias("worst"), F.col("met.vec").alias("vec"), F.col("met.new").alias("new"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, c in _batches(batches, ["node", "worst", "vec", "new"]):
            off, node = c["node"]
            worst, x, new = c["worst"][1], c["vec"][1], c["new"][1].astype(bool)
            out = []
            for i in range(n):
                a, b = off[i], off[i + 1]
                if b - a < 2:
                    continue
                sim = x[a:b] @ x[a:b].T
                np.fill_diagonal(sim, -2.0)
                old = np.flatnonzero(~new[a:b])
                sim[np.ix_(old, old)] = -2.0
                k = min(per_meeting, b - a - 1)
                near = np.argpartition(sim, -k, axis=1)[:, -k:]
                row = np.repeat(np.arange(b - a), k)
                col = near.ravel()
                s = sim[row, col]
                good = (s > worst[a:b][row]) & (s > -1.5)
                out.append((node[a:b][row[good]], node[a:b][col[good]], s[good]))
            if out:
                u, v, s = (np.concatenate(z) for z in zip(*out))
                for lo in range(0, len(u), 200_000):
                    e = slice(lo, lo + 200_000)
                    yield pa.RecordBatch.from_arrays([pa.array(u[e]), pa.array(v[e]), pa.array(s[e])],
                                                     names=["u", "v", "sim"])

    return flat.mapInArrow(compare, "u bigint, v bigint, sim double")


def _nearest(found: DataFrame, edges: DataFrame | None) -> DataFrame:
    """The DEGREE nearest of every node; ``new``: not in ``edges``."""
    both = found.withColumn("new", F.lit(True))
    if edges is not None:
        both = both.union(edges.select("u", "v", "sim", F.lit(False)))
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v"))
    return (both.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.min("new").alias("new")).withColumn("r", rank)
            .where(F.col("r") <= DEGREE).select("u", "v", "sim", "new"))


def search(queries: DataFrame, entries: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``queries``: query, q_vec (unit vector, doubles); ``entries``: query, node to start from;
    returns ``query``, ``node``: the beams after greedy search."""
    around = saved(_both_ways(edges).groupBy("u").agg(F.collect_list("v").alias("next")), "ann-around")
    beam_type = "query bigint, q_vec binary, node array<bigint>, sim array<double>, done array<boolean>"
    none = [F.array().cast(t) for t in ("array<bigint>", "array<double>", "array<boolean>")]
    state = queries.select("query", "q_vec", none[0].alias("node"), none[1].alias("sim"), none[2].alias("done"))
    wanted = entries.select("query", "node")
    for _ in range(SEARCH_ROUNDS):
        seen = (wanted.distinct().join(nodes, "node").groupBy("query")
                .agg(F.collect_list(F.struct("node", "vec")).alias("met"))
                .select("query", F.col("met.node").alias("new"), F.col("met.vec").alias("new_vec")))
        state = saved(state.join(seen, "query", "left").mapInArrow(_merge_beams, beam_type), "ann-beam")
        open_ends = (state.select("query", F.explode(F.arrays_zip("node", "done")).alias("x"))
                     .where(~F.col("x.done")).select("query", F.col("x.node").alias("u")))
        # what the beam holds now is expanded by the join below
        if not open_ends.limit(1).count():
            break
        wanted = (open_ends.join(around, "u").select("query", F.explode("next").alias("node")))
        state = state.withColumn("done", F.transform("done", lambda x: F.lit(True)))
    else:
        warnings.warn(f"some beams still grew after {SEARCH_ROUNDS} rounds", stacklevel=2)
    return state.select("query", F.explode("node").alias("node"))


def _merge_beams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        d = {k: batch.column(batch.schema.get_field_index(k)) for k in batch.schema.names}
        rows = []
        for i in range(batch.num_rows):
            q_vec = d["q_vec"][i].as_py()
            node = np.array(d["node"][i].values.to_numpy(zero_copy_only=False), dtype=np.int64)
            sim = np.array(d["sim"][i].values.to_numpy(zero_copy_only=False), dtype=np.float64)
            done = np.array(d["done"][i].values.to_numpy(zero_copy_only=False), dtype=bool)
            if d["new"][i].is_valid:
                new = d["new"][i].values.to_numpy(zero_copy_only=False)
                raw = _bytes_matrix(d["new_vec"][i].values)
                fresh = ~np.isin(new, node)
                q = np.frombuffer(q_vec)
                node = np.concatenate([node, new[fresh]])
                sim = np.concatenate([sim, raw[fresh] @ q])
                done = np.concatenate([done, np.zeros(int(fresh.sum()), dtype=bool)])
                best = np.argsort(-sim, kind="stable")[:BEAM]
                node, sim, done = node[best], sim[best], done[best]
            rows.append((d["query"][i].as_py(), q_vec, node, sim, done))
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()),
                 pa.array([r[2] for r in rows], pa.list_(pa.int64())),
                 pa.array([r[3] for r in rows], pa.list_(pa.float64())),
                 pa.array([r[4] for r in rows], pa.list_(pa.bool_()))],
                names=["query", "q_vec", "node", "sim", "done"])


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    """Scaled by the largest components first, so that no square overflows or vanishes."""
    a, b = a / np.abs(a).max(), b / np.abs(b).max()
    return float(np.dot(a, b) / (np.sqrt(np.dot(a, a)) * np.sqrt(np.dot(b, b))))


def nearest_neighbours(df: DataFrame, id_col: str, vec_col: str, is_query: Column, k: int = 5) -> DataFrame:
    """The ``k`` nearest found of every row with ``is_query`` (a condition on
    the id, written on column ``c0``) among all other rows: ``query_id``,
    ``rank`` (from 1), ``id``, ``score`` (cosine on the original vectors)."""
    rows = saved(vector_rows(df, id_col, vec_col).where("c0 is not null and key is not null"), "ann-rows")
    # the k + 1 smallest ids are enough for any query, itself included; each
    # task passes on so many of a vector at most
    small = F.slice(F.array_sort(F.collect_list("c0")), 1, k + 1)
    order = F.row_number().over(Window.partitionBy("key", "salt").orderBy("c0"))
    salted = (rows.withColumn("salt", F.pmod(F.xxhash64("c0"), F.lit(64))).withColumn("r", order)
              .where(F.col("r") <= k + 1))
    classes = saved(salted.groupBy("key").agg(F.first("vec").alias("vec"), small.alias("ids"))
                    .withColumn("node", F.monotonically_increasing_id()), "ann-class")
    dims = sorted(r["d"] for r in classes.select((F.octet_length("vec") / 8).cast("int").alias("d")).distinct().collect())
    asked = rows.where(is_query).select(F.col("c0").alias("query"), "key").distinct()
    parts = [_search_dim(classes.where(F.octet_length("vec") == 8 * d), asked, d, k) for d in dims]
    if not parts:
        return rows.select(F.col("c0").alias("query_id"), F.lit(1).alias("rank"), F.col("c0").alias("id"),
                           F.lit(0.0).alias("score")).limit(0)
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _search_dim(classes: DataFrame, asked: DataFrame, dim: int, k: int) -> DataFrame:
    @F.pandas_udf("binary")
    def pack(s: pd.Series) -> pd.Series:
        return pd.Series([x.tobytes() for x in unit_matrix(s.tolist())] if len(s) else [], dtype=object)

    nodes = saved(classes.select("node", pack("vec").alias("vec")), "ann-nodes")
    edges = build_graph(nodes, dim)
    own = asked.join(classes.select("key", F.col("node").alias("own"), F.col("vec").alias("q")), "key").drop("key")
    own = saved(own, "ann-query")
    queries = own.join(nodes, F.col("own") == F.col("node")).select("query", F.col("vec").alias("q_vec"))
    # a row of the table starts at its own place in the graph
    entries = own.select("query", F.col("own").alias("node"))
    beams = search(queries, entries, edges, nodes)

    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([cosine(np.frombuffer(x), np.frombuffer(y)) for x, y in zip(a, b)], dtype="float64")

    scored = (beams.join(own.select("query", "q"), "query").join(classes.select("node", "vec", "ids"), "node")
              .select("query", score("q", "vec").alias("score"), F.explode("ids").alias("id"))
              .where(F.col("id") != F.col("query")))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return (scored.withColumn("rank", rank).where(F.col("rank") <= k)
            .select(F.col("query").alias("query_id"), "rank", "id", "score"))
