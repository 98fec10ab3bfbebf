"""Embedding near-duplicates: an exact metric range join.

Unit vectors are partitioned by their nearest pivot.  Angles obey the
triangle inequality, so a vector v of home cell i can have a partner within
angle r in cell j only if  angle(v, p_j) <= angle(v, p_i) + 2 r  and
angle(v, p_j) <= radius_j + r; in the plane of the two pivots the distance to
their bisector bounds it further.  v visits exactly the cells those tests
leave, each cell then joins its own rows with its members independently, and
every vector counts all its links in its home cell.

Equal vectors are joined into one class first.  Cells are cut into blocks,
which are written once; a Cartesian product hands every task the pairs of
blocks of two scan partitions, and of them those whose cells visit each other.
No vector is copied to the cells it visits: what is written grows with the
vectors, whatever the cells, and only the arithmetic with the pairs they leave
(vectors without any structure leave all of them).  A pair of blocks is met
once and serves both sides.  Tasks report link counts and a spanning forest of
their links, never their pairs.

Within a pair, rows are turned to principal axes (of a sample) and compared in
single precision by their first axes and the length of what is left:
a.b <= a'.b' + |a''| |b''|, so no pair of at least the cosine asked for is
missed.  What passes is decided by the cosine in double precision.

Pivots and axes are bounded samples (``MAX_PIVOTS``, ``AXIS_ROWS``): they only
decide the cells and the cost, the join is exact for any choice.

Edge cases: vectors that are null, empty, zero or hold null or non-finite
components link with nothing; vectors of different length do not link;
repeated rows are vectors of their own; rows with a null id are kept, count
links, and have the component of their class; an empty table gives an empty
table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rungkit.llm.common import discard, keyed, saved
from rungkit.llm.components import connected_components, local_components

MAX_PIVOTS = 512
AXIS_ROWS = 1024        # rows that decide the axes
CELL_ROWS = 8192        # rows a cell should have; decides the number of pivots
OWN_BLOCK, MEMBER_BLOCK = 8192, 1024    # rows of a block; rows of the other block compared at a time
TILE_ROWS = 256         # rows of the one block compared at a time
BLOCK_BYTES = 4 << 20   # of a block's vectors
HELD_BYTES = 64 << 20   # of blocks that a task keeps ready
HELD_EDGES = 1 << 18    # links that a task holds before it merges them
CHECK_COST = 100_000    # what it costs to decide a pair, in products of one axis
_SLACK = 1e-9           # rounding in the angles only ever adds visits


def as_vector(x) -> np.ndarray | None:
    """Double components, or None where the vector takes no part."""
    if x is None or not len(x):
        return None
    v = np.asarray(x, dtype=np.float64)
    return v if np.isfinite(v).all() and v.any() else None


def vector_rows(df: DataFrame, id_col: str, vec_col: str, kind: str = "<f8") -> DataFrame:
    """``c0`` (id), ``key`` (digest of the vector), ``vec`` (packed numbers of
    this kind, by default doubles); key and vec are null where the vector takes
    no part."""
    def prepare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            vecs = [as_vector(x) for x in pdf["c1"]]
            raw = [None if v is None else (v + 0.0).astype(kind).tobytes() for v in vecs]
            key = [None if r is None else hashlib.blake2b(r, digest_size=16).digest() for r in raw]
            yield pd.DataFrame({"c0": pdf["c0"], "key": pd.Series(key, dtype=object, index=pdf.index),
                                "vec": pd.Series(raw, dtype=object, index=pdf.index)})

    rows = keyed(df, id_col, vec_col).select(F.col("c0").cast("bigint"), F.col("c1").cast("array<double>"))
    return rows.mapInPandas(prepare, "c0 bigint, key binary, vec binary")


def unit_matrix(vecs, kind: str = "<f8") -> np.ndarray:
    """Unit vectors, in double precision, of packed ones."""
    return _normed(np.frombuffer(b"".join(vecs), dtype=kind).reshape(len(vecs), -1))


def _normed(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True).astype(np.float64)     # no overflow in the squares
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def near_duplicates(df: DataFrame, id_col: str, vec_col: str, min_cosine: float = 0.9) -> DataFrame:
    """One row per input row: ``id_col``, ``n_links`` (other vectors with a
    cosine of at least ``min_cosine``), ``component_id`` (smallest id
    reachable over links)."""
    if not 0 < min_cosine <= 1:
        raise ValueError("min_cosine must lie in (0, 1]")
    spark = df.sparkSession
    kind = "<f4" if df.select(vec_col).dtypes[0][1] == "array<float>" else "<f8"     # no more than the column has
    rows = saved(vector_rows(df, id_col, vec_col, kind), "vec")
    classes = saved(rows.where("key is not null").groupBy("key")
                    .agg(F.first("vec").alias("vec"), F.count("*").alias("n"), F.min("c0").alias("least"))
                    .withColumn("node", F.monotonically_increasing_id()), "vec-class")
    whole, rows = rows, saved(rows.select("c0", "key"), "vec-keys")
    discard(whole)
    width = np.dtype(kind).itemsize
    dims = [r["d"] for r in classes.select((F.octet_length("vec") / width).cast("int").alias("d")).distinct().collect()]
    parts = [_links_of(spark, classes.where(F.octet_length("vec") == width * d), d, kind, min_cosine) for d in sorted(dims)]
    if not parts:
        return rows.select(F.col("c0").alias(id_col), F.lit(0).cast("bigint").alias("n_links"),
                           F.col("c0").alias("component_id"))
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    counts = found.where("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("others"))
    linked = connected_components(found.where("v is not null").select("u", "v"))
    member = (classes.select("key", "node", "n", "least").join(counts, "node", "left").join(linked, "node", "left")
              .select("key", "n", "least", F.coalesce("others", F.lit(0)).alias("others"),
                      F.coalesce("component", "node").alias("component")))
    least = member.groupBy("component").agg(F.min("least").alias("component_id"))
    result = (member.join(least, "component")
              .select("key", (F.col("n") - 1 + F.col("others")).alias("n_links"), "component_id"))
    return (rows.join(result, "key", "left")
            .select(F.col("c0").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                    F.when(F.col("key").isNull(), F.col("c0")).otherwise(F.col("component_id")).alias("component_id")))


def _axes(units: np.ndarray, min_cosine: float) -> np.ndarray:
    """The principal axes, as columns, that make it cheapest to compare ``units``."""
    dim = units.shape[1]
    turn = np.linalg.eigh(units.T @ units)[1][:, ::-1]
    u, at, dots, best = units @ turn, 0, np.zeros((len(units), len(units))), (np.inf, dim)
    for m in [*dict.fromkeys(int(8 * 1.25 ** k) for k in range(40) if 8 * 1.25 ** k < dim), dim]:
        dots += u[:, at:m] @ u[:, at:m].T
        rest = np.sqrt(np.maximum(1 - (u[:, :m] ** 2).sum(axis=1), 0))
        passing = (dots + np.outer(rest, rest) >= min_cosine).sum() - len(u)     # but not each with itself
        best, at = min(best, (m + CHECK_COST * passing / max(len(u) * (len(u) - 1), 1), m)), m
    return turn[:, :best[1]]


class _Block:
    """A block made ready: unit vectors, what is compared first, and counts."""

    def __init__(self, batch: pa.RecordBatch, i: int, side: str, kind: str, axes: np.ndarray):
        get = lambda c: batch.column(f"{side}_{c}")[i].as_buffer()
        self.nodes, self.weight = (np.frombuffer(get(c), "<i8") for c in ("node", "n"))
        self.cell = batch.column(f"{side}_cell")[i].as_py()
        self.unit = _normed(np.frombuffer(get("vec"), kind).reshape(len(self.nodes), -1))
        first = self.unit @ axes
        rest = np.sqrt(np.maximum(1 - (first * first).sum(axis=1), 0))
        self.first = np.column_stack([first, rest]).astype(np.float32)
        self.bytes = self.unit.nbytes + self.first.nbytes


class _Links:
    """Link counts and a spanning forest over the blocks that a task meets."""

    def __init__(self):
        self.start: dict[int, int] = {}
        self.nodes, self.count, self.label = (np.zeros(0, np.int64) for _ in range(3))
        self.edges, self.held = [], 0

    def place(self, block: int, nodes: np.ndarray) -> int:
        if block not in self.start:
            n = self.start[block] = len(self.nodes)
            self.nodes = np.concatenate([self.nodes, nodes])
            self.count = np.concatenate([self.count, np.zeros(len(nodes), np.int64)])
            self.label = np.concatenate([self.label, np.arange(n, n + len(nodes))])
        return self.start[block]

    def connect(self, a: np.ndarray, b: np.ndarray) -> None:
        self.edges.append((a, b))
        self.held += len(a)
        if self.held >= HELD_EDGES:
            self.merge()

    def merge(self) -> None:
        if self.held:
            a, b = (np.concatenate(x) for x in zip(*self.edges))
            self.label = local_components(len(self.nodes), a, b, self.label)
        self.edges, self.held = [], 0

    def result(self) -> Iterator[pa.RecordBatch]:
        self.merge()
        hit, joined = np.flatnonzero(self.count), np.flatnonzero(self.label != np.arange(len(self.label)))
        for x, v, n in ((hit, None, self.count), (joined, self.nodes[self.label], None)):
            for lo in range(0, len(x), 100_000):
                s = x[lo:lo + 100_000]
                none = pa.nulls(len(s), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(self.nodes[s]), none if v is None else pa.array(v[s]),
                                                  none if n is None else pa.array(n[s])], names=["u", "v", "n"])


def _where(x: np.ndarray) -> np.ndarray:
    """Where ``x`` holds, which is mostly nowhere: found by eight at a time."""
    if len(x) % 8:
        return np.flatnonzero(x)
    at = np.flatnonzero(x.view(np.uint64))
    i, j = np.nonzero(x.reshape(-1, 8)[at])
    return at[i] * 8 + j


def _meet(a: _Block, b: _Block, ia: np.ndarray, ib: np.ndarray, at: int, bt: int, same: bool, min_cosine: float, links: _Links) -> None:
    """Links between the rows ``ia`` of ``a`` and ``ib`` of ``b``, which stand
    from ``at`` and ``bt`` on in ``links``; within one block, pairs count once."""
    least = np.float32(min_cosine - 2e-7 * (a.unit.shape[1] + 32))      # more than single precision can lose
    for c in range(0, len(ib), MEMBER_BLOCK):
        cols = ib[c:c + MEMBER_BLOCK]
        first = np.ascontiguousarray(b.first[cols].T)
        for r in range(0, len(ia), TILE_ROWS):
            rows = ia[r:r + TILE_ROWS]
            if same and rows[0] >= cols[-1]:
                continue
            may = (a.first[rows] @ first >= least).ravel()
            some = _where(may)
            if 16 * len(some) > len(may):                               # a crowd: decided by a matrix product
                near = a.unit[rows] @ b.unit[cols].T >= min_cosine
                if same:
                    near &= rows[:, None] < cols[None, :]
                links.count[at + rows] += near @ b.weight[cols]
                links.count[bt + cols] += a.weight[rows] @ near
                links.merge()
                near &= links.label[at + rows][:, None] != links.label[bt + cols][None, :]
                i, j = np.nonzero(near)
                i, j = rows[i], cols[j]
            elif len(some):
                i, j = rows[some // len(cols)], cols[some % len(cols)]
                if same:
                    i, j = i[i < j], j[i < j]
                near = np.einsum("ij,ij->i", a.unit[i], b.unit[j]) >= min_cosine
                i, j = i[near], j[near]
                np.add.at(links.count, at + i, b.weight[j])
                np.add.at(links.count, bt + j, a.weight[i])
            else:
                continue
            if len(i):
                links.connect(at + i, bt + j)


def _links_of(spark, classes: DataFrame, dim: int, kind: str, min_cosine: float) -> DataFrame:
    """Rows (u, null, n): class u has n linked vectors among those a task met;
    rows (u, v, null): u and v are connected."""
    total = classes.count()
    n_pivots = int(max(1, min(MAX_PIVOTS, total // CELL_ROWS)))
    sample = classes.orderBy(F.xxhash64("key"), "key").select("vec").limit(max(n_pivots, AXIS_ROWS)).collect()
    sample = unit_matrix([bytes(r["vec"]) for r in sample], kind)
    pivots = sample[:n_pivots].copy()
    reach = float(np.arccos(min_cosine))
    shared = spark.sparkContext.broadcast((pivots, _axes(sample, min_cosine)))

    def home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                cos = unit_matrix(pdf["vec"], kind) @ shared.value[0].T
                cell = cos.argmax(axis=1)
                angle = np.arccos(np.clip(cos[np.arange(len(cell)), cell], -1, 1))
                yield pdf.assign(cell=cell.astype("int32"), angle=angle)

    homed = saved(classes.select("node", "vec", "n").mapInPandas(
        home, "node bigint, vec binary, n bigint, cell int, angle double"), "vec-home")
    # one row per pivot
    radius = np.full(n_pivots, -np.inf)
    for r in homed.groupBy("cell").agg(F.max("angle").alias("radius")).collect():
        radius[r["cell"]] = r["radius"]
    gap = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 0))
    chord = 2 * np.sin(reach / 2)

    def enters(unit: np.ndarray, cell: int, others) -> np.ndarray:
        """(row, other): whether a row of ``cell`` may have partners in those cells."""
        own = unit @ shared.value[0][cell]
        cos = unit @ shared.value[0][others].T
        angle, home = np.arccos(np.clip(cos, -1, 1)), np.arccos(np.clip(own, -1, 1))
        keep = (angle <= home[:, None] + 2 * reach + _SLACK) & (angle <= radius[others] + reach + _SLACK)
        keep &= own[:, None] - cos <= (chord + _SLACK) * gap[cell][others] + _SLACK
        return keep | (np.asarray(others) == cell)

    block_rows = max(1, min(OWN_BLOCK, BLOCK_BYTES // (dim * np.dtype(kind).itemsize)))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows in order of their cells, as blocks of one cell each."""
        def block(cell: int, rows: pd.DataFrame) -> pd.DataFrame:
            unit, sees = unit_matrix(rows["vec"], kind), np.zeros(n_pivots, bool)
            for lo in range(0, len(rows), 1024):
                sees |= enters(unit[lo:lo + 1024], cell, np.arange(n_pivots)).any(axis=0)
            return pd.DataFrame({"cell": pd.Series([cell], dtype="int32"), "node": [rows["node"].to_numpy("<i8").tobytes()],
                                 "n": [rows["n"].to_numpy("<i8").tobytes()], "vec": [b"".join(rows["vec"])], "sees": [sees]})

        held, size, last = [], 0, None
        for pdf in batches:
            for cell, rows in pdf.groupby("cell", sort=False):
                if cell != last and size:
                    yield block(last, pd.concat(held))
                    held, size = [], 0
                last, lo = int(cell), 0
                while lo < len(rows):
                    part = rows.iloc[lo:lo + block_rows - size]
                    held, size, lo = [*held, part], size + len(part), lo + len(part)
                    if size == block_rows:
                        yield block(last, pd.concat(held))
                        held, size = [], 0
        if size:
            yield block(last, pd.concat(held))

    blocks = saved(homed.select("node", "vec", "n", "cell").repartitionByRange("cell", "node").sortWithinPartitions("cell", "node")
                   .mapInPandas(pack, "cell int, node binary, n binary, vec binary, sees array<boolean>")
                   .withColumn("block", F.monotonically_increasing_id()), "vec-blocks")
    discard(homed)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links, held = _Links(), {}

        def ready(batch: pa.RecordBatch, i: int, side: str) -> tuple[int, _Block]:
            name = batch.column(f"{side}_block")[i].as_py()
            held[name] = held.pop(name, None) or _Block(batch, i, side, kind, shared.value[1])     # the last used stand last
            return name, held[name]

        for batch in batches:
            for i in range(batch.num_rows):
                (x, a), (y, b) = ready(batch, i, "a"), ready(batch, i, "b")
                at, bt = links.place(x, a.nodes), links.place(y, b.nodes)
                if a.cell == b.cell:
                    ia, ib = np.arange(len(a.nodes)), np.arange(len(b.nodes))
                else:
                    ia = np.flatnonzero(enters(a.unit, a.cell, [b.cell]))
                    ib = np.flatnonzero(enters(b.unit, b.cell, [a.cell]))
                _meet(a, b, ia, ib, at, bt, x == y, min_cosine, links)
                links.merge()
                while len(held) > 2 and sum(z.bytes for z in held.values()) > HELD_BYTES:
                    del held[next(iter(held))]
        yield from links.result()

    side = lambda s: blocks.select(*[F.col(c).alias(f"{s}_{c}") for c in blocks.columns])
    # one of (a, b) and (b, a), by turns, so that tasks get alike
    once = ((F.col("a_block") == F.col("b_block"))
            | ((F.col("a_block") < F.col("b_block")) == ((F.col("a_block") + F.col("b_block")) % 2 == 1)))
    pairs = side("a").hint("shuffle_replicate_nl").join(
        side("b"), once & F.expr("a_sees[b_cell]") & F.expr("b_sees[a_cell]"))
    found = saved(pairs.drop("a_sees", "b_sees").mapInArrow(join, "u bigint, v bigint, n bigint"), "vec-links")
    discard(blocks)
    return found
