"""Phrase collocations by direct-address tiling.

Words get ids by falling frequency, so that pairs of frequent words crowd in
the corner of the (first id, second id) plane.  The plane is cut into tiles of
TILE x TILE cells, each cell addressed directly by its two offsets.  A chunk of
text counts its pairs tile by tile: where a tile has many of them by a dense
``bincount`` over its cells, elsewhere as a sorted list of (cell, count) (COO).
The tiles' counts are added up in two shuffles, first by (tile, salt), then by
tile, so that no task takes what all chunks have in the corner tile; a tile
never has more than TILE * TILE cells, whatever the input.

Pairs seen often enough become units: they are ranked by frequency in turn, and
a phrase of one more word is a pair (unit, word), counted over the same kind of
tiles; and so on to the longest phrases.  What is frequent is the only thing
carried on, since no phrase occurs more often than its parts.

The text is read twice, to count words and to write chunks of word ids.  The
HEAD_WORDS most frequent words (of at most HEAD_LENGTH bytes, so the size is
bounded) are handed to every task; where there are more frequent ones, a chunk
learns their ids by a join of its other distinct words.  The ids of its units a
chunk learns by sending its cells to the tile's ids (salted likewise) and
getting back those that are frequent; no dictionary of pairs is broadcast.

Pieces of text end at punctuation and line ends; phrases do not cross them.
Texts are cut at such ends only, so very long ones need no special care; one
piece alone is held whole.

Counts are exact; scores are integers computed in decimals of 38 digits.

Edge cases: null texts are empty; null groups are ``und``; empty texts have no
words; repeated rows count again; an empty table gives an empty table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rungkit.llm.common import discard, keyed, saved
from rungkit.llm.numbering import numbered

TILE_BITS = 11
TILE = 1 << TILE_BITS
DENSE = TILE * TILE // 16        # pairs of a tile from which its cells are counted directly
PART_BYTES = 1 << 20             # text cut into words at a time
CHUNK_WORDS = 1 << 20            # words of a chunk
HELD_CHUNKS = 3                  # chunks' words that a task holds over all groups
HELD_WORDS = 300_000             # distinct words that a task counts before it passes them on
HEAD_WORDS, HEAD_LENGTH = 1 << 18, 64
SALTS = 8
NO_GROUP = "und"
_END = b"\xff"                   # ends a piece; no byte of UTF-8
_CUT = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", _END * 10)
_TILE_KEYS = "lang string, r int, c int"


def pack(x: np.ndarray) -> bytes:
    """32-bit integers by byte planes (small numbers leave planes of zeros,
    which compress away)."""
    import zstandard
    return zstandard.ZstdCompressor(level=1).compress(x.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack(b: bytes) -> np.ndarray:
    import zstandard
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<i4").ravel()


def pack_cells(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=0))


def unpack_cells(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b), dtype=np.int64)


# -- words -------------------------------------------------------------------

def _parts(text: bytes) -> Iterator[bytes]:
    """A text cut at piece ends into parts of about PART_BYTES."""
    at = 0
    while len(text) - at > PART_BYTES:
        end = text.find(_END, at + PART_BYTES)
        if end < 0:
            break
        yield text[at:end]
        at = end + 1
    yield text[at:]


def _by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """(group, words and ends of pieces) of about PART_BYTES of text each;
    texts of a group are put together."""
    held: dict[str, list] = {}
    size: dict[str, int] = {}
    for b in batches:
        for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for part in _parts(text.encode().lower().translate(_CUT)):
                held.setdefault(lang, []).append(part)
                size[lang] = size.get(lang, 0) + len(part) + 50
                if size[lang] >= PART_BYTES or sum(size.values()) >= 8 * PART_BYTES:
                    most = max(size, key=size.get)
                    del size[most]
                    yield most, _words(held.pop(most))
    for lang, parts in held.items():
        yield lang, _words(parts)


def _words(parts: list[bytes]) -> list[bytes]:
    return _END.join([*parts, b""]).replace(_END, b" \xff ").split()


def _counted(rows: DataFrame) -> DataFrame:
    """lang, word, n of rows (text, lang)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, words in held.items():
                words.pop(_END, None)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(words), pa.string()),
                                                  "word": pa.array([w.decode() for w in words], pa.string()),
                                                  "n": pa.array(list(words.values()), pa.int64())})
            held.clear()

        for lang, words in _by_group(batches):
            held.setdefault(lang, Counter()).update(words)
            if sum(map(len, held.values())) > HELD_WORDS:
                yield from flush()
        yield from flush()

    return saved(rows.mapInArrow(count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")), "phrase-counts")


class _Ids(dict):
    """Ids of a chunk's words: the known ones, and codes from -2 down for others."""

    def __init__(self, known: dict):
        super().__init__(known)
        self.others: list[bytes] = []

    def __missing__(self, word):
        self.others.append(word)
        code = self[word] = -1 - len(self.others)
        return code


def _chunked(rows: DataFrame, vocab: DataFrame) -> DataFrame:
    """chunk, lang, w: the ids of a chunk's words, -1 at ends and rare words."""
    short = vocab.where(F.octet_length("word") <= HEAD_LENGTH).orderBy(F.desc("n"), "lang", "word").limit(HEAD_WORDS)
    head: dict[str, dict[bytes, int]] = {}
    for r in short.select("lang", "word", "idx").collect():            # HEAD_WORDS rows of HEAD_LENGTH bytes at most
        head.setdefault(r.lang, {_END: -1})[r.word.encode()] = r.idx
    known = sum(len(x) - 1 for x in head.values())
    whole = vocab.count() == known                                     # no frequent word besides
    shared = rows.sparkSession.sparkContext.broadcast(head)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        ids: dict[str, _Ids] = {}
        number = TaskContext.get().partitionId() << 32

        def flush(lang: str) -> pa.RecordBatch:
            nonlocal number
            number += 1
            others = ids.pop(lang).others if lang in ids else []
            return pa.RecordBatch.from_pydict({
                "chunk": pa.array([number], pa.int64()), "lang": pa.array([lang], pa.string()),
                "w": pa.array([pack(np.concatenate(held.pop(lang)))], pa.binary()),
                "others": pa.array([[w.decode() for w in others]], pa.list_(pa.string()))})

        for lang, words in _by_group(batches):
            table = shared.value.get(lang, {_END: -1})
            if whole:
                got = np.fromiter(map(table.get, words, repeat(-1)), np.int32, len(words))
            else:
                if lang not in ids:
                    ids[lang] = _Ids(table)
                got = np.fromiter(map(ids[lang].__getitem__, words), np.int32, len(words))
            held.setdefault(lang, []).append(got)
            size = {x: sum(map(len, parts)) for x, parts in held.items()}
            if size[lang] >= CHUNK_WORDS:
                yield flush(lang)
            elif sum(size.values()) > HELD_CHUNKS * CHUNK_WORDS or len(ids) > HELD_CHUNKS:
                yield flush(max(size, key=size.get))
        for lang in list(held):
            yield flush(lang)

    chunks = saved(rows.mapInArrow(cut, "chunk bigint, lang string, w binary, others array<string>"), "phrase-words")
    return chunks.drop("others") if whole else _with_others(chunks, vocab)


def _with_others(chunks: DataFrame, vocab: DataFrame) -> DataFrame:
    """``chunks`` with the ids of the words beyond the head."""
    seen = chunks.select("chunk", "lang", F.posexplode("others").alias("spot", "word"))
    own = (seen.join(vocab.select("lang", "word", "idx"), ["lang", "word"])
           .groupBy("chunk").agg(F.collect_list(F.struct("spot", "idx")).alias("known")))      # of a chunk's words

    def translate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known = b.column("known")
            for i in range(b.num_rows):
                w = unpack(b.column("w")[i].as_py()).astype(np.int64)
                table = np.full(b.column("n")[i].as_py(), -1, np.int64)
                if known[i].is_valid:
                    pairs = known[i].values
                    table[pairs.field("spot").to_numpy()] = pairs.field("idx").to_numpy()
                coded = w < -1                  # the others are ids, which may be beyond the table
                w[coded] = table[-2 - w[coded]]
                yield pa.RecordBatch.from_pydict({
                    "chunk": b.column("chunk").slice(i, 1), "lang": b.column("lang").slice(i, 1),
                    "w": pa.array([pack(w)], pa.binary())})

    return saved(chunks.select("chunk", "lang", "w", F.size("others").alias("n")).join(own, "chunk", "left")
                 .mapInArrow(translate, "chunk bigint, lang string, w binary"), "phrase-words")


# -- tiles -------------------------------------------------------------------

def _run_lengths(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and their counts, of sorted values."""
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    return x[first], np.diff(np.append(first, len(x)))


def tile_counts(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(tile row, tile column, cells in order, their counts) of pairs."""
    if not len(a):
        return
    r, c = a >> TILE_BITS, b >> TILE_BITS
    wide = int(c.max()) + 1
    tile, cell = r * wide + c, (a & TILE - 1) << TILE_BITS | (b & TILE - 1)
    order = np.argsort(tile, kind="stable")
    tile, cell = tile[order], cell[order]
    names, sizes = _run_lengths(tile)
    stop = np.cumsum(sizes)
    dense = sizes >= DENSE
    for t, lo, hi in zip(names[dense].tolist(), (stop - sizes)[dense].tolist(), stop[dense].tolist()):
        counts = np.bincount(cell[lo:hi])
        at = np.flatnonzero(counts)
        yield t // wide, t % wide, at, counts[at]
    if dense.all():
        return
    rest = ~np.repeat(dense, sizes)
    keys, counts = _run_lengths(np.sort(tile[rest] << 2 * TILE_BITS | cell[rest]))
    tile, cell = keys >> 2 * TILE_BITS, keys & (1 << 2 * TILE_BITS) - 1
    names, sizes = _run_lengths(tile)
    stop = np.cumsum(sizes)
    for t, lo, hi in zip(names.tolist(), (stop - sizes).tolist(), stop.tolist()):
        yield t // wide, t % wide, cell[lo:hi], counts[lo:hi]


class TileSum:
    """Adds counts of one tile: sorted lists while they are few, cells
    addressed directly from DENSE on."""

    def __init__(self):
        self.cells, self.counts, self.size, self.table = [], [], 0, None

    def add(self, cells: np.ndarray, counts: np.ndarray) -> None:
        if self.table is None:
            self.cells.append(cells)
            self.counts.append(counts)
            self.size += len(cells)
            if self.size < DENSE:
                return
            self.table = np.zeros(TILE * TILE, np.int64)
            for x, n in zip(self.cells, self.counts):
                self.table[x] += n
            self.cells, self.counts = [], []
        else:
            self.table[cells] += counts              # cells of a row are distinct

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        if self.table is not None:
            at = np.flatnonzero(self.table)
            return at, self.table[at]
        cells, counts = np.concatenate(self.cells), np.concatenate(self.counts)
        order = np.argsort(cells, kind="stable")
        cells, counts = cells[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
        return cells[first], np.add.reduceat(counts, first)


def _partial(units: DataFrame, k: int) -> DataFrame:
    """Each chunk's counts of (unit of k - 1 words, next word), by tile."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, b, live = _pairs(batch, i, k)
                rows = list(tile_counts(a[live], b[live]))
                if rows:
                    n = len(rows)
                    yield pa.RecordBatch.from_pydict({
                        "chunk": pa.array(batch.column("chunk").slice(i, 1).to_pylist() * n, pa.int64()),
                        "lang": pa.array(batch.column("lang").slice(i, 1).to_pylist() * n, pa.string()),
                        "r": pa.array([x[0] for x in rows], pa.int32()), "c": pa.array([x[1] for x in rows], pa.int32()),
                        "cells": pa.array([pack_cells(x[2]) for x in rows], pa.binary()),
                        "counts": pa.array([x[3].astype("<i8").tobytes() for x in rows], pa.binary())})

    return saved(units.mapInArrow(count, f"chunk bigint, {_TILE_KEYS}, cells binary, counts binary"), f"phrase-tiles{k}")


def _pairs(batch: pa.RecordBatch, i: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units and the words after them (both as ids), and where both are known."""
    w = unpack(batch.column("w")[i].as_py()).astype(np.int64)
    u = batch.column("u")[i].as_py()
    u = w if u is None else unpack(u).astype(np.int64)
    n = max(len(w) - k + 1, 0)
    a, b = u[:n], w[len(w) - n:]
    return a, b, (a >= 0) & (b >= 0)


def _merged(partial: DataFrame, least: int) -> DataFrame:
    """lang, u, w, n of the pairs counted ``least`` times or more."""
    def add(keys: list[str], finish):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, tile = None, None
            for b in batches:
                names = list(zip(*(b.column(x).to_pylist() for x in keys)))
                for i, name in enumerate(names):
                    if name != held:
                        if held is not None:
                            yield from finish(held, *tile.result())
                        held, tile = name, TileSum()
                    tile.add(unpack_cells(b.column("cells")[i].as_py()), np.frombuffer(b.column("counts")[i].as_py(), "<i8"))
            if held is not None:
                yield from finish(held, *tile.result())
        return run

    def repack(name, cells, counts):
        yield pa.RecordBatch.from_pydict({
            "lang": pa.array([name[0]], pa.string()), "r": pa.array([name[1]], pa.int32()), "c": pa.array([name[2]], pa.int32()),
            "cells": pa.array([pack_cells(cells)], pa.binary()), "counts": pa.array([counts.astype("<i8").tobytes()], pa.binary())})

    def frequent(name, cells, counts):
        often = counts >= least
        cells = cells[often]
        if len(cells):
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([name[0]] * len(cells), pa.string()),
                "u": pa.array((name[1] << TILE_BITS) + (cells >> TILE_BITS), pa.int64()),
                "w": pa.array((name[2] << TILE_BITS) + (cells & TILE - 1), pa.int64()), "n": pa.array(counts[often], pa.int64())})

    salted, tiles = ["lang", "r", "c", "salt"], ["lang", "r", "c"]
    once = (partial.withColumn("salt", _salt()).drop("chunk").repartition(*salted).sortWithinPartitions(*salted)
            .mapInArrow(add(salted, repack), f"{_TILE_KEYS}, cells binary, counts binary"))
    return (once.repartition(*tiles).sortWithinPartitions(*tiles)
            .mapInArrow(add(tiles, frequent), "lang string, u bigint, w bigint, n bigint"))


def _salt():
    return F.pmod(F.xxhash64("chunk"), F.lit(SALTS)).cast("int")


def _renamed(units: DataFrame, partial: DataFrame, ranked: DataFrame, k: int) -> DataFrame:
    """``units`` with each place's phrase of k words as unit, for the chunks
    that have any."""
    cell = ((F.col("u") % TILE) * TILE + F.col("w") % TILE).cast("int")
    side = lambda x: F.expr(f"cast({x} div {TILE} as int)")
    none = F.lit(None)
    ids = (ranked.groupBy("lang", side("u").alias("r"), side("w").alias("c"))        # at most a tile's cells
           .agg(F.array_sort(F.collect_list(F.struct(cell.alias("cell"), "idx"))).alias("table"))
           .select("lang", "r", "c", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(0).alias("asks"),
                   none.cast("bigint").alias("chunk"), none.cast("binary").alias("cells"), "table"))
    asked = partial.select("lang", "r", "c", _salt().alias("salt"), F.lit(1).alias("asks"), "chunk", "cells",
                           none.cast("array<struct<cell:int,idx:bigint>>").alias("table"))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = cells = idx = None
        for b in batches:
            keys = list(zip(*(b.column(x).to_pylist() for x in ("lang", "r", "c", "salt", "asks"))))
            for i, key in enumerate(keys):
                if not key[4]:
                    table = b.column("table")[i].values
                    held, cells, idx = key[:4], table.field("cell").to_numpy(), table.field("idx").to_numpy()
                elif key[:4] == held:
                    x = unpack_cells(b.column("cells")[i].as_py())
                    at = np.minimum(np.searchsorted(cells, x), len(cells) - 1)
                    hit = cells[at] == x
                    if hit.any():
                        yield pa.RecordBatch.from_pydict({
                            "chunk": b.column("chunk").slice(i, 1), "r": pa.array([key[1]], pa.int32()), "c": pa.array([key[2]], pa.int32()),
                            "cells": pa.array([pack_cells(x[hit])], pa.binary()), "ids": pa.array([pack(idx[at[hit]])], pa.binary())})

    salted = ["lang", "r", "c", "salt"]
    told = (ids.unionByName(asked).repartition(*salted).sortWithinPartitions(*salted, "asks")
            .mapInArrow(answer, "chunk bigint, r int, c int, cells binary, ids binary")
            .groupBy("chunk").agg(F.collect_list(F.struct("r", "c", "cells", "ids")).alias("told")))      # no more than the chunk's pairs

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                keys, new = [], []
                for x in b.column("told")[i].as_py():
                    cells = unpack_cells(x["cells"])
                    keys.append(((x["r"] << TILE_BITS) + (cells >> TILE_BITS)) << 32 | (x["c"] << TILE_BITS) + (cells & TILE - 1))
                    new.append(unpack(x["ids"]))
                keys, new = np.concatenate(keys), np.concatenate(new)
                order = np.argsort(keys)
                keys, new = keys[order], new[order]
                first, second, live = _pairs(b, i, k)
                own = first[live] << 32 | second[live]
                at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                u = np.full(len(first) + k - 1, -1, np.int64)
                u[np.flatnonzero(live)] = np.where(keys[at] == own, new[at], -1)
                yield pa.RecordBatch.from_pydict({
                    "chunk": b.column("chunk").slice(i, 1), "lang": b.column("lang").slice(i, 1),
                    "w": b.column("w").slice(i, 1), "u": pa.array([pack(u)], pa.binary())})

    return saved(units.join(told, "chunk").mapInArrow(rename, "chunk bigint, lang string, w binary, u binary"), f"phrase-units{k}")


# -- phrases -----------------------------------------------------------------

def frequent_phrases(df: DataFrame, text_col: str, group_col: str, least: int, most_words: int) -> tuple[DataFrame, DataFrame]:
    """(totals: lang, words), (phrases: lang, ids, phrase, a, firsts).  Phrases
    of 1 to ``most_words`` words that occur ``least`` times or more; ``ids``
    are their words' ids, ``firsts`` the counts of their beginnings."""
    rows = keyed(df, text_col, group_col).select(F.coalesce(F.col("c0").cast("string"), F.lit("")).alias("text"),
                                                 F.coalesce(F.col("c1").cast("string"), F.lit(NO_GROUP)).alias("lang"))
    counted = _counted(rows)
    totals = saved(counted.groupBy("lang").agg(F.sum("n").alias("words")), "phrase-totals")
    vocab = saved(numbered(counted.where(F.col("n") >= least).withColumn("less", -F.col("n")), "lang", ["less", "word"], keep_n="size"), "phrase-vocabulary")
    units = _chunked(rows, vocab).withColumn("u", F.lit(None).cast("binary"))
    words = vocab.select("lang", "idx", F.array("idx").alias("ids"), F.col("word").alias("phrase"), F.col("n").alias("a"),
                         F.array().cast("array<bigint>").alias("firsts"))
    found, shorter = [words], words
    for k in range(2, most_words + 1):
        partial = _partial(units, k)
        often = saved(_merged(partial, least).withColumn("less", -F.col("n")), f"phrase-pairs{k}")
        ranked = saved(numbered(often, "lang", ["less", "u", "w"], keep_n="size"), f"phrase-ranked{k}")
        s = shorter.select("lang", F.col("idx").alias("u"), F.col("ids").alias("s_ids"), F.col("phrase").alias("s_phrase"),
                           F.col("a").alias("s_a"), F.col("firsts").alias("s_firsts"))
        w = words.select("lang", F.col("idx").alias("w"), F.col("phrase").alias("word"))
        shorter = saved(ranked.join(s, ["lang", "u"]).join(w, ["lang", "w"])
                        .select("lang", "idx", F.concat("s_ids", F.array("w")).alias("ids"), F.concat_ws(" ", "s_phrase", "word").alias("phrase"),
                                F.col("n").alias("a"), F.concat("s_firsts", F.array("s_a")).alias("firsts")), f"phrase-found{k}")
        found.append(shorter)
        more = k < most_words and bool(shorter.limit(1).count())
        after = _renamed(units, partial, ranked, k) if more else None
        for done in (units, partial, often):           # what comes after is written
            discard(done)
        if not more:
            break
        units = after
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return totals, out.drop("idx")


def collocations(df: DataFrame, text_col: str, group_col: str, least: int = 100, most_words: int = 5) -> DataFrame:
    """lang, phrase, a, l, r, n, score of the phrases that no longer one
    explains (occurs as often and holds them)."""
    totals, phrases = frequent_phrases(df, text_col, group_col, least, most_words)
    phrases = saved(phrases, "phrase-all")
    longer = phrases.where(F.size("ids") > 1)
    rest = phrases.select(F.col("lang").alias("r_lang"), F.col("ids").alias("r_ids"), F.col("a").alias("r"))
    big = lambda c: F.col(c).cast("decimal(38,0)")
    cuts = (longer.join(totals, "lang")
            .select("lang", "ids", "phrase", "a", F.col("words").alias("n"), F.posexplode("firsts").alias("k", "l"))
            .withColumn("tail", F.expr("slice(ids, k + 2, size(ids))"))
            .join(rest, (F.col("lang") == F.col("r_lang")) & (F.col("tail") == F.col("r_ids")))
            .withColumn("over", (F.lit(1000).cast("decimal(38,0)") * big("a")).cast("decimal(38,0)") * big("n"))
            .withColumn("score", F.expr("over div cast(cast(l as decimal(38,0)) * cast(r as decimal(38,0)) as decimal(38,0))")))
    scored = (cuts.groupBy("lang", "ids", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))
              .select("lang", "ids", "phrase", "a", "m.l", "m.r", "n", "m.score"))
    # a phrase as frequent as one that holds it is as frequent as one of one word more
    held = (longer.where(F.size("ids") > 2)
            .select("lang", "a", F.explode(F.array(F.expr("slice(ids, 1, size(ids) - 1)"), F.expr("slice(ids, 2, size(ids) - 1)"))).alias("ids"))
            .groupBy("lang", "ids").agg(F.max("a").alias("most")))
    return (scored.join(held, ["lang", "ids"], "left").where("most is null or 100 * most < 100 * a")
            .select("lang", "phrase", "a", "l", "r", "n", "score"))


def first_of_each(df: DataFrame, top: int) -> DataFrame:
    """``rank`` 1 to ``top`` of every group, by score, then count, then phrase."""
    w = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).withColumn("rank", F.col("rank").cast("bigint"))
