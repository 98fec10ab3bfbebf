"""Token tables and padded training sequences (ops 62-66).

The tokenizer is pluggable (a Column -> array<string> function); the
default is Python-``split()``-style ``\\S+`` pieces. Ids come from a
dense vocabulary ranked by (count desc, token) without a global sort.
Encoding looks tokens up in dictionaries of chunks of rows: a chunk's
distinct tokens are joined to the vocabulary (those frequent enough to skew
a shuffle are broadcast, at most 1 / HOT_TOKEN_SHARE of them), so shuffles
follow distinct tokens, not positions.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rungkit.functions import text as tx
from rungkit.operators.materialize import materialize
from rungkit.operators.ordering import prefix_offsets

PAD_ID, EOS_ID, N_SPECIAL = 0, 1, 2
UNKNOWN_FAILS = None        # policy for tokens outside the vocabulary: fail the job
CHUNK_ROWS = 1024           # rows that share a dictionary
HOT_TOKEN_SHARE = 1e-4      # tokens above this share of all positions are broadcast

Tokenizer = Callable[[Column], Column]


def default_tokenizer(c: Column) -> Column:
    return tx.words(c)


def vocab_build(df: DataFrame, text_cols, tokenizer: Tokenizer = default_tokenizer,
                n_special: int = N_SPECIAL) -> DataFrame:
    """(token, count, id): id = n_special + rank by (count desc, token)."""
    cols = [text_cols] if isinstance(text_cols, str) else list(text_cols)
    toks = None
    for c in cols:
        t = df.select(F.explode(tokenizer(F.col(c))).alias("token"))
        toks = t if toks is None else toks.unionByName(t)
    counts = toks.groupBy("token").agg(F.count(F.lit(1)).cast("bigint").alias("count"))
    # ranges of the order with sampled bounds: even whatever the tokens look
    # like; written once, so that a row's range is settled
    n_ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("count").desc(), F.col("token")]
    ranged = materialize(counts.repartitionByRange(n_ranges, *order)
                         .withColumn("_range", F.spark_partition_id().cast("bigint")), "token_counts")
    r = prefix_offsets(ranged, order, F.col("_range"), out="_rank")      # n_ranges offsets
    return r.withColumn("id", (F.col("_rank") + F.lit(n_special)).cast("bigint")).drop("_rank", "_range")


def _known(id_: Column, token: str, unknown_id: int | None) -> Column:
    """The id, ``unknown_id`` for a token outside the vocabulary, or a failed
    job if there is none."""
    if unknown_id is not None:
        return F.coalesce(id_, F.lit(int(unknown_id)).cast("bigint"))
    bad = F.raise_error(F.concat(F.lit("token outside the vocabulary: "), F.col(token))).cast("bigint")
    return F.when(id_.isNull(), bad).otherwise(id_)


def encode(df: DataFrame, key: str, text: Column, vocab: DataFrame, out: str,
           tokenizer: Tokenizer = default_tokenizer, unknown_id: int | None = UNKNOWN_FAILS) -> DataFrame:
    """Add ``out`` = token ids of ``text`` in order (empty array for no tokens)."""
    return encode_many(df, key, {out: text}, vocab, tokenizer, unknown_id)


def chunk_dictionaries(tokens: DataFrame, vocab: DataFrame, unknown_id: int | None) -> DataFrame:
    """(_chunk, tokens, ids): the dictionary of every chunk, from the distinct
    (_chunk, token) rows of ``tokens``.  A token that most chunks hold would be
    a hot key; those above HOT_TOKEN_SHARE of all positions are broadcast."""
    total = vocab.agg(F.greatest(F.lit(1.0), F.sum("count") * F.lit(HOT_TOKEN_SHARE)).alias("_thr"))
    v = vocab.crossJoin(F.broadcast(total))            # one-row side
    hot = v.filter(F.col("count") >= F.col("_thr")).select("token", F.col("id").alias("_hid"))
    cold = v.filter(F.col("count") < F.col("_thr")).select("token", F.col("id").alias("_cid"))
    j = tokens.join(F.broadcast(hot), "token", "left").join(cold, "token", "left")      # <= 1/HOT_TOKEN_SHARE rows; no cold key is hot
    j = j.select("_chunk", "token", _known(F.coalesce("_hid", "_cid"), "token", unknown_id).alias("_tid"))
    return j.groupBy("_chunk").agg(F.collect_list("token").alias("_tokens"), F.collect_list("_tid").alias("_ids"))


def encode_many(df: DataFrame, key: str, texts: dict, vocab: DataFrame,
                tokenizer: Tokenizer = default_tokenizer, unknown_id: int | None = UNKNOWN_FAILS) -> DataFrame:
    """Encode several text columns in one pass ({out: text Column}).

    Rows are taken in chunks of CHUNK_ROWS; a chunk's distinct tokens are
    joined to the vocabulary once, and its rows look their tokens up in the
    chunk's dictionary.  What is shuffled are distinct tokens and whole rows,
    never token positions.  ``key`` names the rows only for the caller.
    """
    outs = list(texts)
    d = df.withColumns({f"_t_{o}": F.coalesce(tokenizer(c), F.array().cast("array<string>")) for o, c in texts.items()})
    # the id's high bits are the partition, so a chunk's rows are of one partition
    d = materialize(d.withColumn("_chunk", F.expr(f"monotonically_increasing_id() div {CHUNK_ROWS}")), "encode_rows")
    seen = d.select("_chunk", F.explode(F.array_distinct(F.concat(*[F.col(f"_t_{o}") for o in outs]))).alias("token")).distinct()
    known = chunk_dictionaries(seen, vocab, unknown_id).withColumnRenamed("_chunk", "_c")
    plain = df.columns
    fields = ", ".join([f"{n} {t}" for n, t in df.dtypes] + [f"{o} array<bigint>" for o in outs])

    def look_up(rows: pa.Table, words: pa.Table) -> pa.Table:
        table = {}
        for tokens, ids in zip(words.column("_tokens").to_pylist(), words.column("_ids").to_pylist()):
            table.update(zip(tokens, ids))
        got = [pa.array([list(map(table.__getitem__, t)) for t in rows.column(f"_t_{o}").to_pylist()], pa.list_(pa.int64())) for o in outs]
        return pa.table([*[rows.column(n) for n in plain], *got], names=[*plain, *outs])

    return d.groupBy("_chunk").cogroup(known.groupBy("_c")).applyInArrow(look_up, fields)


def padding_report(df: DataFrame, batch: str, n_tokens: Column, max_len: int) -> DataFrame:
    """Per batch: rows, rows cut at ``max_len``, tokens kept and lost, and the
    share of positions that padding wastes, to ``max_len`` and to the batch's
    longest row."""
    kept = F.least(n_tokens, F.lit(max_len))
    g = df.groupBy(batch).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(F.when(n_tokens > max_len, 1)).alias("n_truncated"),
        F.sum(kept).cast("bigint").alias("tokens"), F.sum(n_tokens - kept).cast("bigint").alias("tokens_lost"),
        F.max(kept).cast("bigint").alias("longest"))
    waste = lambda width: F.lit(1.0) - F.col("tokens") / F.nullif(F.col("n_rows") * width, F.lit(0))
    return g.withColumns({"waste_fixed": waste(F.lit(max_len)), "waste_dynamic": waste(F.col("longest"))})


def position_ids(mask: Column) -> Column:
    """max(cumsum(mask) - 1, 0) for any 0/1 mask.

    A padded mask holds its ones in one run, where the place inside the run
    is the answer (linear); only a mask with gaps takes the running fold.
    """
    ones = F.aggregate(mask, F.lit(0).cast("bigint"), lambda n, m: n + m.cast("bigint"))
    first = F.array_position(mask, F.lit(1)).cast("bigint")
    whole = F.aggregate(F.slice(mask, F.greatest(first, F.lit(1)).cast("int"), F.greatest(ones, F.lit(0)).cast("int")),
                        F.lit(0).cast("bigint"), lambda n, m: n + m.cast("bigint")) == ones
    spots = F.when(F.size(mask) > 0, F.sequence(F.lit(1), F.size(mask))).otherwise(F.array().cast("array<int>"))
    shape = F.transform(spots, lambda i: F.struct(i.alias("i")))
    placed = F.zip_with(shape, F.array_repeat(F.struct(first.alias("f"), ones.alias("n")), F.size(mask)),
                        lambda s, x: F.greatest(F.least(s["i"] - x["f"], x["n"] - 1), F.lit(0)).cast("bigint"))
    return F.when(whole, placed).otherwise(_running_ids(mask))


def _running_ids(mask: Column) -> Column:
    run = F.aggregate(mask, F.array().cast("array<bigint>"),
                      lambda acc, m: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0))
                                                           + m.cast("bigint"))))
    return F.transform(run, lambda s: F.greatest(s - 1, F.lit(0)).cast("bigint"))


def _truncate(ids: Column, max_len: int, policy) -> Column:
    n = F.size(ids)
    if isinstance(policy, Column):     # per-row policy column (left / right / error)
        return F.when((policy == "left") & (n > max_len), F.slice(ids, n - max_len + 1, max_len)) \
                .when((policy == "right") & (n > max_len), F.slice(ids, 1, max_len)).otherwise(ids)
    if policy == "left":
        return F.when(n > max_len, F.slice(ids, n - max_len + 1, max_len)).otherwise(ids)
    if policy == "right":
        return F.when(n > max_len, F.slice(ids, 1, max_len)).otherwise(ids)
    if policy == "error":
        return F.when(n > max_len, F.raise_error(F.lit("sequence longer than max_length"))
                      .cast("array<bigint>")).otherwise(ids)
    raise ValueError(f"unknown truncation {policy!r}")


def truncate_policy(df: DataFrame, ids: str, max_len: int, policy) -> tuple[DataFrame, DataFrame]:
    """(kept, quarantined): ``error`` sends over-long rows to quarantine
    (use :func:`_truncate` with 'error' inside a job to fail it instead)."""
    over = F.size(ids) > max_len
    if isinstance(policy, Column):
        bad = over & (policy == "error")
        return df.filter(~bad).withColumn(ids, _truncate(F.col(ids), max_len, policy)), df.filter(bad)
    if policy == "error":
        return df.filter(~over), df.filter(over)
    return df.withColumn(ids, _truncate(F.col(ids), max_len, policy)), df.filter("false")


def sft_sequences(df: DataFrame, prompt_ids: str, response_ids: str, max_len: int, policy="error",
                  pad_id: int = PAD_ID, eos_id: int = EOS_ID) -> tuple[DataFrame, DataFrame]:
    """ids = prompt ++ response ++ [eos], right-padded; loss mask = attention
    with the first prompt_len-1 positions and the last real token zeroed."""
    d = df.withColumn("_pl", F.size(prompt_ids)) \
          .withColumn("_rl", F.size(response_ids) + 1) \
          .withColumn("_ids", F.concat(F.col(prompt_ids), F.col(response_ids), F.array(F.lit(eos_id).cast("bigint"))))
    kept, bad = truncate_policy(d, "_ids", max_len, policy)
    n = F.size("_ids")
    L = F.lit(max_len)
    ids = F.concat(F.col("_ids"), F.array_repeat(F.lit(pad_id).cast("bigint"), L - n))
    att = F.concat(F.array_repeat(F.lit(1).cast("bigint"), n), F.array_repeat(F.lit(0).cast("bigint"), L - n))
    prompt_cut = F.least(F.col("_pl"), L) - 1
    last = F.least(F.col("_pl") + F.col("_rl"), L) - 1
    loss = F.transform(att, lambda a, i: F.when((F.col("_pl") > 1) & (i < prompt_cut), F.lit(0).cast("bigint"))
                       .when(i == last, F.lit(0).cast("bigint")).otherwise(a))
    pos = F.transform(att, lambda a, i: F.least(i, n - 1).cast("bigint"))      # right padding closed form
    out = kept.withColumn("input_ids", ids).withColumn("attention_mask", att)
    out = out.withColumn("position_ids", pos).withColumn("loss_mask", loss)
    return out.drop("_pl", "_rl", "_ids"), bad.drop("_pl", "_rl", "_ids")


def rl_prompt_tokens(df: DataFrame, ids: str, max_len: int, policy: str = "left",
                     pad_id: int = PAD_ID) -> DataFrame:
    """Left-padded prompt ids, mask, positions and the unpadded raw ids."""
    d = df.withColumn("raw_prompt_ids", F.col(ids)).withColumn("_t", _truncate(F.col(ids), max_len, policy))
    n = F.size("_t")
    L = F.lit(max_len)
    d = d.withColumn("input_ids", F.concat(F.array_repeat(F.lit(pad_id).cast("bigint"), L - n), F.col("_t")))
    d = d.withColumn("attention_mask", F.concat(F.array_repeat(F.lit(0).cast("bigint"), L - n),
                                                F.array_repeat(F.lit(1).cast("bigint"), n)))
    d = d.withColumn("position_ids", F.transform("attention_mask",
                                                 lambda a, i: F.greatest(i - (L - n), F.lit(0)).cast("bigint")))
    return d.drop("_t")


def ids_text(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
