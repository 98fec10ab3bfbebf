"""Source/sink, generator and ordering queries (ops 1-10, 17, 24, 27-30)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rungkit.functions import text as tx
from rungkit.operators import curriculum as cur
from rungkit.operators import normalize as nz
from rungkit.operators import ordering as od
from rungkit.plans.q_curriculum import _STATE, _rec
from rungkit.plans.registry import register
from rungkit.plans.sqlutil import hash_extract
from rungkit.session import scratch_path
from rungkit.sources import io
from rungkit.sources import views as V
from rungkit.sources.generators import gen_parity
from rungkit.sources.tables import table
from rungkit.streaming.curriculum_stream import advance

W = V.with_views
GEN_LEN, GEN_BITS, GEN_SEED = 16, 1, 1
TEST_SHARE, SPLIT_SEED = 0.07, 42
BATCH, SHUFFLE_SEED = 64, 1
WORLD, GLOBAL_BATCH, MICRO, EPOCH = 4, 32, 4, 1


def _path(sf, name):
    return f"{sf.rstrip('/')}/{name}.parquet"


@register("scan_concat", """
SELECT CAST(0 AS BIGINT) AS file_idx, doc_id AS row_id, length(text) AS text_len, lang FROM documents
UNION ALL SELECT 1, item_id, length(text), NULL FROM benchmark""")
def q_scan_concat(spark, sf):
    """documents and benchmark read as one table in list order (unequal schemas unioned by name)."""
    d = io.scan_concat(spark, [_path(sf, "documents"), _path(sf, "benchmark")])
    return d.select("file_idx", F.coalesce("doc_id", "item_id").alias("row_id"),
                    F.length("text").cast("bigint").alias("text_len"), "lang")


@register("take_first_n", """
(SELECT CAST(0 AS BIGINT) AS file_idx, doc_id AS row_id FROM documents ORDER BY doc_id LIMIT 100)
UNION ALL (SELECT 1, item_id FROM benchmark ORDER BY item_id LIMIT 20)""")
def q_take_first_n(spark, sf):
    """First n rows of each input in key order (a top-k, then concatenation)."""
    a = od.take_first_n(table(spark, sf, "documents"), "doc_id", 100).select(
        F.lit(0).alias("file_idx"), F.col("doc_id").alias("row_id"))
    b = od.take_first_n(table(spark, sf, "benchmark"), "item_id", 20).select(
        F.lit(1).alias("file_idx"), F.col("item_id").alias("row_id"))
    return a.unionByName(b)


_NORM_ROWS = f"""
SELECT id, split, {hash_extract('answer')} AS ground_truth FROM qa_hash WHERE {hash_extract('answer')} IS NOT NULL"""


@register("write_splits", W(["qa_hash"], _NORM_ROWS))
def q_write_splits(spark, sf):
    """Normalised rows written as one parquet folder per split, read back."""
    good, _ = nz.norm_hash(V.qa_hash(spark, sf))
    flat = good.select("id", F.col("extra_info.split").alias("split"),
                       F.col("reward_model.ground_truth").alias("ground_truth"))
    path = scratch_path(spark, "splits")
    io.write_splits(flat, path)
    back = io.read_splits(spark, path)
    return back.select("id", "split", "ground_truth")


@register("mirror_copy", W(["qa_hash"], f""", r AS ({_NORM_ROWS.strip()})
SELECT c.copy_idx, split, count(*) AS n_rows FROM r, (SELECT unnest([0, 1]::BIGINT[]) AS copy_idx) c GROUP BY c.copy_idx, split"""))
def q_mirror_copy(spark, sf):
    """One computed frame written to two destinations; both read back and counted."""
    good, _ = nz.norm_hash(V.qa_hash(spark, sf))
    flat = good.select("id", F.col("extra_info.split").alias("split"))
    paths = [scratch_path(spark, "mirror_a"), scratch_path(spark, "mirror_b")]
    io.mirror_copy(flat, paths)
    outs = [io.read_splits(spark, p).groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))
            .withColumn("copy_idx", F.lit(i)) for i, p in enumerate(paths)]
    return outs[0].unionByName(outs[1])


@register("preview_head", """
SELECT doc_id, lang, source, n_chars FROM documents ORDER BY doc_id LIMIT 5""")
def q_preview_head(spark, sf):
    return io.preview_head(table(spark, sf, "documents"), "doc_id", 5).select("doc_id", "lang", "source", "n_chars")


@register("dataset_profile", W(["multi_gen"], """
SELECT source, count(*) AS n_rows,
       count(*) FILTER (WHERE regexp_replace(coalesce(answer, ''), '^\\s+|\\s+$', '', 'g') = '') AS empty_answers,
       count(*) FILTER (WHERE regexp_replace(coalesce(solution, ''), '^\\s+|\\s+$', '', 'g') = '') AS empty_solutions,
       count(*) FILTER (WHERE correctness_math_verify IS NULL) AS no_flags
FROM multi_gen GROUP BY source"""))
def q_dataset_profile(spark, sf):
    """Row and emptiness counts per source in one aggregation pass."""
    d = V.multi_gen(spark, sf)
    return io.dataset_profile(d, ["source"], {
        "empty_answers": tx.is_blank("answer"),
        "empty_solutions": tx.is_blank("solution"),
        "no_flags": F.col("correctness_math_verify").isNull()})


@register("gen_parity", "SELECT * FROM " + V.sql_gen_parity(GEN_LEN, GEN_BITS, GEN_SEED, False))
def q_gen_parity(spark, sf):
    """x/y sequences of 16 one-bit values per document id; z = x xor y."""
    return gen_parity(table(spark, sf, "documents").select("doc_id"), "doc_id", GEN_LEN, GEN_BITS, GEN_SEED)


@register("gen_cumulative_parity", "SELECT * FROM " + V.sql_gen_parity(GEN_LEN, GEN_BITS, GEN_SEED, True))
def q_gen_cumulative_parity(spark, sf):
    """As gen_parity with z the running xor."""
    return gen_parity(table(spark, sf, "documents").select("doc_id"), "doc_id", GEN_LEN, GEN_BITS, GEN_SEED,
                      cumulative=True)


@register("norm_parity", "WITH g AS " + V.sql_gen_parity(GEN_LEN, GEN_BITS, GEN_SEED, False) + f"""
SELECT doc_id, 'xor/sequence_{GEN_LEN}_bitwidth_{GEN_BITS}' AS data_source, 'user' AS role, x_text AS content,
       CAST(1 AS BIGINT) AS n_msgs, answer, 'math' AS ability, 'rule' AS style, answer AS ground_truth,
       CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split,
       row_number() OVER (PARTITION BY doc_id % 5 = 0 ORDER BY doc_id) - 1 AS "index"
FROM g""")
def q_norm_parity(spark, sf):
    """Generated parity rows as rl rows (prompt = x, no instruction, truth = answer)."""
    g = gen_parity(table(spark, sf, "documents").select("doc_id"), "doc_id", GEN_LEN, GEN_BITS, GEN_SEED)
    g = g.withColumn("split", F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train"))
    g = od.assign_index(g, "doc_id", partition_by="split", out="index")
    rows = nz.norm_parity(g, key="doc_id", ds=f"xor/sequence_{GEN_LEN}_bitwidth_{GEN_BITS}", index="index")
    return nz.flatten_rl(rows, "doc_id", extra=("split", "index"))


@register("norm_parity_r3", "WITH g AS " + V.sql_gen_parity(GEN_LEN, GEN_BITS, GEN_SEED, True) + f"""
SELECT doc_id, 'xor/r3_sequence_{GEN_LEN}_bitwidth_{GEN_BITS}' AS data_source, 'user' AS role,
       x_text || ' ' AS content, CAST(1 AS BIGINT) AS n_msgs, answer, 'math' AS ability, 'rule' AS style,
       answer AS ground_truth, CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split
FROM g""")
def q_norm_parity_r3(spark, sf):
    """Cumulative-parity rows in the R3 form: the prompt keeps a trailing space."""
    g = gen_parity(table(spark, sf, "documents").select("doc_id"), "doc_id", GEN_LEN, GEN_BITS, GEN_SEED,
                   cumulative=True)
    g = g.withColumn("split", F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train"))
    rows = nz.norm_parity(g, key="doc_id", ds=f"xor/r3_sequence_{GEN_LEN}_bitwidth_{GEN_BITS}", r3=True)
    return nz.flatten_rl(rows, "doc_id", extra=("split",))


@register("state_snapshot", _rec(["attempts_train"], "," + _STATE.lstrip() + """
SELECT sample_id, last_portion, round(last_mean_reward, 9) AS last_mean_reward,
       round(max_per_sample_ratio, 9) AS max_per_sample_ratio, round(mean_min_ratio, 9) AS mean_min_ratio,
       round(mean_max_ratio, 9) AS mean_max_ratio
FROM state"""))
def q_state_snapshot(spark, sf):
    """Curriculum state dumped at two steps; restore picks the latest one."""
    att = V.attempts(spark, sf)
    root = scratch_path(spark, "state")
    for step in (14, 29):
        upto = att.filter(F.col("step") <= step)
        st = cur.sample_state(upto.filter(F.col("split") == "train"), att)
        per = st.select("sample_id", "last_portion", "last_mean_reward", "max_per_sample_ratio")
        glob = st.select("mean_min_ratio", "mean_max_ratio").limit(1)
        io.state_snapshot(per, glob, root, step)
    per, glob, _ = io.state_restore(spark, root)
    return per.crossJoin(F.broadcast(glob))   # one-row side


RESUME_STEPS = (7, 14, 21, 29)


@register("state_resume", _rec(["attempts_train"], "," + _STATE.lstrip() + """,
run_ends AS (SELECT sample_id, max_by(run_n, step) AS run_n, max_by(portion, step) AS last_portion,
             max_by(run_mean_reward * run_n, step) AS run_sum, max_by(max_ratio_after, step) AS max_per_sample_ratio, max(step) AS last_step
      FROM (SELECT * FROM terms) GROUP BY sample_id)
SELECT sample_id, last_portion, run_n, round(run_sum, 9) AS run_sum, round(max_per_sample_ratio, 9) AS max_per_sample_ratio, last_step,
       round(f.mean_min_ratio, 9) AS mean_min_ratio, round(f.mean_max_ratio, 9) AS mean_max_ratio
FROM run_ends CROSS JOIN final f"""))
def q_state_resume(spark, sf):
    """State advanced in four pieces, each restored from what the one before
    wrote (a full version, deltas, one compaction): as one pass leaves it."""
    att = V.attempts(spark, sf)
    root, before = scratch_path(spark, "state-log"), -1
    for step in RESUME_STEPS:
        advance(att.filter((F.col("step") > before) & (F.col("step") <= step)), root, compact_every=3)
        before = step
    per, glob, _ = io.state_restore(spark, root)
    return per.crossJoin(F.broadcast(glob))   # one-row side


@register("assign_index", W(["qa_hash"], """
SELECT id, split, row_number() OVER (PARTITION BY split ORDER BY id) - 1 AS "index" FROM qa_hash"""))
def q_assign_index(spark, sf):
    return od.assign_index(V.qa_hash(spark, sf), "id", partition_by="split").select("id", "split", "index")


def _h(seed, key):
    return f"('0x' || substr(md5('{seed}:' || CAST({key} AS VARCHAR)), 1, 8))::BIGINT"


@register("split_train_test", f"""
SELECT doc_id, CASE WHEN r < ceil(n * CAST({TEST_SHARE} AS DOUBLE)) THEN 'test' ELSE 'train' END AS split FROM (
  SELECT doc_id, row_number() OVER (ORDER BY {_h(SPLIT_SEED, 'doc_id')}, doc_id) - 1 AS r, count(*) OVER () AS n
  FROM documents)""")
def q_split_train_test(spark, sf):
    """Exact-size shuffled split (test = ceil(n * 0.07) rows in seeded hash order)."""
    d = table(spark, sf, "documents").select("doc_id")
    return od.split_train_test(d, "doc_id", TEST_SHARE, SPLIT_SEED)


@register("shuffle_batches", f"""
SELECT doc_id, r // {BATCH} AS batch_id, r % {BATCH} AS batch_pos FROM (
  SELECT doc_id, row_number() OVER (ORDER BY {_h(SHUFFLE_SEED, 'doc_id')}, doc_id) - 1 AS r, count(*) OVER () AS n
  FROM documents) WHERE r // {BATCH} < n // {BATCH}""")
def q_shuffle_batches(spark, sf):
    """Seeded shuffle into full batches of 64 (last incomplete batch dropped)."""
    d = table(spark, sf, "documents").select("doc_id")
    return od.shuffle_batches(d, "doc_id", BATCH, SHUFFLE_SEED)


@register("val_single_batch", W(["qa_hash"], """
SELECT id, CAST(0 AS BIGINT) AS batch_id, row_number() OVER (ORDER BY id) - 1 AS batch_pos FROM qa_hash WHERE split = 'test'"""))
def q_val_single_batch(spark, sf):
    """Validation split as one unshuffled batch holding every row."""
    return od.val_single_batch(V.qa_hash(spark, sf).filter("split = 'test'"), "id").select("id", "batch_id", "batch_pos")


@register("rank_shards", f"""
SELECT doc_id, r % {WORLD} AS dp_rank, r // {WORLD} AS slot, (r // {WORLD}) // {GLOBAL_BATCH // WORLD} AS batch_id,
       ((r // {WORLD}) % {GLOBAL_BATCH // WORLD}) // {MICRO} AS micro_id
FROM (SELECT doc_id, row_number() OVER (ORDER BY {_h('0-' + str(EPOCH), 'doc_id')}, doc_id) - 1 AS r,
             count(*) OVER () AS n FROM documents)
WHERE r // {WORLD} < n // {WORLD} AND (r // {WORLD}) // {GLOBAL_BATCH // WORLD} < (n // {WORLD}) // {GLOBAL_BATCH // WORLD}""")
def q_rank_shards(spark, sf):
    """Data-parallel shards (world 4, global batch 32, micro 4) for epoch 1, drop_last."""
    d = table(spark, sf, "documents").select("doc_id")
    return od.rank_shards(d, "doc_id", WORLD, GLOBAL_BATCH, MICRO, epoch=EPOCH)
