"""Sources and sinks (ops 1-7, 10)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rungkit.operators.evaluate import passk_per_problem
from rungkit.operators.materialize import materialize

MSG = T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())])
EVAL_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("prompt", T.ArrayType(MSG)),
    T.StructField("completions", T.ArrayType(T.StringType())),
    T.StructField("rewards", T.ArrayType(T.DoubleType())),
    T.StructField("successes", T.ArrayType(T.BooleanType())),
    T.StructField("pass@k", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("ground_truth", T.StringType()),
])


def scan_concat(spark: SparkSession, paths: Sequence[str], schema: T.StructType | None = None,
                file_col: str = "file_idx") -> DataFrame:
    """Read several parquet inputs and concatenate them in list order.

    Each input keeps its position in ``file_col`` (order is explicit, not
    file-order luck); unequal structs are unioned by name with NULLs.
    """
    out = None
    for i, p in enumerate(paths):
        r = spark.read.schema(schema).parquet(p) if schema is not None else spark.read.parquet(p)
        r = r.withColumn(file_col, F.lit(i).cast("int"))
        out = r if out is None else out.unionByName(r, allowMissingColumns=True)
    if out is None:
        raise ValueError("no input paths")
    return out


def write_splits(df: DataFrame, path: str, split_col: str = "split", mode: str = "overwrite") -> None:
    """One parquet folder per split value (``split=train`` / ``split=test``)."""
    df.write.mode(mode).partitionBy(split_col).parquet(path)


def read_splits(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    d = spark.read.parquet(path)
    return d if split is None else d.filter(F.col("split") == split)   # partition pruning


def mirror_copy(df: DataFrame, paths: Sequence[str], split_col: str = "split") -> None:
    """Write one computed frame to several destinations (any Hadoop URI):
    the frame is computed and written once; the other sinks copy that
    written table instead of redoing the work."""
    if not paths:
        return
    write_splits(df, paths[0], split_col)
    first = read_splits(df.sparkSession, paths[0])
    for p in paths[1:]:
        write_splits(first, p, split_col)


def _need(df: DataFrame, what: str, *cols: str) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"{what} without {', '.join(missing)}")


def eval_records(problems: DataFrame, completions: DataFrame, key: str, n_max: int, score,
                 threshold: float = 0.0) -> DataFrame:
    """One record per problem from three inputs: ``problems`` (key,
    data_source, prompt, ground_truth), ``completions`` (key, sample_no,
    completion) and ``score``, a function that adds ``score`` to rows of
    (data_source, solution, ground_truth).

    Prompts meet their record once, not once per completion; the pass@k map
    is worked out once per distinct (n, c) pair and attached.  A missing score
    (a malformed truth) counts as no success.  A problem without completions
    has empty lists and no pass@k.  Completions that carry a ``score`` keep it
    (``score`` may then be None).
    """
    _need(problems, "problems", key, "data_source", "prompt", "ground_truth")
    _need(completions, "completions", key, "sample_no", "completion")
    rows = completions.withColumnRenamed("completion", "solution")
    if "score" not in completions.columns:
        rows = score(rows.select(key, "sample_no", "solution").join(problems.select(key, "data_source", "ground_truth"), key))
    g = (rows.groupBy(key)                      # one problem's samples
         .agg(F.array_sort(F.collect_list(F.struct("sample_no", "solution", "score"))).alias("_s")))
    g = g.select(F.col(key).alias("_key"), F.transform("_s", lambda x: x["solution"]).alias("completions"),
                 F.transform("_s", lambda x: x["score"].cast("double")).alias("rewards"))
    g = problems.select(key, "prompt", "ground_truth").join(g, F.col(key) == F.col("_key"), "left").drop("_key")
    for c, kind in (("completions", "array<string>"), ("rewards", "array<double>")):
        g = g.withColumn(c, F.coalesce(c, F.array().cast(kind)))
    g = g.withColumn("successes", F.transform("rewards", lambda r: F.coalesce(r > threshold, F.lit(False))))
    g = g.withColumns({"_n": F.size("completions").cast("bigint"),
                       "_c": F.size(F.filter("successes", lambda s: s)).cast("bigint")})
    g = materialize(g, "eval_records")
    curve = passk_per_problem(g.filter("_n > 0").select("_n", "_c").distinct().withColumnsRenamed({"_n": "n", "_c": "c"}), "n", n_max)
    curve = curve.groupBy("n", "c").agg(F.array_sort(F.collect_list(F.struct("k", "passk"))).alias("_k"))
    curve = curve.select("n", "c", F.map_from_entries(F.transform(
        "_k", lambda x: F.struct(x["k"].cast("string"), x["passk"]))).alias("pass@k"))
    none = F.create_map().cast("map<string,double>")
    return (g.join(curve, (F.col("_n") == F.col("n")) & (F.col("_c") == F.col("c")), "left")
            .select(F.col(key).cast("bigint").alias("id"), "prompt", "completions", "rewards", "successes",
                    F.coalesce(F.col("`pass@k`"), none).alias("pass@k"), "ground_truth"))


def write_eval_records(records: DataFrame, path: str) -> None:
    """Records as JSON lines, of exactly the fields and types of EVAL_SCHEMA."""
    have = {f.name: f.dataType.simpleString() for f in records.schema}
    for f in EVAL_SCHEMA:
        if have.get(f.name) != f.dataType.simpleString():
            raise ValueError(f"{f.name} should be {f.dataType.simpleString()}, not {have.get(f.name)}")
    records.select(*[F.col(f"`{f.name}`") for f in EVAL_SCHEMA]).write.mode("overwrite").json(path, ignoreNullFields=False)


def write_eval_jsonl(rollouts: DataFrame, key: str, sample: str, reward: str, n_max: int, path: str,
                     threshold: float = 0.0) -> None:
    """Records of rollouts that carry rewards but no texts: the key stands for
    the problem's, the sample's number for the completion."""
    name = F.col(key).cast("string")
    problems = rollouts.select(key).distinct().select(
        key, F.lit("").alias("data_source"), name.alias("ground_truth"),
        F.array(F.struct(F.lit("user").alias("role"), F.concat(F.lit("problem "), name).alias("content"))).alias("prompt"))
    rows = rollouts.select(key, F.col(sample).alias("sample_no"), F.col(sample).cast("string").alias("completion"),
                           F.col(reward).alias("score"))
    write_eval_records(eval_records(problems, rows, key, n_max, None, threshold), path)


def read_eval_jsonl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVAL_SCHEMA).json(path)


def preview_head(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """First n rows in key order; raises on an empty input (as the preview tool does)."""
    if not df.take(1):
        raise ValueError("empty input")
    return df.orderBy(key).limit(n)


def dataset_profile(df: DataFrame, by: Sequence[str], checks: dict) -> DataFrame:
    """One pass of counts grouped by ``by``: rows plus one count per named predicate."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"),
                               *[F.count(F.when(pred, 1)).cast("bigint").alias(name) for name, pred in checks.items()])


# ------------------------------------------------------------ curriculum state (op 10)
#
# A log under one root: ``step=N/samples`` holds either every sample (a base) or
# only those touched since the version before (a delta), ``step=N/global`` the
# global state, and ``step=N/manifest`` (written last, in one commit) says which
# of the two it is.  A version counts once its manifest is complete.

KIND = T.StructType([T.StructField("kind", T.StringType()), T.StructField("base", T.LongType())])


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def state_snapshot(per_sample: DataFrame, global_state: DataFrame, root: str, step: int, base: int | None = None) -> str:
    """One version of the state: every sample, or, with ``base`` (the step of
    an earlier full version), those touched since the version before.  Written
    with overwrite, so a retried step replaces its own version."""
    spark = per_sample.sparkSession
    path = f"{root.rstrip('/')}/step={int(step)}"
    _, manifest, fs = _hadoop(spark, f"{path}/manifest")
    fs.delete(manifest, True)                     # from here on it does not count
    per_sample.write.mode("overwrite").parquet(f"{path}/samples")
    global_state.write.mode("overwrite").parquet(f"{path}/global")
    kind = "full" if base is None else "delta"
    spark.createDataFrame([(kind, int(step) if base is None else int(base))], KIND).coalesce(1) \
        .write.mode("overwrite").json(f"{path}/manifest")
    return path


def complete_steps(spark: SparkSession, root: str) -> list[int]:
    """Steps under ``root`` whose version is complete (via the Hadoop FS API)."""
    jvm, p, fs = _hadoop(spark, root)
    if not fs.exists(p):
        return []
    steps = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if name.startswith("step=") and fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "manifest/_SUCCESS")):
            steps.append(int(name.split("=", 1)[1]))
    return sorted(steps)


def latest_step(spark: SparkSession, root: str) -> int | None:
    return max(complete_steps(spark, root), default=None)


def state_base(spark: SparkSession, root: str, step: int) -> tuple[int, list[int]]:
    """(step of the full version that ``step`` builds on, steps of the deltas
    after it up to ``step``)."""
    r = spark.read.schema(KIND).json(f"{root.rstrip('/')}/step={int(step)}/manifest").first()
    return r["base"], [s for s in complete_steps(spark, root) if r["base"] < s <= step]


def state_restore(spark: SparkSession, root: str, step: int | None = None, key: str = "sample_id"):
    """Load (per_sample, global, step) of the given or latest version: of every
    sample the row written last, from the full version and the deltas after it."""
    s = latest_step(spark, root) if step is None else step
    if s is None:
        raise FileNotFoundError(f"no snapshot under {root}")
    top = root.rstrip("/")
    base, deltas = state_base(spark, root, s)
    rows = spark.read.parquet(f"{top}/step={base}/samples")
    names = rows.columns
    if deltas:
        rows = rows.withColumn("_version", F.lit(base))
        for d in deltas:
            rows = rows.unionByName(spark.read.parquet(f"{top}/step={d}/samples").withColumn("_version", F.lit(d)))
        rest = [c for c in names if c != key]
        rows = (rows.groupBy(key).agg(F.max_by(F.struct(*rest), "_version").alias("_r"))
                .select(*[F.col(key) if c == key else F.col(f"_r.{c}").alias(c) for c in names]))
    return rows, spark.read.parquet(f"{top}/step={s}/global"), s
