"""De-duplication, exact splits and samplers.

Randomness is a hash key: the first 15 hex digits of ``md5('<seed>:<id>')`` as a 60-bit integer.
Results therefore depend on the seed and the ids only — not on partitioning, task order or
retries — so a lost executor recomputes exactly the same sample.

Exact ranks by that key never use a global ``row_number() OVER (ORDER BY key)`` (which runs in
one task).  ``exact_rank`` instead splits the key space into 2^bits buckets: rows are ranked
inside their (group, bucket) partition, and a histogram of bucket sizes (at most groups × 2^bits
rows, independent of the data volume) gives each bucket's offset.  A group holding a third of all
rows is still spread over all buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY_BITS = 60


def hash_key(id_col, seed: int = 42) -> Column:
    """Uniform 60-bit key from ``md5('<seed>:<id>')`` (same value as DuckDB
    ``('0x' || substr(md5(s), 1, 15))::BIGINT``)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    s = F.concat(F.lit(f"{seed}:"), c.cast("string"))
    return F.conv(F.substring(F.md5(s), 1, 15), 16, 10).cast("long")


def unit_uniform(key: Column) -> Column:
    """Map a 60-bit key to u in (0, 1): (k + 0.5) / 2^60."""
    return (key.cast("double") + F.lit(0.5)) / F.lit(float(2 ** KEY_BITS))


def uniform_bucket(key: Column, bits: int = 16) -> Column:
    """Bucket of a uniform 60-bit key: its top ``bits`` bits."""
    return F.shiftright(key, KEY_BITS - bits)


def positive_bucket(x: Column, mantissa_bits: int = 12) -> Column:
    """Order-preserving bucket of a positive double: (binary exponent, top mantissa bits).
    Keys spread over several octaves fall into many buckets; +inf gets the last bucket."""
    e0 = F.floor(F.log2(x))
    e = (F.when(x < F.pow(F.lit(2.0), e0), e0 - 1)
         .when(x >= F.pow(F.lit(2.0), e0 + 1), e0 + 1).otherwise(e0))
    scale = 2 ** mantissa_bits
    m = F.least(F.floor((x / F.pow(F.lit(2.0), e) - 1) * scale), F.lit(scale - 1))
    b = (e + 1100) * scale + F.greatest(m, F.lit(0))
    return F.when(F.isnan(x) | (x == float("inf")), F.lit(2 ** 40)).otherwise(b).cast("long")


def exact_rank(df: DataFrame, order: list[str], bucket: Column, by: list[str] | tuple = (),
               rank_col: str = "rank", with_size: bool = False) -> DataFrame:
    """1-based rank of each row by the ``order`` columns inside each ``by`` group, computed
    without a single-task window.  ``bucket`` must be non-decreasing in ``order`` (see
    ``uniform_bucket`` / ``positive_bucket``).  With ``with_size`` the group size is attached
    as ``group_size``."""
    by = list(by)
    x = df.withColumn("_bucket", bucket)
    local_w = Window.partitionBy(*by, "_bucket").orderBy(*[F.col(c) for c in order])
    x = x.withColumn("_local", F.row_number().over(local_w))
    hist = x.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*by).orderBy("_bucket")
    hist = hist.withColumn(
        "_off", F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    if with_size:
        hist = hist.withColumn("group_size", F.sum("_n").over(Window.partitionBy(*by)))
    hist = hist.drop("_n")
    out = x.join(hist, by + ["_bucket"], "inner")
    out = out.withColumn(rank_col, (F.col("_off") + F.col("_local")).cast("long"))
    return out.drop("_bucket", "_local", "_off")


# ---------------------------------------------------------------- G1, G2: de-duplication

def dedup_first(df: DataFrame, subset: str | list[str], order_col: str) -> DataFrame:
    """G1: keep the first row (smallest ``order_col``) of each group of equal ``subset`` values.

    ``min(struct(order_col, …))`` is an ordinary aggregate, so Spark pre-aggregates map-side: a
    text copied a million times contributes one row per task to the shuffle."""
    keys = [subset] if isinstance(subset, str) else list(subset)
    rest = [c for c in df.columns if c not in keys and c != order_col]
    packed = F.min(F.struct(F.col(order_col), *[F.col(c) for c in rest])).alias("_first")
    agg = df.groupBy(*keys).agg(packed)
    return agg.select(*[F.col(f"_first.{c}").alias(c) for c in [order_col] + rest], *keys) \
              .select(*df.columns)


def dedup_ids(df: DataFrame, id_col: str, order_col: str | None = None) -> DataFrame:
    """One row per id — the first by ``order_col`` (default: the next column), remaining
    columns breaking ties, so the choice is deterministic."""
    if len(df.columns) == 1:
        return df.dropDuplicates([id_col])
    order_col = order_col or [c for c in df.columns if c != id_col][0]
    return dedup_first(df, id_col, order_col)


# ---------------------------------------------------------------- G3, G4: splits

def split_exact(df: DataFrame, id_col: str, test: float | int, train: float | int | None = None,
                seed: int = 42, by: list[str] | tuple = ()) -> DataFrame:
    """Exact-size split by hash rank.  ``test``/``train`` are counts (int) or fractions
    (float).  Fractions: n_test = ceil(f·n) (``by`` empty) or round(f·n) per ``by`` group
    (stratified); train = the rest unless given.  Rows beyond test + train are dropped.
    Adds ``split`` ('test' first by key, then 'train')."""
    x = df.withColumn("_key", hash_key(id_col, seed))
    x = exact_rank(x, ["_key", id_col], uniform_bucket(F.col("_key")), by=by, with_size=True)
    n = F.col("group_size")

    def size(v):
        if v is None:
            return None
        if isinstance(v, float):
            return F.round(n * F.lit(v)) if by else F.ceil(n * F.lit(v) - F.lit(1e-9))
        return F.least(F.lit(v), n)

    n_test = size(test)
    n_train = size(train) if train is not None else n - n_test
    split = (F.when(F.col("rank") <= n_test, F.lit("test"))
             .when(F.col("rank") <= n_test + n_train, F.lit("train")))
    out = x.withColumn("split", split).where(F.col("split").isNotNull())
    return out.drop("_key", "group_size", "rank")


def with_totals(sizes: DataFrame) -> DataFrame:
    """Adds ``_k`` (number of rows) and ``_total`` (sum of ``_size``) from a one-row aggregate."""
    one = sizes.agg(F.count(F.lit(1)).alias("_k"), F.sum("_size").alias("_total")).withColumn("_one", F.lit(1))
    return sizes.withColumn("_one", F.lit(1)).join(F.broadcast(one), "_one").drop("_one")


# ---------------------------------------------------------------- G6: balanced cluster sample

def balanced_sample(df: DataFrame, id_col: str, cluster_col: str, n: int, seed: int = 42) -> DataFrame:
    """N // k rows from each of the k clusters, one more for the first n % k clusters (by id),
    capped at the cluster size; n is clamped to the table size."""
    sizes = df.groupBy(cluster_col).agg(F.count(F.lit(1)).alias("_size"))
    # clusters may be many: their order is an exact rank in buckets of neighbouring ids
    numeric = sizes.schema[cluster_col].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    bucket = F.floor(F.col(cluster_col) / 4096) if numeric else F.substring(F.col(cluster_col).cast("string"), 1, 2)
    ranked_sizes = exact_rank(sizes, [cluster_col], bucket, rank_col="_i").withColumn("_i", F.col("_i") - 1)
    quotas = with_totals(ranked_sizes)
    n_eff = F.least(F.lit(n), F.col("_total"))
    quota = (F.floor(n_eff / F.col("_k")) +
             F.when(F.col("_i") < n_eff % F.col("_k"), 1).otherwise(0))
    quotas = quotas.select(cluster_col, F.least(quota, F.col("_size")).cast("long").alias("_quota"))
    x = df.withColumn("_key", hash_key(id_col, seed))
    ranked = exact_rank(x, ["_key", id_col], uniform_bucket(F.col("_key")), by=[cluster_col])
    out = ranked.join(quotas, cluster_col, "inner")
    return out.where(F.col("rank") <= F.col("_quota")).drop("_key", "_quota")


# ---------------------------------------------------------------- G7: ablation sample

FILTER_MODES = ("above_mean", "below_mean", "above_mean_std", "none")
BUDGETS = ("equal", "direct_proportion")
BIASES = ("uniform", "inverse_prob", "mild_inverse_prob", "confidence_prob")


def _bias_weight(p: Column, bias: str) -> Column:
    # The smoothing constants of the three weighting rules.
    if bias == "inverse_prob":
        return F.lit(1.0) / (p + F.lit(1e-6))
    if bias == "mild_inverse_prob":
        return (F.lit(1.0) - p) + F.lit(1e-5)
    if bias == "confidence_prob":
        return p
    return F.lit(1.0)


def ablation_sample(df: DataFrame, id_col: str, cluster_col: str, prob_col: str, n: int,
                    seed: int = 42, filter_mode: str = "above_mean_std",
                    budget: str = "direct_proportion", bias: str = "uniform") -> DataFrame:
    """Noise (cluster −1) dropped; per-cluster probability filter; per-cluster budget; then a
    weighted sample without replacement inside each cluster.

    Weighted sampling uses the Efraimidis–Spirakis key −ln(u)/w (smallest keys win) with u from
    the hash key; the per-cluster rank comes from ``exact_rank`` with order-preserving buckets of
    the key, so a hot cluster is ranked in many parallel slices."""
    if filter_mode not in FILTER_MODES:
        raise ValueError(f"unknown filter mode {filter_mode!r}")
    if budget not in BUDGETS:
        raise ValueError(f"unknown budget strategy {budget!r}")
    if bias not in BIASES:
        raise ValueError(f"unknown bias {bias!r}")
    x = df.where(F.col(cluster_col) != -1)
    stats = x.groupBy(cluster_col).agg(F.avg(prob_col).alias("_mu"),
                                       F.stddev_pop(prob_col).alias("_sd"))
    x = x.join(stats, cluster_col, "inner")
    p = F.col(prob_col)
    if filter_mode == "above_mean":
        x = x.where(p > F.col("_mu"))
    elif filter_mode == "below_mean":
        x = x.where(p <= F.col("_mu"))
    elif filter_mode == "above_mean_std":
        x = x.where(p > F.col("_mu") - F.col("_sd"))
    sizes = x.groupBy(cluster_col).agg(F.count(F.lit(1)).alias("_size"))
    sizes = with_totals(sizes)
    if budget == "equal":
        b = F.ceil(F.lit(float(n)) / F.col("_k"))
    else:
        b = F.bround(F.col("_size") / F.col("_total") * F.lit(float(n)), 0)
    b = F.greatest(F.least(b, F.col("_size")), F.lit(1)).cast("long")
    sizes = sizes.select(cluster_col, b.alias("_budget"))
    key = hash_key(id_col, seed)
    # zero weight → +inf key: such rows are taken only when nothing else is left
    es = F.coalesce(F.try_divide(-F.log(unit_uniform(key)), _bias_weight(p, bias)), F.lit(float("inf")))
    x = x.withColumn("_es", es).withColumn("_tb", key)
    x = x.join(sizes, cluster_col, "inner")
    ranked = exact_rank(x, ["_es", "_tb", id_col], positive_bucket(F.col("_es")), by=[cluster_col])
    out = ranked.where(F.col("rank") <= F.col("_budget"))
    return out.drop("_mu", "_sd", "_es", "_tb", "_budget")


# ---------------------------------------------------------------- G5, G8: concatenation, set ops

def concat(*dfs: DataFrame) -> DataFrame:
    """Append rows; columns aligned by name, missing ones as NULL."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def id_overlap(a: DataFrame, b: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ids in both, ids only in a, ids only in b) as distinct id tables."""
    ia = a.select(id_col).distinct()
    ib = b.select(id_col).distinct()
    return (ia.join(ib, id_col, "left_semi"), ia.join(ib, id_col, "left_anti"),
            ib.join(ia, id_col, "left_anti"))

