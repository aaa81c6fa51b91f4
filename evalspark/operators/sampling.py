"""Seeded sampling that does not depend on partitioning.

Every random draw is the MD5 of (row id, draw number, seed) mapped to [0, 1):
the same input gives the same draws on 1 or 1000 executors, in any engine that
has MD5, and a lost executor recomputes exactly the same values (unlike
``rand()`` whose stream depends on partition layout).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalspark.functions.arrays import let
from evalspark.session import cut

_SCALE = float(1 << 52)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def uniform01(*parts, seed: int = 0) -> Column:
    """Deterministic U[0, 1): the first 52 bits of the MD5 of the parts and the seed as
    text, joined by ``:`` (a null part is left out)."""
    text = F.concat_ws(":", *[_c(p).cast("string") for p in parts], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(_SCALE)


def uniform01_sql(*parts: str, seed: int = 0) -> str:
    """The same draw in DuckDB SQL."""
    text = f"concat_ws(':', {', '.join(f'CAST({p} AS VARCHAR)' for p in parts)}, '{seed}')"
    return f"(CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT) / {_SCALE})"


# B19 / B21 ------------------------------------------------------------------
def sample_n(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """n rows chosen by the order of their draws (per-partition top-n, then a merge)."""
    return df.orderBy(uniform01(id_col, seed=seed), id_col).limit(n)


def split(df: DataFrame, id_col: str, frac: float = 0.8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    u = uniform01(id_col, seed=seed)
    return df.filter(u < frac), df.filter(u >= frac)


# B30 ------------------------------------------------------------------------
def uniform(df: DataFrame, id_col: str, lo: float, hi: float, seed: int = 0, out: str = "u") -> DataFrame:
    return df.withColumn(out, F.lit(lo) + uniform01(id_col, seed=seed) * F.lit(hi - lo))


# B31 ------------------------------------------------------------------------
def multinomial(draws: DataFrame, id_col: str, probs: DataFrame, cat: str, p: str, seed: int = 0) -> DataFrame:
    """One categorical draw per row: uniform against the cumulative probabilities
    (a small interval table, looked up row-locally), then counts per category
    with zero fill."""
    w = Window.orderBy(cat).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = probs.agg(F.sum(p)).first()[0]
    # the intervals meet: each begins where the one before ends, and the last ends at 1
    first = Window.orderBy(cat)
    iv = probs.select(cat, (F.sum(p).over(w) / total).alias("_hi"), F.lead(F.lit(1)).over(first).alias("_more")) \
        .select(cat, F.coalesce(F.lag("_hi").over(first), F.lit(0.0)).alias("lo"), F.when(F.col("_more").isNull(), 1.0).otherwise(F.col("_hi")).alias("hi"))
    # the interval table (one row per category) as one scalar array; each draw
    # finds its interval row-locally -- no join
    ivs = iv.agg(F.collect_list(F.struct(F.col(cat).alias("c"), "lo", "hi"))).scalar()
    u = draws.select(id_col, uniform01(id_col, seed=seed).alias("u"), ivs.alias("_ivs"))
    hit = F.try_element_at(F.filter("_ivs", lambda e: (F.col("u") >= e["lo"]) & (F.col("u") < e["hi"])), F.lit(1))["c"]
    counts = u.select(hit.alias(cat)).groupBy(cat).agg(F.count(F.lit(1)).alias("n"))
    return probs.select(cat).join(counts, cat, "left").select(cat, F.coalesce("n", F.lit(0)).alias("n"))


# B32 ------------------------------------------------------------------------
def standard_gamma(id_col: str, shape: float, seed: int, stream: int = 0) -> Column:
    """Gamma(shape, 1): the sum of ``floor(shape)`` unit exponentials, plus, for the
    fractional part d, an independent exponential times a Beta(d, 1 - d) draw (the
    ratio of Johnk's accepted pair). The pair is searched among at most ``JOHNK_TRIES``
    draws; a try is accepted with probability above 3/4, so what is left open after
    all of them, less than one draw in 10 ** 19, takes the last pair."""
    whole, part = int(shape), shape - int(shape)
    out = F.lit(0.0)
    if whole:
        draws = F.transform(F.sequence(F.lit(1), F.lit(whole)), lambda j: -F.log(1.0 - uniform01(id_col, j, F.lit(stream), seed=seed)))
        out = F.aggregate(draws, F.lit(0.0), lambda s, x: s + x)
    if part > 1e-12:
        def pair(j):
            x = F.pow(uniform01(id_col, j, F.lit(stream), F.lit("x"), seed=seed), F.lit(1.0 / part))
            y = F.pow(uniform01(id_col, j, F.lit(stream), F.lit("y"), seed=seed), F.lit(1.0 / (1.0 - part)))
            return let(F.struct((x + y).alias("sum"), x.alias("x")), lambda t: F.struct(
                ((t["sum"] <= 1.0) & (t["sum"] > 0.0)).alias("good"), t["sum"].alias("sum"), t["x"].alias("x")))

        # A try is drawn only while none before it is accepted.
        none = F.struct(F.lit(False).alias("good"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("x"))
        good = F.aggregate(F.sequence(F.lit(1), F.lit(JOHNK_TRIES)), none, lambda found, j: F.when(found["good"], found).otherwise(pair(j)))
        scale = -F.log(1.0 - uniform01(id_col, F.lit(0), F.lit(stream), F.lit("e"), seed=seed))
        out = out + let(good, lambda t: scale * t["x"] / t["sum"])
    return out


JOHNK_TRIES = 32


def gamma(df: DataFrame, id_col: str, shape: float, scale: float = 1.0, seed: int = 0, out: str = "gamma") -> DataFrame:
    """Gamma(shape, scale) for any positive shape."""
    return df.withColumn(out, F.lit(scale) * standard_gamma(id_col, float(shape), seed))


def dirichlet(df: DataFrame, id_col: str, alphas: Sequence[float], seed: int = 0, out: str = "dirichlet") -> DataFrame:
    """Dirichlet: independent gammas, L1-normalised."""
    arr = F.array(*[standard_gamma(id_col, float(a), seed, i) for i, a in enumerate(alphas)])
    tot = F.aggregate("_g", F.lit(0.0), lambda s, x: s + x)
    return df.withColumn("_g", arr).withColumn(out, F.transform("_g", lambda x: x / tot)).drop("_g")


# B33 ------------------------------------------------------------------------
def moments(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(col).alias("mean"), F.stddev_pop(col).alias("std"), F.count(col).alias("n"))


# B34 ------------------------------------------------------------------------
def episode_ends(steps: DataFrame, ep: str, step: str, success: str) -> DataFrame:
    """End of each episode: first success after step 0, else the last step."""
    g = steps.groupBy(ep).agg(
        F.min(F.when(F.col(success) & (F.col(step) > 0), F.col(step))).alias("_first_ok"),
        F.max(step).alias("_last"))
    return g.select(ep, F.coalesce("_first_ok", "_last").alias("end_step"))


def sample_steps(steps: DataFrame, ep: str, step: str, success: str, n: int, seed: int = 0,
                 ep_bucket: int = 1024) -> DataFrame:
    """n draws: an episode with weight end + 1, then a step uniformly in [0, end].

    Integer weights make the draw exact: a position uniform in [0, total) is
    matched to the episode whose cumulative interval holds it. Cumulative
    weights are a two-level running sum over episode-id buckets, the match an
    as-of join over position buckets -- no step sees all episodes in one task.
    """
    from evalspark.operators.spans import asof_previous
    from evalspark.operators.vectors import running_sum
    ends = cut(episode_ends(steps, ep, step, success).withColumn("_w", (F.col("end_step") + 1).cast("long")))
    # running sums two levels deep: the upper one runs over one row per bucket of buckets
    ends = ends.withColumn("_k", F.floor(F.col(ep) / (ep_bucket * ep_bucket)))
    inner = running_sum(ends, "_k", [ep], "_w", F.floor(F.col(ep) / ep_bucket), "_run")
    tops = ends.groupBy("_k").agg(F.sum("_w").alias("_t"))
    over = Window.orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.withColumn("_before", F.coalesce(F.sum("_t").over(over), F.lit(0))).select("_k", "_before")
    cum = inner.join(tops, "_k").withColumn("_lo", (F.col("_run") + F.col("_before") - F.col("_w")).cast("double"))
    total = int(ends.agg(F.sum("_w")).first()[0] or 0)
    spark = steps.sparkSession
    draws = spark.range(n).withColumnRenamed("id", "draw")
    draws = draws.withColumn("_pos", F.floor(uniform01("draw", seed=seed) * F.lit(float(total))) + F.lit(0.5))
    right = cum.select(F.col("_lo").alias("_pos"), F.struct(F.col("_lo"), F.col(ep), F.col("end_step")).alias("_e"))
    width = max(1.0, float(total) / 4096)
    j = asof_previous(draws, right, [], "_pos", "_e", bucket=width, out="_hit")
    pick = F.floor(uniform01("draw", F.lit(1), seed=seed) * (F.col("_hit.end_step") + 1)).cast("int")
    return j.select("draw", F.col(f"_hit.{ep}").alias(ep), F.col("_hit.end_step").alias("end_step"), pick.alias(step))


# B35 ------------------------------------------------------------------------
def relabel_future_goal(steps: DataFrame, ep: str, step: str, state: str, success: str, seed: int = 0) -> DataFrame:
    """Attach the state of a step of the same episode as the goal: the offset is a draw
    from [0, end - step) cut to a whole number, so the step itself may be the goal and
    the end is never passed; steps at or past the end keep no goal."""
    steps = cut(steps)
    ends = episode_ends(steps, ep, step, success)
    s = steps.join(ends, ep)
    span = F.col("end_step") - F.col(step)
    off = F.when(span >= 1, F.floor(uniform01(ep, step, seed=seed) * span).cast("int"))
    s = s.withColumn("_goal_step", F.col(step) + off)
    goal = steps.select(F.col(ep), F.col(step).alias("_goal_step"), F.col(state).alias("goal"))
    return s.join(goal, [ep, "_goal_step"], "left").drop("_goal_step")
