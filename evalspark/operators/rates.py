"""Pass-rate aggregations: leaderboards, stratified rates, censuses.

Every aggregation is a ``groupBy`` with algebraic aggregates (sum / count),
so Spark runs a partial aggregate before the shuffle and only one row per
group and map task crosses the network, however skewed a group is.
Labels are handled in long form (one row per row x label), so a report
over millions of task rows is one explode + one aggregate instead of one
pass per label.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalspark.functions.constants import HORIZON_LABELS, RANGE_LABELS, REASON_LABELS, Z95
from evalspark.functions.rates import (
    error_bar, fixed, format_rate, format_rate_short, parse_ratio, rate)
from evalspark.session import cut


def _b(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# A6 + A10 -------------------------------------------------------------------
def leaderboard(df: DataFrame, by: Sequence[str] = ("model", "mode"), passed="passed",
                digits: int = 6, with_totals: bool = False) -> DataFrame:
    """Ratio of sums per group with its 95 % half-width (closed form).

    ``with_totals`` adds the roll-up rows (per leading key, and overall) with
    null in the rolled-up key columns.
    """
    grouped = df.rollup(*by) if with_totals else df.groupBy(*by)
    agg = grouped.agg(
        F.sum(_b(passed).cast("long")).alias("n_pass"),
        F.count(F.lit(1)).alias("n_total"))
    return agg.select(
        *by, "n_pass", "n_total",
        F.round(rate("n_pass", "n_total"), digits).alias("pass_rate"),
        F.round(error_bar("n_pass", "n_total"), digits).alias("err95"))


DRAWS_PER_ROW = 1_000


# A11 ------------------------------------------------------------------------
def bootstrap_error_bar(counts: DataFrame, by: Sequence[str], k="n_pass", n="n_total",
                        reps: int = 10000, seed: int = 7) -> DataFrame:
    """The resampling itself: ``reps`` resamples of n Bernoulli(p) draws per group.

    Draws are generated per (group, rep) with a seeded hash so the result does
    not depend on partitioning; per rep the pass count is a sum over n draws, made in
    rows of at most ``DRAWS_PER_ROW`` draws, so neither a large n nor many resamples
    meet in one row. Work is groups x reps x n, spread over all tasks.
    """
    p = (F.col(k).cast("double") / F.col(n)).alias("p")
    base = counts.filter(F.col(n) > 0).select(*by, F.col(n).alias("n"), p)
    n_parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    reps_df = base.select(*by, "n", "p", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
    rows = reps_df.select(*by, "n", "p", "rep", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1, F.lit(DRAWS_PER_ROW).cast("long"))).alias("at"))
    # spread the rows before the draws: the groups are few
    rows = rows.repartition(n_parts, *by, "rep", "at")

    def hit(acc, i):
        h = F.xxhash64(*[F.col(b) for b in by], F.col("rep"), i, F.lit(seed))
        u = F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(1 << 53))
        return acc + (u < F.col("p")).cast("long")

    last = F.least(F.col("at") + DRAWS_PER_ROW, F.col("n").cast("long")) - 1
    draws = rows.select(*by, "n", "rep", F.aggregate(F.sequence(F.col("at"), last), F.lit(0).cast("long"), hit).alias("k"))
    per_rep = draws.groupBy(*by, "rep", "n").agg(F.sum("k").alias("hits"))
    per_rep = per_rep.select(*by, (F.col("hits") / F.col("n")).alias("r"))
    return per_rep.groupBy(*by).agg(F.avg("r").alias("boot_rate"),
                                   (F.lit(Z95) * F.stddev_pop("r")).alias("boot_err95"))


# long-form labels -----------------------------------------------------------
def max_range_label(freq_map) -> Column:
    """W2: greatest range label over all words of all keys (null when none)."""
    ranks = F.transform(F.map_keys(_b(freq_map)), lambda k: F.array_max(F.transform(
        F.split(k, " "), lambda w: F.when(w == "Short-Range", 1).when(w == "Medium-Range", 2)
        .when(w == "Long-Range", 3).otherwise(0))))
    top = F.array_max(ranks)
    return (F.when(top == 3, F.lit("Long-Range")).when(top == 2, F.lit("Medium-Range"))
            .when(top == 1, F.lit("Short-Range")))


def label_presence(df: DataFrame, freq_map: str, kind: str, keys: Sequence[str],
                   use_max: bool = True, weighted: bool = False) -> DataFrame:
    """One row per (row, label) with the label's weight for the row.

    kind = 'reason': a label is a whole key (weight = its count).
    kind = 'horizon': a label is a word of a key (weight = sum of the counts of
    keys holding it); with ``use_max`` the range labels are replaced by the
    row's greatest range (weight = the whole row's count).
    Boolean form: weight 1 per present label (distinct per row).
    """
    m = F.col(freq_map)
    if kind == "reason":
        ent = df.select(*keys, F.explode(m).alias("label", "freq"))
        if not weighted:
            ent = ent.withColumn("freq", F.lit(1))
        return ent.select(*keys, "label", F.col("freq").cast("long").alias("w"))
    return df.select(*keys, F.inline(horizon_items(m, weighted, use_max)))


def horizon_items(m: Column, weighted: bool = False, use_max: bool = True) -> Column:
    """Row-local ``array<struct<label, w>>`` of the horizon labels present in a
    frequency map: distinct words of all keys (weight = summed counts of the
    keys holding the word, or 1), ranges replaced by the row's greatest range."""
    # distinct words of all keys, each with its weight, built with
    # higher-order functions -- no shuffle to make labels distinct per row.
    ents = F.map_entries(m)
    words = F.array_distinct(F.flatten(F.transform(F.map_keys(m), lambda k: F.split(k, " "))))
    if use_max:
        words = F.filter(words, lambda w: ~w.isin(*RANGE_LABELS))

    def weight(w):
        if not weighted:
            return F.lit(1).cast("long")
        return F.aggregate(ents, F.lit(0).cast("long"), lambda a, e: a + F.when(
            F.array_contains(F.split(e["key"], " "), w), e["value"]).otherwise(0).cast("long"))

    items = F.transform(words, lambda w: F.struct(w.alias("label"), weight(w).alias("w")))
    if use_max:
        total = (F.aggregate(F.map_values(m), F.lit(0).cast("long"), lambda a, x: a + x)
                 if weighted else F.lit(1).cast("long"))
        top = max_range_label(m)
        items = F.concat(items, F.when(top.isNotNull(), F.array(F.struct(top.alias("label"), total.alias("w"))))
                         .otherwise(F.array().cast("array<struct<label:string,w:bigint>>")))
    return items



def label_pass_rate(df: DataFrame, freq_map: str, kind: str, labels: Sequence[str],
                    passed: str = "is_pass", by: Sequence[str] = (), key: str = "doc_id",
                    use_max: bool = True, weighted: bool = False) -> DataFrame:
    """A3 / A4: per label (and optional group) rows holding it and rows passing.

    Labels not present anywhere are still reported, with zero counts, from
    the fixed label list.
    """
    keys = [key, *by, passed]
    pres = label_presence(df.select(*{key, *by, passed, freq_map}), freq_map, kind, keys,
                          use_max=use_max, weighted=weighted)
    pres = pres.filter(F.col("label").isin(list(labels))).select(*by, "label", F.col(passed).alias("_p"), F.col("w").cast("long").alias("w"))
    if not by:
        # every label of the fixed list as a row of weight zero: labels that never
        # occur are reported without a join. (Per group only present labels are
        # listed; the wide reports fill the absent ones.)
        zero = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(x) for x in labels])).alias("label"),
                                               F.lit(False).alias("_p"), F.lit(0).cast("long").alias("w"))
        pres = pres.unionByName(zero)
    return pres.groupBy(*by, "label").agg(
        F.sum(F.when(F.col("_p"), F.col("w")).otherwise(0)).cast("long").alias("n_pass"),
        F.sum("w").cast("long").alias("n_total"))


def stratified_leaderboard(df: DataFrame, by: Sequence[str], freq_map: str, kind: str,
                           labels: Sequence[str], passed: str = "is_pass", key: str = "doc_id",
                           use_max: bool = True, weighted: bool = False,
                           col_prefix: str = "") -> DataFrame:
    """A7: one column per label holding ``p ± e`` text, rows = groups.

    Each row emits its label items plus a zero-weight marker (so every group
    appears even without labels); one aggregate per group computes a
    conditional (k, n) pair per label -- one shuffle, no pivot stage, no join
    back to the group list. A group lacking a label shows ``0.0 ± 0.0``.
    ``key`` is kept for API compatibility (labels are already distinct per row).
    """
    item_t = "array<struct<label:string,w:bigint>>"
    m = F.col(freq_map)
    if kind == "reason":
        items = F.transform(F.map_entries(m), lambda e: F.struct(
            e["key"].alias("label"), (e["value"] if weighted else F.lit(1)).cast("long").alias("w")))
    else:
        items = horizon_items(m, weighted, use_max)
    marker = F.array(F.struct(F.lit("__group__").alias("label"), F.lit(0).cast("long").alias("w")))
    long = df.select(*by, F.col(passed).alias("_p"), F.inline(F.concat(marker.cast(item_t), items.cast(item_t))))
    aggs = []
    for i, lbl in enumerate(labels):
        hit = F.col("label") == lbl
        aggs += [F.sum(F.when(hit & F.col("_p"), F.col("w")).otherwise(0)).cast("long").alias(f"_k{i}"),
                 F.sum(F.when(hit, F.col("w")).otherwise(0)).cast("long").alias(f"_n{i}")]
    g = long.groupBy(*by).agg(*aggs)
    return g.select(*by, *[format_rate_short(f"_k{i}", f"_n{i}").alias(col_prefix + label_col(lbl))
                           for i, lbl in enumerate(labels)])


def label_col(lbl: str) -> str:
    return lbl.lower().replace(" ", "_").replace("-", "_")


def run_summary(df: DataFrame, run_col: str = "run_name", passed: str = "is_pass",
                key: str = "doc_id", reason_map: str = "reason_freq",
                horizon_map: str = "horizon_freq",
                reasons: Sequence[str] = REASON_LABELS,
                horizons: Sequence[str] = HORIZON_LABELS) -> DataFrame:
    """A5: one row per run: overall rate text and one rate text per label.

    One pass: every row emits its items (an overall marker, its reason keys,
    its horizon labels) in a single ``inline``; one aggregate per run holds a
    conditional (k, n) pair per item of the fixed list -- one shuffle.
    """
    from evalspark.functions.rates import parse_run_name
    item_t = "array<struct<label:string,w:bigint>>"
    reason = F.transform(F.map_keys(F.col(reason_map)), lambda k: F.struct(
        F.concat(F.lit("r_"), k).alias("label"), F.lit(1).cast("long").alias("w")))
    horizon = F.transform(horizon_items(F.col(horizon_map)), lambda e: F.struct(
        F.concat(F.lit("h_"), e["label"]).alias("label"), e["w"].alias("w")))
    overall = F.array(F.struct(F.lit("__all__").alias("label"), F.lit(1).cast("long").alias("w")))
    items = F.concat(overall.cast(item_t), reason.cast(item_t), horizon.cast(item_t))
    long = df.select(run_col, F.col(passed).alias("_p"), F.inline(items))
    wanted = ["__all__"] + ["r_" + x for x in reasons] + ["h_" + x for x in horizons]
    long = long.filter(F.col("label").isin(wanted))
    aggs = []
    for i, w in enumerate(wanted):
        hit = F.col("label") == w
        aggs += [F.sum(F.when(hit & F.col("_p"), F.col("w")).when(hit, 0)).cast("long").alias(f"_k{i}"),
                 F.sum(F.when(hit, F.col("w"))).cast("long").alias(f"_n{i}")]
    wide = long.groupBy(run_col).agg(*aggs)
    wide = wide.select(run_col, *[F.when(F.col(f"_n{i}").isNotNull(), format_rate(f"_k{i}", f"_n{i}")).alias(w) for i, w in enumerate(wanted)])
    names = {"__all__": "all_pass", **{"r_" + x: "r_" + label_col(x) for x in reasons},
             **{"h_" + x: "h_" + label_col(x) for x in horizons}}
    p = parse_run_name(run_col)
    return wide.select(run_col, p["model"].alias("model"), p["mode"].alias("mode"), p["task"].alias("task"),
                       p["stamp"].alias("stamp"),
                       *[F.coalesce(F.col(f"`{w}`"), F.lit("N/A")).alias(names[w]) for w in wanted])


# A8 / A9 --------------------------------------------------------------------
def class_pass_rate(df: DataFrame, cls: str, passed: str, order: Sequence[str] | None = None,
                    by: Sequence[str] = ()) -> DataFrame:
    """Rows and passes per class; null class is not counted."""
    out = df.filter(F.col(cls).isNotNull()).groupBy(*by, cls).agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(F.col(passed)).alias("n_pass"))
    out = out.select(*by, cls, "n_total", "n_pass",
                     F.round(rate("n_pass", "n_total"), 6).alias("pass_rate"))
    if order:
        rank = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(cls))
        out = out.withColumn("class_rank", rank.cast("int"))
    return out


# A14 ------------------------------------------------------------------------
def distance_stats(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.round(F.avg(col), 6).alias("mean_dist"),
                               F.round(F.stddev_pop(col), 6).alias("std_dist"),
                               F.count(col).alias("n"))


# A15 ------------------------------------------------------------------------
def histogram(df: DataFrame, col: str, bins: int = 30, subset: str | None = None) -> DataFrame:
    """Equal-width bins from min to max; the max lands in the last bin. Nulls are in none.

    Two partial aggregates over the rows: the ends first, then the bins between them, so nothing but one row
    of ends and the bins crosses a shuffle, however many different values there are."""
    sub = F.col(subset) if subset else F.lit(False)
    rows = df.select(F.col(col).cast("double").alias("x"), sub.alias("s")).filter(F.col("x").isNotNull())
    mm = rows.agg(F.struct(F.min("x").alias("lo"), F.max("x").alias("hi"))).scalar()
    j = rows.withColumn("_mm", mm).select("x", "s", F.col("_mm.lo").alias("lo"), F.col("_mm.hi").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(
        F.least(F.floor((F.col("x") - F.col("lo")) / width), F.lit(bins - 1))).cast("int")
    out = j.groupBy(b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("s").alias("n_subset"),
        F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    return out.select("bin", "n", "n_subset",
                      F.round(F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins, 6).alias("left_edge"))


# A16 ------------------------------------------------------------------------
def group_counts(df: DataFrame, key: Sequence[str] | str) -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))


# A2 -------------------------------------------------------------------------
def rate_check(df: DataFrame, col: str, by: Sequence[str] = ()) -> DataFrame:
    """Non-null total, passed (ratio exactly 1) and percent text."""
    r = parse_ratio(col)
    out = df.groupBy(*by).agg(F.count(r).alias("n_total"), F.count_if(r == 1.0).alias("n_pass"))
    return out.select(*by, "n_total", "n_pass",
                      F.concat(fixed(rate("n_pass", "n_total") * 100, 2), F.lit("%")).alias("pct"))


# A17 ------------------------------------------------------------------------
def outcome_class(col) -> Column:
    c = _b(col)
    return (F.when(c.isNull(), F.lit("missing"))
            .when(c.startswith("Success"), F.lit("success"))
            .when(c.startswith("Failure"), F.lit("wrong_output"))
            .when(c.startswith("Error: Compilation error"), F.lit("compile_error"))
            .when(c.startswith("Error"), F.lit("runtime_error"))
            .when(c.startswith("Timeout"), F.lit("timeout"))
            .otherwise(F.lit("unexpected")))


def outcome_census(df: DataFrame, status: str, by: Sequence[str] = ()) -> DataFrame:
    """Share of each outcome class within each group (window sum over the counts)."""
    cnt = df.groupBy(*by, outcome_class(status).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    return cnt.select(*by, "outcome", "n", F.round(F.col("n") / F.sum("n").over(w), 6).alias("share"))


# A13 ------------------------------------------------------------------------
def category_census(df: DataFrame, category: str, task_type: str, lines: str,
                    types: Sequence[str]) -> DataFrame:
    """Tasks per category and task type (pivot on a fixed list) plus average lines."""
    wide = df.groupBy(category).pivot(task_type, list(types)).agg(F.count(F.lit(1)))
    avg = df.groupBy(category).agg(F.round(F.avg(lines), 6).alias("avg_lines"),
                                   F.count(F.lit(1)).alias("n_tasks"))
    return avg.join(wide, category).select(
        category, "n_tasks", "avg_lines",
        *[F.coalesce(F.col(f"`{t}`"), F.lit(0)).cast("long").alias(f"n_{t}") for t in types])


# P9 -------------------------------------------------------------------------
def drop_constant_columns(wide: DataFrame, marker: str, keep: Sequence[str] = (),
                          drop: Sequence[str] = ()) -> DataFrame:
    """Drop report columns where every value equals ``marker`` (and named ones).

    One aggregate pass computes, per column, whether any value differs; only
    that single row reaches the driver to decide the projection.
    """
    cand = [c for c in wide.columns if c not in keep and c not in drop]
    if not cand:
        return wide.drop(*drop)
    flags = wide.agg(*[F.max((F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(marker)) != marker).cast("int"))
                       .alias(f"c{i}") for i, c in enumerate(cand)]).first()
    kept = [c for i, c in enumerate(cand) if flags[f"c{i}"]]
    return wide.select(*[F.col(f"`{c}`") for c in wide.columns if c in keep or c in kept])


# A18 ------------------------------------------------------------------------
def whitespace_tokens(col) -> Column:
    """Number of whitespace-separated tokens (stand-in for a model tokenizer)."""
    return F.size(F.filter(F.split(F.coalesce(_b(col), F.lit("")), r"\s+"), lambda x: x != ""))


def dialog_tokens(df: DataFrame, key: str, value_cols: Sequence[str], per_message: int = 3,
                  reply_primer: int = 3) -> DataFrame:
    """Per dialog: ``per_message`` per message plus the tokens of every value, plus ``reply_primer``."""
    per_row = F.lit(per_message)
    for c in value_cols:
        per_row = per_row + whitespace_tokens(c)
    return df.groupBy(key).agg((F.sum(per_row) + reply_primer).cast("long").alias("n_tokens"))
