"""Per-key ordering operators: arg-max rows, interval and as-of joins, first
occurrences, runs of consecutive lines.

Skew is the design constraint: one task, model or user may hold a third of
all rows. So:

* arg-max per key is an aggregate (``min`` of an ordered struct), which Spark
  combines map-side before the shuffle -- a hot key costs one row per map task;
* first-occurrence flags are an aggregate joined back (AQE splits a skewed
  join side), not a window over the whole key;
* interval and as-of joins add a time / line *bucket* to the equi-key, so a
  hot key is spread over as many tasks as it has buckets, and the candidate
  pairs of one checkpoint are limited to the buckets its range covers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalspark.session import cut


# W1 -------------------------------------------------------------------------
def max_distance_row(df: DataFrame, keys: Sequence[str], dist: str,
                     tie_order: Sequence[str]) -> DataFrame:
    """Per key keep the whole row with the greatest ``dist``; ties by ``tie_order`` ascending.

    Rows with a null key are dropped first. Implemented as ``min`` over a
    struct (sort key first, payload after): a partial aggregate, skew-proof,
    and deterministic because the sort key is a total order.
    """
    df = df.na.drop(subset=list(keys))
    payload = [c for c in df.columns if c not in keys]
    sort_key = [(-F.col(dist)).alias("_k0")] + [F.col(c).alias(f"_k{i + 1}") for i, c in enumerate(tie_order)]
    best = df.groupBy(*keys).agg(F.min(F.struct(*sort_key, *[F.col(c) for c in payload])).alias("_best"))
    return best.select(*keys, *[F.col("_best")[c].alias(c) for c in payload])


# J6 -------------------------------------------------------------------------
def _dyadic(lo: Column, hi: Column) -> Column:
    """The fewest dyadic intervals that make up the buckets ``lo`` .. ``hi``: structs ``level``, ``node`` (an interval of 2^level buckets
    with number bucket / 2^level). None if ``lo`` > ``hi``; never more than two per level."""
    none = F.array().cast("array<struct<level:int,node:bigint>>")
    item = lambda level, node: F.array(F.struct(level.cast("int").alias("level"), node.cast("bigint").alias("node")))

    def step(acc, level):
        odd = (acc["a"] <= acc["b"]) & (F.pmod(acc["a"], F.lit(2)) == 1)
        a = F.when(odd, acc["a"] + 1).otherwise(acc["a"])
        even = (a <= acc["b"]) & (F.pmod(acc["b"], F.lit(2)) == 0)
        b = F.when(even, acc["b"] - 1).otherwise(acc["b"])
        out = F.concat(acc["out"], F.when(odd, item(level, acc["a"])).otherwise(none), F.when(even, item(level, acc["b"])).otherwise(none))
        done = a > b  # nothing is left: halves of such ends could meet again
        return F.struct(F.when(done, a).otherwise(F.shiftright(a, 1)).alias("a"), F.when(done, b).otherwise(F.shiftright(b, 1)).alias("b"), out.alias("out"))

    start = F.struct(lo.cast("bigint").alias("a"), hi.cast("bigint").alias("b"), none.alias("out"))
    # As many levels as the range has binary digits, so a short range costs a few steps.
    levels = F.sequence(F.lit(0), F.least(F.lit(62), F.ceil(F.log2(F.greatest(hi - lo, F.lit(0)) + 2)).cast("int")))
    return F.aggregate(levels, start, step, lambda acc: acc["out"])


def records_in_range(ckpts: DataFrame, recs: DataFrame, by: Sequence[str], start: str, end: str,
                     pos: str, bucket: float) -> DataFrame:
    """Band join: records whose ``pos`` lies in ``[start, end]`` of a checkpoint with equal ``by``.

    ``pos``, ``start`` and ``end`` must be numeric (cast timestamps to seconds
    first). A range is cut into dyadic intervals of buckets, two per level at most, so one over the whole
    file is a few rows, not one per bucket; a record is in one interval of each level that any range uses. They join on
    ``by`` + interval, and a range's intervals do not overlap, so each matching pair is produced exactly once."""
    cell = lambda c: F.floor(F.col(c) / bucket).cast("long")
    cb = ckpts.withColumn("_d", F.explode(_dyadic(cell(start), cell(end))))
    used = cb.agg(F.collect_set("_d.level")).scalar()  # 63 at most
    rb = recs.withColumn("_b", cell(pos)).withColumn("_l", F.explode(used))
    rb = rb.withColumn("_d", F.struct(F.col("_l").alias("level"), F.expr("shiftright(_b, _l)").alias("node"))).drop("_b", "_l")
    j = cb.join(rb, [*by, "_d"]).filter(F.col(pos).between(F.col(start), F.col(end)))
    return j.drop("_d")


# J7 -------------------------------------------------------------------------
def _latest_before(rows: DataFrame, by: Sequence[str], on: str, values: Sequence[str], bucket: float,
                   carry: bool = True) -> DataFrame:
    """``rows`` with every column of ``values`` replaced by its greatest value among the
    rows of the same ``by`` with a smaller ``on`` (null if there is none). Rows that have
    a value themselves sort after the others of their ``on``: only rows without any are
    asked for theirs.

    Two levels, both parallel over ``by x bucket``: a running ``max`` inside the bucket,
    and the greatest value of the earlier buckets, a running max over one row per
    bucket. ``carry=False`` stays inside the row's bucket. The rows are computed once
    (checkpoint) and read by both levels.
    """
    d = rows.withColumn("_b", F.floor(F.col(on) / bucket).cast("long"))
    if carry:
        d = cut(d)
    has = F.greatest(*[F.col(v).isNotNull() for v in values]) if len(values) > 1 else F.col(values[0]).isNotNull()
    w = Window.partitionBy(*by, "_b").orderBy(F.col(on), has).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = d.withColumns({v: F.max(v).over(w) for v in values})
    if not carry:
        return inner.drop("_b")
    wb = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    marks = d.groupBy(*by, "_b").agg(*[F.max(v).alias(f"_m_{v}") for v in values]) \
        .withColumns({f"_m_{v}": F.max(f"_m_{v}").over(wb) for v in values})
    keys = [F.col(f"x.{c}").eqNullSafe(F.col(f"m.{c}")) for c in by] + [F.col("x._b") == F.col("m._b")]
    cond = keys[0]
    for k in keys[1:]:
        cond = cond & k
    res = inner.alias("x").join(marks.alias("m"), cond, "left")
    return res.select(*[F.coalesce(f"x.{c}", f"_m_{c}").alias(c) if c in values else F.col(f"x.{c}") for c in rows.columns])


def asof_previous(left: DataFrame, right: DataFrame, by: Sequence[str], on: str, value: str,
                  bucket: float, out: str = "prev", carry: bool = True) -> DataFrame:
    """As-of join, strict: for each left row, the greatest right ``value`` with
    right ``on`` < left ``on`` (same ``by``); left rows with none are dropped.

    ``on`` is numeric and ``value`` is ordered like it (usually ``on`` itself
    or a struct starting with it). Both sides go through one two-level running
    maximum as one union; see :func:`_latest_before`. ``carry=False`` keeps the
    match inside the left row's bucket (a scope).
    """
    lcols = left.columns
    l_ = left.withColumns({"_left": F.lit(True), out: F.lit(None).cast(right.schema[value].dataType)})
    r_ = right.select(*[F.col(c) for c in by], F.col(on), F.lit(False).alias("_left"), F.col(value).alias(out))
    u = _latest_before(l_.unionByName(r_, allowMissingColumns=True), by, on, [out], bucket, carry)
    return u.filter(F.col("_left") & F.col(out).isNotNull()).select(*lcols, out)


# J8 -------------------------------------------------------------------------
def attach_distance(rows: DataFrame, distances: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Left equi-join of one distance per key (the first tuple per key after
    de-duplication) onto every row; rows without one get null."""
    d = distances.dropDuplicates(list(keys)).select(*keys, value)
    return rows.join(d, list(keys), "left")


# W8 -------------------------------------------------------------------------
def order_by_class(df: DataFrame, cls: str, order: Sequence[str] = ("Short-Range", "Medium-Range", "Long-Range"),
                   then: Sequence[str] = ()) -> DataFrame:
    """Sort by the class rank (Short < Medium < Long by default), then by ``then``."""
    rank = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(cls))
    return df.orderBy(rank, *then)


# W7 -------------------------------------------------------------------------
def seen_before(df: DataFrame, key: Sequence[str], order: Sequence[str], out: str = "repeated") -> DataFrame:
    """Flag rows whose key already occurred earlier in ``order`` (not the first occurrence)."""
    first = df.groupBy(*key).agg(F.min(F.struct(*[F.col(c) for c in order])).alias("_first"))
    j = df.join(first, list(key))
    return j.withColumn(out, F.struct(*[F.col(c) for c in order]) != F.col("_first")).drop("_first")


# W6 -------------------------------------------------------------------------
def dedupe_records(df: DataFrame, order: str | None = None) -> DataFrame:
    """Drop records equal in every field; optionally sort by ``order``."""
    out = df.dropDuplicates()
    return out.orderBy(order) if order else out


# W3 -------------------------------------------------------------------------
def comment_spans(lines: DataFrame, key: Sequence[str], line_no: str, is_comment: Column) -> DataFrame:
    """Runs of consecutive comment lines -> (first, last) per key (gaps and islands).

    ``line_no - row_number()`` is constant inside a run of consecutive line
    numbers; the window is per key and document, the grouping an aggregate.
    """
    c = lines.filter(is_comment).select(*key, line_no)
    w = Window.partitionBy(*key).orderBy(line_no)
    g = c.withColumn("_g", F.col(line_no) - F.row_number().over(w))
    return g.groupBy(*key, "_g").agg(F.min(line_no).alias("first_line"), F.max(line_no).alias("last_line")) \
        .drop("_g")


# W4 -------------------------------------------------------------------------
def _count(text: Column, marker: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(marker), F.lit("")))) / len(marker)).cast("int")


def block_spans(lines: DataFrame, key: Sequence[str], line_no: str, text: str,
                open_marker: str, close_marker: str) -> DataFrame:
    """Spans between block markers (clean rule), 1-based (first, last) lines.

    Distinct markers (``/*`` ``*/``, ``<!--`` ``-->``): the state after a line
    is decided by the last marker on it (open / closed), carried forward by a
    running ``last(..., ignorenulls)``; a span starts on a line touching a
    block while the state before it was closed, and runs to the closing line
    or the end of the text. A close with no open block is ignored.
    Symmetric markers (``\"\"\"``): every marker toggles; a line with an even,
    non-zero count is a one-line span.
    """
    t = F.col(text)
    w = Window.partitionBy(*key).orderBy(line_no)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if open_marker == close_marker:
        n = _count(t, open_marker)
        m = lines.select(*key, line_no, n.alias("_k"))
        m = m.withColumn("_after", F.sum(F.col("_k") % 2).over(upto) % 2 == 1)
    else:
        lo = F.expr(f"instr(reverse({text}), reverse('{open_marker}'))")
        lc = F.expr(f"instr(reverse({text}), reverse('{close_marker}'))")
        # position from the end: smaller = later on the line
        st = (F.when((lo > 0) & ((lc == 0) | (lo < lc)), F.lit(True))
              .when(lc > 0, F.lit(False)))
        m = lines.select(*key, line_no, st.alias("_st"), (lo > 0).alias("_o"), (lc > 0).alias("_c"))
        m = m.withColumn("_after", F.coalesce(F.last("_st", ignorenulls=True).over(upto), F.lit(False)))
        m = m.withColumn("_k", F.when(F.col("_o") & F.col("_c") & ~F.col("_after"), 2)
                         .when(F.col("_o"), 1).otherwise(0))
    m = m.withColumn("_before", F.coalesce(F.lag("_after").over(w), F.lit(False)))
    touches = F.col("_before") | F.col("_after") | (F.col("_k") > 0)
    m = m.filter(touches)
    start = ~F.col("_before")
    m = m.withColumn("_span", F.sum(start.cast("int")).over(upto))
    return m.groupBy(*key, "_span").agg(F.min(line_no).alias("first_line"),
                                       F.max(line_no).alias("last_line")).drop("_span")


# W5 -------------------------------------------------------------------------
def comment_ends(spans: Sequence[DataFrame], key: Sequence[str]) -> DataFrame:
    """Union of the ends of all comment spans, distinct, sorted per key."""
    parts = [s.select(*key, F.col("last_line").alias("comment_end")) for s in spans]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


# J9 -------------------------------------------------------------------------
def resolve_definition(uses: DataFrame, defs: DataFrame, use_id: str, by: Sequence[str], on: str,
                       scopes: Sequence[float | None], kind: str, priority: Sequence[str], value: str,
                       out: str = "definition", bucket: float | None = None) -> DataFrame:
    """For each use, its defining record: the scopes that enclose the use are searched
    from the innermost outward, and in each the kinds in priority order; the first
    kind with an earlier definition inside the scope gives its latest one; none in any
    scope -> null (undefined).

    ``scopes`` are nested widths: a scope of width ``s`` is the interval
    ``floor(on / s)``, and ``None`` is the whole key. The latest earlier definition of a
    kind lies in a scope if any earlier one of the kind does, so one pass finds it for
    all kinds (a running max each) and all scopes are decided from it: no candidate
    pairs are enumerated, and a hot key is spread over buckets.

    ``value`` must be a struct column of ``defs`` starting with ``on``.
    """
    names = [f"_d{i}" for i in range(len(priority))]
    kind_of = defs.schema[value].dataType
    first = kind_of.fieldNames()[0]
    u_ = uses.withColumns({"_use": F.lit(True), **{n: F.lit(None).cast(kind_of) for n in names}})
    d_ = defs.select(*by, on, F.lit(False).alias("_use"), *[F.when(F.col(kind) == k, F.col(value)).alias(n) for n, k in zip(names, priority)])
    step = bucket or next((s for s in scopes if s), 1.0)
    found = _latest_before(u_.unionByName(d_, allowMissingColumns=True), list(by), on, names, step).filter("_use")
    inside = []
    for s in scopes:
        for n, k in zip(names, priority):
            ok = F.col(n).isNotNull()
            if s is not None:
                ok = ok & (F.floor(F.col(n)[first] / s) == F.floor(F.col(on) / s))
            inside.append((ok, F.col(n), F.lit(k)))
    chosen, chosen_kind = F.when(inside[0][0], inside[0][1]), F.when(inside[0][0], inside[0][2])
    for ok, v, k in inside[1:]:
        chosen, chosen_kind = chosen.when(ok, v), chosen_kind.when(ok, k)
    return found.select(*uses.columns, chosen.alias(out), chosen_kind.alias(f"{out}_kind"))
