"""Mixing sources to target weights by iterative proportional fitting.

Token weights of the (source, language, topic) cells are raked: in every round each
dimension's weights are scaled by target share / current share, one dimension after the
other. Documents are then sampled with the calibrated probability of their cell.
The sample has a given expected size: rates are bounded by 1 inside the
rounds, what a full cell cannot supply is taken from the others of its category, and the
rounds go on until all sums by dimension agree (``calibrate``).

DataFrame functions only; the corpus is aggregated to cells once, and the rounds work on
that table (sums over one dimension; its rows are combinations of categories, not
documents)."""

from __future__ import annotations

import logging
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.llm.common import cut, lower_az, spare

SHARE = 0.5
NONE = "?"  # the category of a null
DIMS = ("source", "lang", "topic")
# Topic by the first of these that the (lower-cased) text holds; else "general".
TOPICS = (("legal", ("license", "licence", "copyright", "warrant")),
          ("contact", ("@", "+1 (")),
          ("secrets", ("token =", "key =", "password")))
LANG_TARGET = {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}
TOPIC_TARGET = {"general": 0.85, "legal": 0.05, "contact": 0.08, "secrets": 0.02}


def n_tokens(text: Column) -> Column:
    """Words between white space; null has none."""
    return F.size(F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def topic_of(text: Column, topics=TOPICS) -> Column:
    """The first topic one of whose marks occurs in the whole text; null text is general."""
    low = lower_az(F.coalesce(text.cast("string"), F.lit("")))
    tests = [(name, reduce(lambda a, b: a | b, [F.contains(low, F.lit(m)) for m in marks])) for name, marks in topics]
    out = F.when(tests[0][1], F.lit(tests[0][0]))
    for name, test in tests[1:]:
        out = out.when(test, F.lit(name))
    return out.otherwise(F.lit("general"))


def tempered(cells: DataFrame, dim: str, power: float = 0.5) -> DataFrame:
    """Targets ``dim``, ``target``: shares of tokens to ``power``, normalised."""
    sums = cells.groupBy(dim).agg(F.sum("tokens").alias("t"))
    total = sums.agg(F.sum(F.pow("t", F.lit(power)))).scalar()
    return sums.withColumn("s", total).select(dim, F.when(F.col("s") > 0, F.pow("t", F.lit(power)) / F.col("s")).otherwise(0.0).alias("target"))


def with_own_shares(cells: DataFrame, dim: str, given: DataFrame, power: float = 0.5) -> DataFrame:
    """Targets ``dim``, ``target`` of every category in ``cells``: the given one (also 0), or its
    tempered share of the tokens if none is given (null if it has none); normalised over all of them."""
    own = tempered(cells, dim, power).select(dim, F.when(F.col("target") > 0, F.col("target")).alias("_own"))
    both = own.join(given, dim, "left").select(dim, F.coalesce("target", "_own").alias("target"))
    total = both.agg(F.sum("target")).scalar()
    return both.withColumn("s", total).select(dim, F.when(F.col("s") > 0, F.col("target") / F.col("s")).otherwise(F.col("target")).alias("target"))


def _full(x: Column, tokens: Column, amount: Column, by: list[Column], tie: list[Column]) -> Column:
    """Whether f * x >= 1, for the factor f of each group with which its sum of
    tokens * min(1, f * x) is ``amount``; found exactly, in the order of x."""
    order = Window.partitionBy(*by).orderBy(x.desc(), *tie)
    upto = F.sum(tokens).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.coalesce(F.sum(tokens * x).over(order.rowsBetween(1, Window.unboundedFollowing)), F.lit(0.0))
    return F.when(x > 0, upto + after / x <= amount).otherwise(False)


def _factor(x: Column, tokens: Column, full: Column, amount: Column, by: list[Column]) -> Column:
    """The factor of each group, given which rows are full; the one that fills all of them if none is left."""
    whole = Window.partitionBy(*by)
    taken = F.sum(F.when(full, tokens).otherwise(0.0)).over(whole)
    free = F.sum(F.when(full, 0.0).otherwise(tokens * x)).over(whole)
    least = F.min(F.when((tokens > 0) & (x > 0), x)).over(whole)
    return F.when(free > 0, (amount - taken) / free).when(least.isNotNull(), F.greatest(1 / least, F.lit(1.0))).otherwise(1.0)


def _common_factor(cats: DataFrame, amount: float) -> float:
    """The factor f with which the sum of cap * min(1, f * y) over all categories is ``amount``. Given f, those with
    f * y >= 1 are full; without them f only grows, so each pass over the categories (two sums) adds full ones
    until none is left to add."""
    f = 1.0
    while True:
        full = F.col("y") * F.lit(f) >= 1
        taken, free = cats.agg(F.sum(F.when(full, F.col("cap"))), F.sum(F.when(full, 0.0).otherwise(F.col("cap") * F.col("y")))).first()
        if not free:  # all give all they have
            least = cats.agg(F.min("y")).first()[0]
            return max(1.0, 1.0 / least) if least else 1.0
        new = (amount - (taken or 0.0)) / free
        if new <= f * (1 + 1e-12):
            return new
        f = new


def _settled(seen: list[float], tolerance: float) -> bool:
    return seen[-1] <= tolerance or len(seen) > 5 and seen[-1] > 0.99 * seen[-6]


def _tell(residual: float, tolerance: float, rounds: int) -> None:
    if residual > max(tolerance, 1e-6):
        logging.getLogger(__name__).warning("mixing: after %d rounds a category's share of the sample is %.6f off its target", rounds, residual)


def calibrate(cells: DataFrame, targets: dict[str, DataFrame], share: float, tolerance: float = 1e-6, max_rounds: int = 100) -> DataFrame:
    """``cells`` with ``rate`` and ``residual``. The sum of tokens * rate is ``share`` of all
    tokens, and its sums by each dimension are the targets as far as the tokens reach:
    categories that hold fewer tokens than their target give all, and the others
    share the rest in proportion to their targets. Rates are the product of one factor per
    category, at most 1. Rounds end when all sums agree to ``tolerance`` (of the sample), when
    five rounds gain less than 1 %, or after ``max_rounds``. ``residual`` is the largest
    distance of a category's share of the sample from its (normalised) target.

    A category with target 0 gets rate 0, and so does one that holds tokens and has no target.
    Other cells without tokens, which weigh nothing, get rate ``share``."""
    if not 0 < share <= 1:
        raise ValueError("share must be above 0 and at most 1")
    now = cells.withColumn("tokens", F.col("tokens").cast("double"))
    for dim, target in targets.items():
        now = now.join(target.select(dim, F.col("target").alias(f"_{dim}")), dim, "left")
    open_ = reduce(lambda a, b: a & b, [F.coalesce(F.col(f"_{d}") > 0, F.sum("tokens").over(Window.partitionBy(d)) == 0) for d in targets])
    now = cut(now.withColumn("x", F.when(open_, F.lit(float(share))).otherwise(0.0)))
    held, total = now.agg(F.sum(F.when(F.col("x") > 0, F.col("tokens"))), F.sum("tokens")).first()
    amount = min(share * (total or 0.0), held or 0.0)
    for dim in targets:
        # What each category is to supply: its target, or all it has.
        cats = (now.where("x > 0 AND tokens > 0").groupBy(dim).agg(F.sum("tokens").alias("cap"), F.first(f"_{dim}").alias("t")))
        cats = cut(cats)
        asked = cats.agg(F.sum("t")).first()[0] or 1.0
        cats = cats.withColumn("_p", F.col("t") / F.lit(asked)).withColumn("y", F.col("_p") * F.lit(amount) / F.col("cap"))
        f = _common_factor(cats, amount)
        goals = cats.select(dim, F.col("_p").alias(f"_p_{dim}"), (F.col("cap") * F.least(F.lit(1.0), F.lit(f) * F.col("y"))).alias(f"_goal_{dim}"))
        now = now.join(goals, dim, "left")
    now = cut(now.drop(*(f"_{d}" for d in targets)))
    x, tokens = F.col("x"), F.col("tokens")
    taken = tokens * F.least(F.lit(1.0), x)
    sums = {d: F.sum(taken).over(Window.partitionBy(d)) for d in targets}
    off = F.greatest(*[F.abs(sums[d] - F.col(f"_goal_{d}")) for d in targets]) / F.lit(amount or 1.0)
    seen = []
    for _ in range(max_rounds if amount > 0 else 0):
        for dim in targets:
            goal, by = F.coalesce(f"_goal_{dim}", F.lit(0.0)), [F.col(dim)]
            now = now.withColumn("full", _full(x, tokens, goal, by, [F.col(d) for d in targets]))
            now = now.withColumn("f", F.when(F.col(f"_goal_{dim}").isNull(), 1.0).otherwise(_factor(x, tokens, F.col("full"), goal, by)))
            # Bounds far outside any rate keep the numbers finite where the targets cannot all be met.
            now = now.withColumn("x", F.when(x > 0, F.least(F.greatest(x * F.col("f"), F.lit(1e-100)), F.lit(1e100))).otherwise(0.0)).drop("full", "f")
        now = cut(now)
        seen.append(now.select(off.alias("off")).agg(F.max("off")).first()[0] or 0.0)
        if _settled(seen, tolerance):
            break
    gaps = F.greatest(*[F.abs(sums[d] / F.lit(amount or 1.0) - F.col(f"_p_{d}")) for d in targets])
    rate = F.when((tokens > 0) | (x <= 0), F.least(F.lit(1.0), x)).otherwise(F.lit(float(share)))
    out = cut(now.withColumn("rate", rate).withColumn("_gap", F.coalesce(gaps, F.lit(0.0))))
    residual = out.agg(F.max("_gap")).first()[0] or 0.0
    _tell(residual, tolerance, len(seen))
    return out.withColumn("residual", F.lit(float(residual))).drop("x", "_gap", *(f"_goal_{d}" for d in targets), *(f"_p_{d}" for d in targets))


def uniform(id_col: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the id (null: the empty text) and seed alone."""
    hexa = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary")), 1, 13)
    return F.conv(hexa, 16, 10).cast("double") / F.lit(float(1 << 52))


def _names(docs: DataFrame | None = None) -> dict[str, str]:
    """Names of the columns ``mix`` adds; with ``docs``, others where it has such a column."""
    return {k: f"_{k}" if docs is None else spare(f"_{k}", docs) for k in ("source", "lang", "topic", "tokens", "weight", "rate", "sampled")}


def _with_cells(docs: DataFrame, text_col: str, source_col: str, lang_col: str, as_: dict) -> DataFrame:
    return docs.withColumns({
        as_["source"]: F.coalesce(F.col(source_col).cast("string"), F.lit(NONE)), as_["lang"]: F.coalesce(F.col(lang_col).cast("string"), F.lit(NONE)),
        as_["topic"]: topic_of(F.col(text_col)), as_["tokens"]: n_tokens(F.col(text_col))})


def rates(cells: DataFrame, lang_target: dict, topic_target: dict, power: float, share: float) -> DataFrame:
    """``cells`` (``source``, ``lang``, ``topic``, ``tokens``) with ``weight`` (the cell's share of the sample), ``rate`` (sampling
    probability) and ``residual``; see ``calibrate``. Categories without a given target have their tempered shares."""
    spark = cells.sparkSession
    given = {d: spark.createDataFrame([(k, float(v)) for k, v in t.items()], f"{d} string, target double")
             for d, t in (("source", {}), ("lang", lang_target), ("topic", topic_target))}
    done = calibrate(cells, {d: with_own_shares(cells, d, given[d], power) for d in DIMS}, share)
    kept = F.col("tokens") * F.col("rate")
    total = done.agg(F.sum(kept)).first()[0] or 0.0
    return done.withColumn("weight", kept / F.lit(total) if total else F.lit(0.0))


def _mixed(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str, lang_target: dict, topic_target: dict,
           power: float, seed: int, share: float, as_: dict) -> DataFrame:
    marked = _with_cells(docs, text_col, source_col, lang_col, as_)
    cells = cut(marked.groupBy(*[F.col(as_[d]).alias(d) for d in DIMS]).agg(F.sum(as_["tokens"]).alias("tokens")))
    table = cut(rates(cells, lang_target, topic_target, power, share).select(F.struct(*DIMS).alias(spare("_cell", marked)),
                F.col("weight").alias(as_["weight"]), F.col("rate").alias(as_["rate"])))
    # Broadcast by its measured size, else joined by a shuffle whose skewed side the runtime splits.
    both = marked.join(table, F.struct(*[F.col(as_[d]).alias(d) for d in DIMS]) == F.col(table.columns[0])).drop(table.columns[0])
    return both.withColumn(as_["sampled"], uniform(F.col(id_col), seed) < F.col(as_["rate"]))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
        lang_target: dict = LANG_TARGET, topic_target: dict = TOPIC_TARGET, power: float = 0.5,
        seed: int = 17, share: float = SHARE) -> DataFrame:
    """``docs`` with ``_source``, ``_lang``, ``_topic``, ``_tokens``, ``_weight``, ``_rate`` and
    ``_sampled``: a document is sampled if its uniform number lies below its cell's rate.

    The sample has the expected ``share`` of all tokens, and its shares by source, language and topic are the
    targets as far as the tokens reach (see ``calibrate``); nothing is repeated. Null source or language is the
    category "?". A category without a given target has its tempered share of the tokens; only a
    given 0 drops one. Texts without words (null ones too) weigh nothing; they have their cell's rate, and
    the rate ``share`` where a cell has no others.
    Repeated ids are sampled together. An empty table gives an empty result. A column of ``docs`` that
    has one of the new names is an error (``sample_mixture`` takes any)."""
    as_ = _names()
    clash = [n for n in as_.values() if n.lower() in {c.lower() for c in docs.columns}]
    if clash:
        raise ValueError(f"there are columns {clash} already")
    return _mixed(docs, id_col, text_col, source_col, lang_col, lang_target, topic_target, power, seed, share, as_)


def sample_mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
                   lang_target: dict = LANG_TARGET, topic_target: dict = TOPIC_TARGET, power: float = 0.5,
                   seed: int = 17, share: float = SHARE) -> DataFrame:
    """The sampled rows of ``docs`` with their own columns, whatever their names; cases as in ``mix``."""
    as_ = _names(docs)
    both = _mixed(docs, id_col, text_col, source_col, lang_col, lang_target, topic_target, power, seed, share, as_)
    return both.where(F.col(as_["sampled"])).select(*[F.col(f"`{c}`") for c in docs.columns])
