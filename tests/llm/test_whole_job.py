"""Cases in which an operator once did less than its whole job."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalspark.llm import op03_mixing as op3


def mixed_docs(spark, es=1):
    """Four languages, of which one has next to nothing."""
    rows = [(i, "word " * 10, f"s{i % 2}", ["en", "en", "de", "fr"][i % 4], 0) for i in range(4000)] + [(10_000 + i, "word " * 10, "s0", "es", 0) for i in range(es)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, pos int").repartition(3)


@pytest.mark.parametrize("es", [1, 5])
def test_a_rare_cell_does_not_set_the_size_of_the_sample(spark, es):
    docs = mixed_docs(spark, es)
    out = op3.mix(docs, share=0.5)
    by_lang = {r.lang: (r.t, r.e) for r in out.groupBy("lang").agg(F.sum("_tokens").alias("t"), F.sum(F.col("_tokens") * F.col("_rate")).alias("e")).collect()}
    total = sum(t for t, _ in by_lang.values())
    assert sum(e for _, e in by_lang.values()) == pytest.approx(0.5 * total, rel=1e-4)
    # The rare language gives all it has; the others share the rest as their targets ask.
    assert by_lang["es"][1] == pytest.approx(by_lang["es"][0])
    rest = 0.5 * total - by_lang["es"][0]
    assert all(by_lang[k][1] == pytest.approx(rest * v / 0.9, rel=1e-3) for k, v in (("en", 0.5), ("de", 0.2), ("fr", 0.2)))
    assert 1800 < op3.sample_mixture(docs, share=0.5).count() < 2200
    # The sample follows the input.
    assert out.agg(F.max("_rate")).first()[0] <= 1


def test_rounds_go_on_until_the_sums_agree(spark, caplog):
    cells = spark.createDataFrame([("a", "x", 900.0), ("a", "y", 5.0), ("b", "x", 10.0), ("b", "y", 85.0)], "p string, q string, tokens double")
    half = {d: spark.createDataFrame([(k, 0.5) for k in v], f"{d} string, target double") for d, v in (("p", "ab"), ("q", "xy"))}
    got = op3.calibrate(cells, half, share=0.15).collect()
    assert all(0 < r.rate <= 1 for r in got) and got[0].residual < 1e-5
    for d, v in (("p", "a"), ("p", "b"), ("q", "x"), ("q", "y")):
        assert sum(r.tokens * r.rate for r in got if r[d] == v) == pytest.approx(75.0, rel=1e-4)
    # Half of 1 000 tokens: b and y hold less than their targets. This is reported.
    got = op3.calibrate(cells, half, share=0.5).collect()
    assert sum(r.tokens * r.rate for r in got) == pytest.approx(500.0, rel=1e-4) and got[0].residual > 0.2
    assert "off its target" in caplog.text


def test_categories_without_a_given_target_keep_their_share(spark):
    rows = [(i, "word " * 10, f"s{i // 6 % 2}", ["en", "de", "fr", "es", None, "xx"][i % 6], 0) for i in range(1200)]
    rows += [(5000 + i, None, "s0", "yy", 0) for i in range(40)] + [(6000 + i, " ", "s9", "en", 0) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, pos int").repartition(3)
    out = op3.mix(docs, share=0.3).collect()
    # Six equal languages of which two have no target: a sixth each beside the given 1.0.
    tokens = {k: sum(r._tokens * r._rate for r in out if r.lang == k) for k in ("en", "de", "fr", "es", None, "xx")}
    assert {k: v / sum(tokens.values()) for k, v in tokens.items()} == pytest.approx(
        {k: v / (4 / 3) for k, v in ({None: 1 / 6, "xx": 1 / 6} | op3.LANG_TARGET).items()}, abs=1e-4)
    # Texts without words are drawn like others; only a named 0 drops a category.
    assert all(r._rate > 0 for r in out) and any(r._sampled for r in out if r.lang == "yy") and any(r._sampled for r in out if r.source == "s9")
    out = op3.mix(docs, share=0.3, lang_target=op3.LANG_TARGET | {"xx": 0.0, "yy": 0.0}).collect()
    assert all((r._rate == 0) == (r.lang in ("xx", "yy")) for r in out)


def test_share_of_an_empty_table(spark):
    assert op3.sample_mixture(mixed_docs(spark).limit(0), share=0.5).count() == 0


def brute_rates(rows, targets, share, tolerance=1e-6, max_rounds=100):
    """Rates by bisection: in every round each category's factor is searched for until the category supplies its goal."""
    dims, tokens = list(targets), np.array([float(r["tokens"]) for r in rows])

    def factor(x, t, goal):
        lo, hi = 0.0, 1e120
        for _ in range(900):
            mid = (lo * hi) ** 0.5 if lo > 0 else hi / 1e3
            if t @ np.minimum(1, mid * x) < goal:
                lo = mid
            else:
                hi = mid
            if lo == 0 and hi < 1e-120 or lo > 0 and hi / lo < 1 + 1e-14:
                break
        return hi

    x = np.full(len(rows), share)
    for d in dims:
        x[[targets[d].get(r[d], 0) <= 0 and sum(t for t, q in zip(tokens, rows) if q[d] == r[d]) > 0 for r in rows]] = 0
    amount = min(share * tokens.sum(), tokens[x > 0].sum())
    goals = {}
    for d in dims:
        cap = {}
        for r, t, v in zip(rows, tokens, x):
            if v > 0 and t > 0:
                cap[r[d]] = cap.get(r[d], 0) + t
        want = sum(targets[d][c] for c in cap)
        names = sorted(cap, key=str)
        y, caps = np.array([targets[d][c] / want * amount / cap[c] for c in names]), np.array([cap[c] for c in names])
        f = factor(y, caps, min(amount, caps.sum()) * (1 - 1e-15))
        goals[d] = dict(zip(names, (caps * np.minimum(1, f * y)).tolist()))
    seen = []
    for _ in range(max_rounds):
        for d in dims:
            for c, goal in goals[d].items():
                at = np.array([r[d] == c for r in rows]) & (x > 0)
                x[at] = np.clip(x[at] * factor(x[at], tokens[at], goal * (1 - 1e-15)), 1e-100, 1e100)
        seen.append(max(abs(sum(t * min(1, v) for r, t, v in zip(rows, tokens, x) if r[d] == c) - goal) for d in dims for c, goal in goals[d].items()) / amount)
        if seen[-1] <= tolerance or len(seen) > 5 and seen[-1] > 0.99 * seen[-6]:
            break
    return np.where((tokens > 0) | (x <= 0), np.minimum(1, x), share)


def own_targets(rows, dim, given, power=0.5):
    sums = {}
    for r in rows:
        sums[r[dim]] = sums.get(r[dim], 0) + r["tokens"]
    whole = sum(v ** power for v in sums.values())
    out = {c: given.get(c, v ** power / whole if v else 0) for c, v in sums.items()}
    return {c: v / sum(out.values()) for c, v in out.items()}


@pytest.mark.parametrize("share", [0.1, 0.5])
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_mixing_query_equals_brute_force(spark, sf, share):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    out = op3.mix(docs, share=share).select("doc_id", "text", "_source", "_lang", "_topic", "_tokens", "_rate", "_sampled").collect()
    cells = {}
    for r in out:
        low = (r.text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        assert r._tokens == len(re.findall("[^\x20\x09-\x0d]+", low))
        assert r._topic == next((t for t, marks in op3.TOPICS if any(m in low for m in marks)), "general")
        cells[r._source, r._lang, r._topic] = cells.get((r._source, r._lang, r._topic), 0) + r._tokens
        draw = int(hashlib.md5(f"17:{r.doc_id}".encode()).hexdigest()[:13], 16) / (1 << 52)
        assert r._sampled == (draw < r._rate)
    rows = [dict(zip(op3.DIMS, k), tokens=v) for k, v in cells.items()]
    targets = {"source": own_targets(rows, "source", {}), "lang": own_targets(rows, "lang", op3.LANG_TARGET), "topic": own_targets(rows, "topic", op3.TOPIC_TARGET)}
    want = {tuple(r[d] for d in op3.DIMS): v for r, v in zip(rows, brute_rates(rows, targets, share).tolist())}
    got = {(r._source, r._lang, r._topic): r._rate for r in out}
    assert got == {k: pytest.approx(v, rel=2e-3, abs=1e-6) for k, v in want.items()}
    assert sum(cells[k] * v for k, v in got.items()) == pytest.approx(share * sum(cells.values()), rel=1e-4)


def test_names_of_other_columns_do_not_matter(spark):
    docs = mixed_docs(spark)
    for name in ("_weight", "_tokens", "_rate", "_source", "_cell", "_sampled"):
        other = docs.withColumnRenamed("pos", name)
        kept = op3.sample_mixture(other, share=0.5)
        assert kept.columns == other.columns and kept.where(F.col(name) == 0).count() == kept.count() > 1500
    with pytest.raises(ValueError):
        op3.mix(docs.withColumnRenamed("pos", "_Tokens"))
