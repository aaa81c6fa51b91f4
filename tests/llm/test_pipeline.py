import os

import duckdb
import pytest

import corpus_pipeline
from evalspark.llm import op03_mixing as op3, op07_decontaminate as op7, queries
from evalspark.llm.common import read, stored
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def value(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sql(spark, name, sf):
    folder = f"/root/testdata/{sf}"
    con = duckdb.connect()
    for f in os.listdir(folder):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{folder}/{f}')")
    got = queries.QUERIES[name](spark, folder)
    want = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert brute.ordered([tuple(map(value, r)) for r in got.select(*names).collect()]) == brute.ordered([tuple(map(value, r)) for r in want.fetchall()])


def test_mixing_odd_rows(spark):
    rows = [(i, "word " * (i % 5), ["s1", "s2", None][i % 3], ["en", "de", None, "xx"][i % 4], "?") for i in range(200)]
    rows += [(None, None, "s1", "en", "?"), (3, rows[3][1], rows[3][2], rows[3][3], "?"), (500, "long " * 50_000, "s1", "en", "?")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, tokens string").repartition(3)
    out = op3.mix(docs).collect()
    assert len(out) == len(rows) and all(0 <= r._rate <= 1 for r in out)
    assert all(any(r._sampled for r in out if r.lang == v) for v in (None, "xx", "en", "de"))
    assert op3.sample_mixture(docs).columns == docs.columns
    assert op3.mix(docs.limit(0)).count() == 0


def test_pipeline_stages(spark):
    docs = read(spark, SF, "documents")
    columns, before = docs.columns, docs
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stored(stage(spark, before, SF), "test-stage")
        assert after.columns == columns
        assert after.count() == after.join(before, columns, "left_semi").count() <= before.count()
        kept[name] = {r.doc_id for r in after.collect()}
        before = after
    first = kept["simhash near-dedup"]
    texts = {r.doc_id: r.text for r in docs.collect()}
    fp = {i: brute.simhash(texts[i]) for i in kept["quality classifier"]}
    ids = sorted(fp)
    comp = brute.components(len(ids), [(a, b) for a in range(len(ids)) for b in range(a) if bin(fp[ids[a]] ^ fp[ids[b]]).count("1") <= 2])
    assert first == {ids[c] for c in comp.values()}
    items = [tuple(r) for r in read(spark, SF, "benchmark").select("item_id", "text").collect()]
    assert kept["benchmark decontamination"] == {w[0] for w in brute.contamination([(i, texts[i]) for i in sorted(first)], items) if not w[5]}
    index = corpus_pipeline.STAGES[-1][1](spark, before, SF)
    assert {r.doc_id for r in index.collect()} == kept["source mixing"]


def test_pipeline_runs_on_an_empty_table(spark):
    docs = read(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
    assert op7.drop_contaminated(read(spark, SF, "documents"), read(spark, SF, "benchmark").limit(0)).count() == 200


def test_pipeline_stages_on_odd_rows(spark):
    """Null ids and texts, empty and long texts, repeated rows, other columns whose names clash."""
    docs = read(spark, SF, "documents").drop("n_chars")
    odd = spark.createDataFrame([(None, None, "en", "web"), (None, "no id but words", None, None), (90_001, None, "xx", "web"), (90_002, "", "de", None),
                                 (90_003, "long words " * 60_000, "en", "web"), (90_004, "said twice", "en", "web"), (90_004, "said twice", "en", "web")],
                                docs.select("doc_id", "text", "lang", "source").schema)
    docs = docs.select("doc_id", "text", "lang", "source").union(odd)
    from pyspark.sql import functions as F

    for i, name in enumerate(("_tokens", "_weight", "_id", "_kept_id", "_gone", "_quality_score")):
        docs = docs.withColumn(name, F.lit(i))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stored(stage(spark, docs, SF), "odd-stage")
        assert after.columns == columns, name
        rows = after.collect()
        assert rows and all((r._tokens, r._weight, r._id, r._kept_id, r._gone, r._quality_score) == (0, 1, 2, 3, 4, 5) for r in rows), name
        assert sum(r.doc_id == 90_004 for r in rows) in (0, 2), name
        docs = after
    index = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert index.count() == docs.count()
