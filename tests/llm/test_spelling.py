"""Spelling variants against comparing every pair of words."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from evalspark.llm import op13_spelling_variants as op13


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + (len(a) == len(b)):] == b[i + 1:]


def brute(counts, ratio=10):
    words, near = sorted(counts), defaultdict(list)
    by_length = defaultdict(list)
    for w in words:
        by_length[len(w)].append(w)
    for w in words:
        near[w] = [v for k in (len(w) - 1, len(w), len(w) + 1) for v in by_length[k] if one_edit(w, v)]
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] and counts[w] > 0 else None
    out = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None)
    return out


def got(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def corpus(docs, slip=31):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % slip == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def table(spark, counts):
    return spark.createDataFrame([(w, n, 1) for w, n in counts.items()], "word string, n long, form int").repartition(3)


@pytest.mark.parametrize("seed", range(3))
def test_random_words(spark, seed):
    draw = random.Random(seed)
    words = {"".join(draw.choice("abé") for _ in range(draw.randint(0, 7))): draw.choice([1, 2, 9, 10, 11, 100, 1000, 12345]) for _ in range(700)}
    assert got(op13.variants(table(spark, words))) == brute(words)


def test_runs_chains_ties_and_long_words(spark):
    long = "x" * 3000 + "".join(random.Random(7).choice("ab") for _ in range(2000))
    words = {"aaaaaaa": 1, "aaaaaa": 10, "aaaaab": 10, "aaaaaaaa": 100, "bbbbbbb": 5, "aaaaaaab": 1000, "aaaaaaabc": 10000, "zebra": 1, "zebr": 10, "zebrb": 10,
             long: 3, long[:2500] + "q" + long[2500:]: 30, long[:-1]: 31, long[1:]: 31, "y" * 20000: 2, "𝒳𝒴": 1, "𝒳𝒵": 10, "𝒳": 10, "": 7, "ÿ": 70}
    out = got(op13.variants(table(spark, words)))
    assert out == brute(words)
    assert out["zebra"][0] == "zebr" and out["aaaaaaa"][1] == "aaaaaaabc" and out["y" * 20000][3] == 0


def test_trie_numbers_across_partitions(spark):
    draw = random.Random(2)
    words = sorted({"".join(draw.choice("ab") for _ in range(draw.randint(1, 9))) for _ in range(600)} | {"a" * 30, "a" * 31})
    df = spark.createDataFrame([(w,) for w in words], "w string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # eight small range partitions
    try:
        rows = {r.w: r.nodes for r in op13.node_numbers(df).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted(rows) == words
    prefix_of, node_of = {}, {}
    for w, nodes in rows.items():
        for depth, node in enumerate(nodes, 1):
            assert prefix_of.setdefault(node, w[:depth]) == w[:depth] and node_of.setdefault(w[:depth], node) == node
    held = Counter(w[:k] for w in words for k in range(1, len(w) + 1))
    assert all(len(rows[w]) >= k for w in words for k in range(1, len(w) + 1) if held[w[:k]] > 1)
    assert len({n >> op13.PART_SHIFT for n in prefix_of}) > 2


def test_corpus_words_and_empty_tables(spark):
    text = "Thinking thinkin THINKING thinkıng élevée ÉLEVÉE×÷ a" + " something" * 200 + " " + "w" * 30000
    rows = [(i, text, "x") for i in range(40)] + [(None, text, "x"), (1, None, "x"), (2, "", None), (3, text, "x"), (3, text, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string").withColumnRenamed("id", "run").repartition(3)
    words = op13.corpus_words(docs, slip=31)
    want = corpus([(i, t) for i, t, _ in rows])
    assert {r.word: r.n for r in words.collect()} == want
    assert got(op13.variants(words)) == brute(want)
    plain = {r.word: r.n for r in op13.corpus_words(docs, min_count=1).collect()}
    assert plain["something"] == 200 * 43 and "élevée×÷" not in plain and plain["ÉlevÉe×÷"] == 43
    assert op13.variants(words.limit(0)).count() == 0
    some = spark.createDataFrame([(None, 5), ("abcdefg", None), ("abcdefh", 50)], "word string, n long")
    assert got(op13.variants(some)) == {"abcdefg": (None, "abcdefg", 0, 1, None), "abcdefh": (None, "abcdefh", 50, 1, None)}


def test_query_on_the_driver_tables(spark):
    from evalspark.llm import queries as q

    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert got(q.QUERIES["op13_spelling_variants_trie"](spark, "/root/testdata/sf0.001")) == brute(corpus(rows))
