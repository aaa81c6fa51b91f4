import math
import random
import re
from collections import Counter

import pytest

from evalspark.llm import op05_quality as op5, op07_decontaminate as op7, op08_pii as op8, queries
from evalspark.llm.common import read
from tests.llm import brute

SF = "/root/testdata/sf0.01"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "?", 2) for i, t in rows], "doc_id long, text string, words string, pos int").repartition(4)


CASES = [(1, "the Quick brown fox jumps; over a lazy DOG again"), (2, None), (3, ""), (1, "the Quick brown fox jumps; over a lazy DOG again"),
         (None, "Ünï x y z the quick Brown fox ünï 9 9 9"), (5, "9 9 9 9"), (6, "lazy dog"), (7, " ".join(f"w{i}" for i in range(3, 29)) + " quick"), (8, "a " * 30_000)]
ITEMS = [(10, "quick brown fox"), (9, "Fox jumps"), (None, "lazy"), (11, "9 9"), (12, "9 9"), (13, None), (14, "!!"), (15, " ".join(f"w{i}" for i in range(30)))]


@pytest.mark.parametrize("max_broadcast", [100_000, 2])
def test_contamination_equals_brute_force(spark, max_broadcast):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = op7.contamination(docs_of(spark, CASES), items, max_broadcast=max_broadcast).drop("text_hash")
    assert brute.ordered(got.collect()) == brute.ordered(brute.contamination(CASES, ITEMS))


def test_contamination_on_table(spark):
    docs, items = (read(spark, SF, t) for t in ("documents", "benchmark"))
    want = brute.contamination([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()])
    got = queries.op7_benchmark_decontamination(spark, SF)
    assert brute.ordered(got.collect()) == brute.ordered(want)
    kept = op7.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and kept.count() == sum(not w[5] for w in want)


def test_contamination_empty_sides_and_spans(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = docs_of(spark, CASES)
    assert op7.contamination(docs.limit(0), items).count() == 0
    assert op7.contamination(docs, items.limit(0)).where("n_hit > 0").count() == 0
    out = {r.doc_id: r.text for r in op7.remove_spans(docs, items).collect()}
    assert out[1] == "the    ; over a  DOG again" and out[2] is None and out[3] == "" and out[8] == "a " * 30_000


def test_personal_data_equals_brute_force(spark):
    rng = random.Random(5)
    parts = ["a", "b.", "@", "@x.y", "1", "23", "4.5.6.7", ".", "+", "+1 ", "-", " ", "é", "\U0001d4b3", "255", "4111 1111 1111 1111", "%", "(5", "\n", "256.1.1.1",
             "000001.2.3.4", "+49 170 1234567"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(25)))) for i in range(1500)]
    rows += [(None, None), (3000, ""), (3000, ""), (3001, "a" * 100_000 + "@x.com " + "1" * 3000 + " x"), (3002, "1 " * 30_000 + "a." * 9000 + "@b" + ".c" * 9000)]
    rows += [tuple(r) for r in read(spark, SF, "documents").select("doc_id", "text").collect()]
    got = op8.report(docs_of(spark, rows), min_docs=10**9)
    want = []
    for i, t in rows:
        spans = brute.base_spans(t)
        text = ",".join(f"{k}:{s}:{e}" for s, _, k, e in spans)
        want.append((i, *(sum(x[2] == k for x in spans) for k in op8.KINDS[:4]), brute.sha(text), text))
    assert brute.ordered(got.collect()) == brute.ordered(want)


def test_terms_that_reveal_an_entity(spark):
    rows = [(i, f"Hello Zorgblatt wrote {['quite', 'very', 'so'][i % 3]} from x.y7@mail.org about {['apples', 'pears', 'plums', 'figs'][i % 4]} today number {i}")
            for i in range(5)]
    rows += [(9 + i, "today number about hello from wrote the rest " + "x" * i) for i in range(60)] + [(100, "here Zorgblatt again"), (101, None)]
    docs = docs_of(spark, rows)
    found = {r.doc_id: r.spans for r in op8.report(docs, min_share=0.8, min_bits=3.0).collect()}
    assert found[100] == "term:5:14" and found[0].startswith("term:6:15,email:") and found[20] == "" and found[101] == ""
    clean = {r.doc_id: r.text for r in op8.sanitise(docs, min_share=0.8, min_bits=3.0).collect()}
    assert clean[100] == "here [term] again" and clean[101] is None and "@" not in clean[1] and clean[20] == dict(rows)[20]
    assert op8.report(docs.limit(0)).count() == 0
    # The same text ten times is one document in the statistics.
    same = docs_of(spark, [(i, rows[0][1]) for i in range(10)])
    assert op8.report(same, min_share=0.5, min_bits=0.0).where("spans LIKE '%term%'").count() == 0


def brute_terms(rows, min_docs=3, min_share=0.9, min_bits=5.0, min_evidence=40.0):
    """All spans by counting words and entities of every different text."""
    low = {t: t.translate(brute.AZ) for _, t in rows if t}
    low.setdefault("", "")
    words, entities = {}, {}
    for t in {t or "" for _, t in rows}:
        base = brute.base_spans(t)
        found = [m for m in re.finditer("[0-9A-Za-z\\x80-\U0010ffff]+", low.get(t, "")) if all(m.end() <= s or m.start() >= e for s, _, _, e in base)]
        words[t], entities[t] = found, {(r, t[s:e].lower()) for s, r, _, e in base}
    n_t, n_v, n_tv = Counter(), Counter(), Counter()
    for t, found in words.items():
        here = {m.group() for m in found}
        n_t.update(here)
        n_v.update(entities[t])
        n_tv.update((w, v) for w in here for v in entities[t])
    terms = set()
    for (w, v), n in n_tv.items():
        bits = math.log2(n * len(words) / (n_t[w] * n_v[v]))
        if n >= min_docs and n >= min_share * n_t[w] and (bits >= min_bits or n * bits >= min_evidence):
            terms.add(w)
    kinds = dict(enumerate(op8.KINDS))
    out = []
    for i, t in rows:
        spans = sorted([(s, r, e) for s, r, _, e in brute.base_spans(t)] + [(m.start(), 4, m.end()) for m in words[t or ""] if m.group() in terms])
        out.append((i, ",".join(f"{kinds[r]}:{s}:{e}" for s, r, e in spans)))
    return out, terms


def term_rows(rng, n=260):
    names = [f"Name{k}" if k % 2 else f"user{k}x" for k in range(14)]
    rows = []
    for i in range(n):
        parts = [rng.choice(["alpha", "beta", "gamma", "Delta", "é", "x", "7"]) for _ in range(rng.randrange(40))]
        if rng.random() < 0.4:
            k = rng.randrange(14)
            parts.insert(rng.randrange(len(parts) + 1), names[k])
            parts += [f"{names[k].lower()}@mail{k}.org", rng.choice(["", "+49 170 1234567", f"10.0.0.{k}"])]
        if rng.random() < 0.35:  # an entity that many documents hold, and a word that goes with it
            parts += ["Zorgblatt", "word " * 40, "info@big.org"]
        rows.append((i, " ".join(parts)))
    return rows + [(900, rows[3][1]), (901, rows[3][1]), (None, rows[5][1]), (902, None), (903, ""), (3, rows[3][1])]


def test_terms_equal_brute_force(spark):
    rows = term_rows(random.Random(8))
    want, terms = brute_terms(rows)
    assert "zorgblatt" in terms and any(re.search("[0-9]", t) for t in terms)
    got = op8.report(docs_of(spark, rows)).select("doc_id", "spans").collect()
    assert brute.ordered(got) == brute.ordered(want)


def test_terms_of_the_driver_table(spark):
    rows = [tuple(r) for r in read(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()]
    got = queries.op8_personal_data(spark, "/root/testdata/sf0.001").select("doc_id", "spans").collect()
    assert brute.ordered(got) == brute.ordered(brute_terms(rows)[0])


def test_a_name_far_from_the_entity_is_found(spark):
    filler = " ".join(f"common{k}" for k in range(30))
    rows = [(i, f"Qwertzius {filler} writes to secret.person@mail.org") for i in range(40)]
    rows = [(i, t + f" {i % 7}") for i, t in rows] + [(100 + i, f"{filler} number {i}") for i in range(600)]
    found = {r.doc_id: r.spans for r in op8.report(docs_of(spark, rows)).collect()}
    assert found[0].startswith("term:0:9,") and "email:" in found[0]
    assert found[300] == ""


def test_many_matches_in_one_text(spark):
    import time

    text = " ".join(f"a{k}@b.org" for k in range(30_000))
    began = time.time()
    r = op8.report(docs_of(spark, [(1, text), (2, "x")])).where("doc_id = 1").first()
    assert r.n_email == 30_000 and r.spans.count(",") == 29_999 and time.time() - began < 60
    clean = op8.sanitise(docs_of(spark, [(1, text)]), remove=True).first().text
    assert clean == " " * 29_999


def test_names_of_other_columns_do_not_matter(spark):
    rows = [(1, "write to a@b.org now"), (2, None), (1, "write to a@b.org now")]
    for name in ("_spans", "_id"):
        docs = spark.createDataFrame([(i, t, 5) for i, t in rows], f"doc_id long, text string, {name} int")
        out = op8.sanitise(docs)
        assert out.columns == docs.columns
        assert brute.ordered(out.collect()) == brute.ordered([(1, "write to [email] now", 5)] * 2 + [(2, None, 5)])
        labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
        assert op5.drop_low_quality(docs.withColumnRenamed(name, "_quality_score"), labels, threshold=0.0).where("_quality_score = 5").count() == 3
        items = spark.createDataFrame(ITEMS, "item_id long, text string")
        for other in ("_gone", "_hits") if name == "_id" else ():
            more = docs.withColumnRenamed(name, other)
            assert op7.drop_contaminated(more, items).where(f"{other} = 5").count() == 3
            assert op7.remove_spans(more, items).columns == more.columns


def test_quality_held_out(spark):
    rows = {r.doc_id: r for r in queries.op5_quality_classifier(spark, SF).collect()}
    labels = {r.doc_id: r.quality for r in read(spark, SF, "labels").collect()}
    held = [(labels[i], r.score) for i, r in rows.items() if r.held_out and i in labels]
    good, bad = [s for q, s in held if q == 1], [s for q, s in held if q == 0]
    assert len(bad) > 5
    assert sum(g > b for g in good for b in bad) / (len(good) * len(bad)) > 0.9
    import zlib
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for i, r in rows.items())


def test_quality_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1), (3, None)], "doc_id long, quality int")
    docs = docs_of(spark, [(1, "good words here"), (2, "BAD!! BAD!!"), (3, None), (None, ""), (4, "x" * 3_000_000), (4, "good")])
    got = op5.score_quality(docs, labels).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (3, None)}) == 1
    assert op5.drop_low_quality(docs, labels).columns == docs.columns
    assert op5.score_quality(docs.limit(0), labels).count() == 0
    assert {r.score for r in op5.score_quality(docs, labels.limit(0)).collect()} == {0.5}


def test_quality_never_learns_from_held_out_rows(spark):
    docs = read(spark, SF, "documents")
    labels = read(spark, SF, "labels")
    from pyspark.sql import functions as F
    turned = labels.withColumn("quality", F.when(op5.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert (op5.fit_quality(docs, labels) == op5.fit_quality(docs, turned)).all()


def test_features_of_blocks_equal_features_of_whole(monkeypatch):
    text = " ".join(f"w{i % 37}!" for i in range(3000))
    whole = op5.features(text, 18)
    monkeypatch.setattr(op5, "BLOCK", 1000)
    parts = op5.features(text, 18)
    assert (whole[0] == parts[0]).all() and abs(whole[1] - parts[1]).max() < 1e-12
