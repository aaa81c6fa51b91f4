import random

import numpy as np
import pytest

from evalspark.llm import op01_repeats as op1, op02_simhash as op2, op09_line_chunks as op9
from evalspark.llm.common import read
from tests.llm import brute

SF = "/root/testdata/sf0.001"
ODD = [(900, None), (901, ""), (None, "no id at all " * 9), (None, "no id at all " * 9), (902, "q" * 700)]


def texts(rng, n=90):
    words = ["ab", "ba", "c", "dd ", "é", "x1"]
    passages = ["".join(rng.choice(words) for _ in range(40)) for _ in range(5)]
    rows = []
    for i in range(n):
        parts = [rng.choice(["".join(rng.choice(words) for _ in range(rng.randrange(1, 30))), rng.choice(passages), "zz" * rng.randrange(20)])
                 for _ in range(rng.randrange(8))]
        rows.append((i, "".join(parts)))
    return rows + [(500, rows[3][1]), (501, rows[5][1]), (rows[7][0], rows[7][1])] + ODD


def clashing(spark, rows):
    """The rows with columns named like the operators' own."""
    return spark.createDataFrame([(i, t, "?", 1) for i, t in rows], "doc_id long, text string, h string, id int").repartition(5)


@pytest.mark.parametrize("small_group", [500, 1])
def test_repeated_windows_equal_brute_force(spark, monkeypatch, small_group):
    monkeypatch.setattr(op1, "SMALL_GROUP", small_group)
    rows = texts(random.Random(2))
    got = op1.remove_repeats(clashing(spark, rows), length=30, digit=9)
    assert brute.ordered(got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()) == brute.ordered(brute.repeats(rows, 30))


def test_repeated_windows_kept_bytes_and_empty_table(spark):
    rows = [(1, "x" * 10 + "abcdefgh" * 5), (2, "abcdefgh" * 5 + "y" * 9)]
    got = op1.remove_repeats(clashing(spark, rows), length=20, digit=6, with_kept=True)
    assert {r.doc_id: bytes(r.kept) for r in got.collect()} == {1: b"x" * 10, 2: b"y" * 9}
    assert op1.remove_repeats(clashing(spark, rows).limit(0)).count() == 0


def test_long_text_in_pieces(monkeypatch):
    rng = random.Random(4)
    raw = bytes(rng.choice(b"abc ") for _ in range(5000))
    raw = np.frombuffer(raw + raw[1000:3000], np.uint8)
    offs = np.array([0, len(raw)])

    def windows(piece, block):
        monkeypatch.setattr(op1, "PIECE", piece)
        monkeypatch.setattr(op1, "BLOCK", block)
        out = set()
        for i, j, x, y in op1.pieces(offs, 50):
            _, s, n, _, _, _ = op1.runs_of(raw[x:y], np.array([0, y - x]), 50, 12)
            for a, k in zip(s, n):
                out |= set(range(x + a, x + a + k + 1))
        return out

    assert windows(700, 300) == windows(1 << 20, 1 << 20) == set(range(len(raw) - 49))


def test_forest_links_what_brute_force_links():
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(20)]
    fps = sorted({b ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(4))}) for b in base for _ in range(14)} | {(1 << k) - 1 for k in range(9)})
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 2]
    links = op2.forest(np.array(fps, np.uint64), np.zeros(len(fps), int), 2)
    assert brute.components(len(fps), links) == brute.components(len(fps), pairs)
    assert len(links) < len(fps)


def test_every_close_pair_shares_a_bucket():
    rng, masks = random.Random(3), op2.block_masks(2, 6)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
        assert any(a & m == b & m for m in masks)


def test_near_duplicates_equal_brute_force(spark):
    rows = [tuple(r) for r in read(spark, SF, "documents").select("doc_id", "text").collect()]
    t = rows[4][1].split()
    rows += [(1000, " ".join(t[:-1])), (1001, " ".join(t).upper()), (1002, None), (1003, "\t \n"), (1004, "one two"), (None, rows[9][1]), (1001, rows[2][1])]
    got = op2.near_duplicates(clashing(spark, rows)).collect()
    fp = [brute.simhash(x) for _, x in rows]
    links = [(i, j) for i in range(len(fp)) for j in range(i) if bin(fp[i] ^ fp[j]).count("1") <= 2]
    comp = brute.components(len(fp), links)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[comp[i]] = min(d, least.get(comp[i], d))
    assert brute.ordered(got) == brute.ordered([(d, f"{fp[i]:016x}", least.get(comp[i])) for i, (d, _) in enumerate(rows)])
    kept = op2.drop_near_duplicates(clashing(spark, rows))
    assert kept.columns == ["doc_id", "text", "h", "id"]
    assert {r.doc_id for r in kept.collect()} == {least[c] for c in comp.values() if c in least}
    assert op2.near_duplicates(clashing(spark, rows).limit(0)).count() == 0


def chunks_of(lines):
    """Lists of line numbers, by walking the lines."""
    import hashlib

    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    r = [((h[i - 1] if i else 0) * 1_000_003 + h[i]) % (2 ** 31 - 1) for i in range(len(h))]
    out, now, offset = [], [], 0
    for i in range(len(lines)):
        offset = offset + 1 if i and h[i] == h[i - 1] else 0
        now.append(i)
        low = 0 < i < len(h) - 1 and r[i] < r[i - 1] and r[i] <= r[i + 1] and h[i] not in (h[i - 1], h[i + 1]) and not (i > 1 and h[i - 1] == h[i - 2])
        if i == len(lines) - 1 or i <= len(lines) - 3 and (offset % 2 == 1 or low):
            out.append(now)
            now = []
    return out


def chunks_removed(rows):
    docs = sorted({(i, t) for i, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0))
    lines = {key: (key[1] or "").split("\n") for key in docs}
    first, gone, count = {}, {key: set() for key in docs}, dict.fromkeys(docs, 0)
    for key in docs:
        chunks = chunks_of(lines[key])
        assert all(len(c) > 1 for c in chunks) or len(lines[key]) == 1
        for j, c in enumerate(chunks):
            body = "\n".join(lines[key][k] for k in c)
            if len(c) < 2 or not body.strip():
                continue
            if body not in first:
                first[body] = (key, chunks, j)
                continue
            key0, chunks0, j0 = first[body]
            gone[key] |= set(c)
            count[key] += 1
            for step in (-1, 1):  # over equal lines, up to the ends of the two neighbouring chunks
                a, b = ([k for m in sorted([at + step, at + 2 * step]) if 0 <= m < len(some) for k in some[m]] for at, some in ((j, chunks), (j0, chunks0)))
                for x, y in zip(a[::step], b[::step]):
                    if lines[key][x] != lines[key0][y]:
                        break
                    gone[key].add(x)
    return [(i, len(lines[i, t]), len(gone[i, t]), count[i, t], "\n".join(x for k, x in enumerate(lines[i, t]) if k not in gone[i, t])) for i, t in rows]


def test_line_chunks_equal_brute_force(spark):
    rng = random.Random(6)
    block = [f"line {i}" for i in range(40)]
    rows = [(i, "\n".join(rng.choice([f"own {i} {k}", "", *block]) if rng.random() < 0.4 else "\n".join(block[a:a + 9]) for k, a in
                          enumerate(rng.randrange(30) for _ in range(rng.randrange(1, 9))))) for i in range(40)]
    rows += [(50 + i, "\n".join(rng.choice("ab") for _ in range(rng.randrange(30)))) for i in range(30)]
    rows += [(100, None), (101, ""), (102, "\n\n\n"), (3, rows[3][1]), (None, rows[4][1]), (110, rows[5][1])]
    rows += [(120, "\n".join(f"long {k % 5000}" for k in range(20_000))), (121, "same\n" * 20_000)]
    got = op9.remove_repeated_chunks(clashing(spark, rows))
    assert brute.ordered(got.collect()) == brute.ordered(chunks_removed(rows))
    assert op9.remove_repeated_chunks(clashing(spark, rows).limit(0)).count() == 0


def test_line_chunks_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(op9, "BROADCAST_HASHES", 0)
    rows = [(i, "\n".join(f"l{k}" for k in range(i % 3, 30))) for i in range(6)]
    assert brute.ordered(op9.remove_repeated_chunks(clashing(spark, rows)).collect()) == brute.ordered(chunks_removed(rows))


def test_runs_copies_and_short_passages(spark):
    passage = [f"passage {k}" for k in range(9)]
    rows = [(1, "head one\n" + "L\n" * 12 + "tail one"), (2, "head two\n" + "L\n" * 12 + "tail two"),
            (3, "\n".join(f"own {k}" for k in range(7))), (4, "\n".join(f"own {k}" for k in range(7))),
            (5, "\n".join([*(f"x{k}" for k in range(6)), *passage, "end"])), (6, "\n".join(["y", *passage, *(f"z{k}" for k in range(5))]))]
    out = {r.doc_id: r.kept for r in op9.remove_repeated_chunks(clashing(spark, rows)).collect()}
    assert out[1].startswith("head one\nL\nL") and out[1].endswith("tail one") and out[1].count("L") <= 4
    assert out[2] == "head two\ntail two"  # the run is gone, whatever stands around it
    assert out[3] == rows[2][1] and out[4] == ""  # every line of a copy
    assert out[5] == rows[4][1] and out[6] == "\n".join(["y", *(f"z{k}" for k in range(5))])  # the whole passage, over the edges of its chunks


def test_no_removed_line_is_lost(spark):
    """Every line that is removed somewhere stays somewhere."""
    rng = random.Random(9)
    rows = [(i, "\n".join(str(rng.randrange(6)) for _ in range(rng.randrange(1, 60)))) for i in range(80)]
    out = op9.remove_repeated_chunks(clashing(spark, rows)).collect()
    kept = {x for r in out for x in r.kept.split("\n")}
    assert {x for _, t in rows for x in t.split("\n")} <= kept and sum(r.n_removed for r in out) > 500
