"""Byte-level BPE by the transducer against direct merging and the tokenizer library."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from evalspark.llm import op11_bpe_transducer as op11

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
CODER = op11.coder(RANKS, P.PATTERN, op11.SPACE_CUTS)
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=CODER.ranks, special_tokens={})
HARD = ["", " ", "  a", "a  ", "a\x1c!\x1d b", "\x85\xa0x", "don't 'S it's", "a" * 5000, "ab" * 3000 + "\n\n  \t x", "é" * 500,
        "中文字符" * 50, "👩‍👩‍👧 ‍", "<|endoftext|>", "�\x00\x01", "=" * 300 + "-" * 77, "1234567 ٣٤ ½", "　x y", "ﷺ" * 40]


def ids_of(text, coder=CODER):
    return np.frombuffer(coder.encode(text), "<i4").tolist()


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=200) | st.text("aeinst '\n\x1c1é", max_size=300))
def test_ids_equal_the_library(text):
    assert ids_of(text) == LIBRARY.encode_ordinary(text)
    assert ids_of(text, op11.coder(RANKS, P.PATTERN, None)) == ids_of(text)


@pytest.mark.parametrize("text", HARD)
def test_hard_texts(text):
    assert ids_of(text) == LIBRARY.encode_ordinary(text)


def test_pieces_and_neighbours_against_direct_merging():
    draw = random.Random(3)
    tokens = list(CODER.ranks)
    machine = op11.Transducer(CODER.ranks, max_states=200)  # the tables start anew again and again
    for _ in range(3000):
        piece = b"".join(draw.choice(tokens) for _ in range(draw.randint(1, 6)))
        assert machine.encode(piece) == op11.merge(piece, CODER.ranks)
        a, b = draw.choice(tokens), draw.choice(tokens)
        pair = [CODER.ranks[a], CODER.ranks[b]]
        assert machine._may_follow(*pair) == (op11.merge(a + b, CODER.ranks) == pair)
    assert len(machine.states) <= 201


def test_a_vocabulary_without_unique_prefixes_is_merged_directly():
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"xa": 257, b"xabc": 258, b"bc": 300}
    machine, draw = op11.Transducer(ranks), random.Random(1)
    for _ in range(2000):
        piece = "".join(draw.choice("abcx") for _ in range(draw.randint(1, 12))).encode()
        assert machine.encode(piece) == op11.merge(piece, ranks)


def test_lookahead_is_bounded(monkeypatch):
    monkeypatch.setattr(op11, "FLUSH", 300)
    machine, longest = op11.Transducer(CODER.ranks), max(map(len, CODER.ranks))
    lags, settled = [], machine.settled
    monkeypatch.setattr(machine, "settled", lambda last, state: lags.append(len(last) - settled(last, state)) or len(last) - lags[-1])
    draw = random.Random(4)
    for piece in (b"a" * 20000, ("thenontheir" * 500).encode(), "".join(draw.choice("eainst") for _ in range(20000)).encode()):
        assert machine.encode(piece) == op11.merge(piece, CODER.ranks)
    assert len(lags) > 100 and max(lags) <= 3 * longest


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=60), st.lists(st.integers(1, 9), min_size=1, max_size=20))
def test_streaming_decode(raw, sizes):
    """Ids of arbitrary bytes, fed in arbitrary groups, give what the whole gives."""
    machine = op11.StreamDecoder({i: t for t, i in CODER.ranks.items()})
    keep = op11.StreamDecoder(machine.tokens, errors="keep")
    ids = op11.merge(raw, CODER.ranks)
    out, kept, at, turn = b"", b"", 0, 0
    while at < len(ids):
        some = ids[at:at + sizes[turn % len(sizes)]]
        out, kept, at, turn = out + machine.feed(some), kept + keep.feed(some), at + len(some), turn + 1
        out.decode()  # only whole characters so far
    out, kept = out + machine.finish(), kept + keep.finish()
    assert out.decode() == raw.decode("utf-8", "replace") and kept == raw
    assert machine.invalid == keep.invalid and (machine.invalid == 0) == (raw.decode("utf-8", "ignore").encode() == raw)


def test_tables(spark):
    rows = [(1, None, "k"), (2, "", "k"), (None, "ties", "k"), (3, "ties", "k"), (3, "ties", "k"), (4, "x" * 40000 + " é中" * 3000, None)]
    rows += [(10 + i, t, "k") for i, t in enumerate(HARD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids_ string").withColumnRenamed("ids_", "n_tokens").repartition(3)
    out = op11.digests(docs, RANKS, P.PATTERN).collect()
    assert len(out) == len(rows)
    want = []
    for i, t, _ in rows:
        ids = LIBRARY.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)
    assert op11.digests(docs.limit(0), RANKS, P.PATTERN).count() == 0
    with pytest.raises(ValueError):
        op11.encode(docs, RANKS, P.PATTERN, ids_col="n_tokens")
    kept = op11.decode(op11.encode(docs, RANKS, P.PATTERN), RANKS).collect()
    assert all(r.n_tokens == ("k" if r.doc_id != 4 else None) and bytes(r.decoded).decode() == (r.text or "") for r in kept)


def test_query_on_the_driver_tables(spark):
    from evalspark.llm import queries as q

    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = q.QUERIES["op11_bpe_round_trip"](spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(docs)
    for r in got:
        ids = LIBRARY.encode_ordinary(docs[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((docs[r.doc_id] or "").encode()).hexdigest()
