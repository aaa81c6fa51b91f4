import random
import struct
import zlib

import numpy as np
import pytest

from evalspark.llm import op04_warc as op4, op06_iblt as op6, op10_token_files as op10, queries
from evalspark.llm.common import read
from tests.llm import brute

tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
FILE = tokenizers.path("byte_bpe_50k.json")


def test_warc_round_trip(spark):
    rows = [(i, f"http://x.org/{i}", "p" * (i % 4) * 60) for i in range(40)]
    rows += [(50, None, None), (51, "a\r\nb: c", ""), (None, "http://n", "p" * 120), (7, "http://x.org/again", "p" * 180), (60, "u", "é" * 50), (61, "u", "é" * 50), (62, "u", "z" * 3_000_000)]
    pages = spark.createDataFrame([(*r, "?") for r in rows], "page_id long, url string, html string, _first string").repartition(3)
    got = op4.warc_round_trip(pages)
    first = {}
    for i, _, t in rows:
        if t is not None and len(t.encode()) >= 100 and i is not None:
            first[t] = min(i, first.get(t, i))
    want = []
    for i, _, t in rows:
        raw = (t or "").encode()
        refers = first.get(t) if len(raw) >= 100 and i != first.get(t) else None
        want.append((i, len(raw), brute.sha(raw), "response" if refers is None else "revisit", refers))
    assert brute.ordered(got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()) == brute.ordered(want)
    assert op4.warc_round_trip(pages.limit(0)).count() == 0


def test_warc_payloads_come_back(spark, tmp_path):
    pages = read(spark, SF, "pages")
    op4.write_warc(pages, f"file://{tmp_path}/w")
    got = {r.page_id: bytes(r.payload) for r in op4.read_warc(spark, f"file://{tmp_path}/w", with_payload=True).where("record_type = 'response'").collect()}
    assert got and all(got[r.page_id] == r.html.encode() for r in pages.collect() if r.page_id in got)


def archive(records, dictionary=True):
    import io

    import zstandard
    d = op4.dictionary_for([b"WARC/1.1 text and more text " * 20] * 4) if dictionary else None
    out = io.BytesIO()
    if d is not None:
        out.write(struct.pack("<II", op4.SKIPPABLE, len(d.as_bytes())) + d.as_bytes())
    c = zstandard.ZstdCompressor(dict_data=d)
    for r in records:
        out.write(c.compress(r))
    return io.BytesIO(out.getvalue())


@pytest.mark.parametrize("dictionary", [True, False])
@pytest.mark.parametrize("block", [7, 1 << 15])
def test_one_frame_per_record(dictionary, block):
    records = [op4.record_bytes(i, "u", b"x" * i * 100, brute.sha(b"x" * i * 100), None, "2024-01-01T00:00:00Z") for i in range(9)]
    assert list(op4.read_records(archive(records, dictionary), block)) == records
    cut = archive(records, dictionary)
    cut.truncate(len(cut.getvalue()) - 5)
    with pytest.raises(ValueError):
        list(op4.read_records(cut, block))


def test_bad_records_raise():
    good = op4.record_bytes(1, "u", b"payload", brute.sha(b"payload"), None, "2024-01-01T00:00:00Z")
    assert op4.parse_record(good)["payload"] == b"payload"
    for bad in (good[:-1], good.replace(b"payload", b"paylord"), good.replace(b"WARC/1.1", b"WARC/9.9"), good.replace(b"WARC-Date", b"X-Date"),
                good.replace(b"Content-Length: 7", b"Content-Length: 8"), b""):
        with pytest.raises(ValueError):
            op4.parse_record(bad)


def test_sketch_recovers_differences_and_grows():
    rng = random.Random(8)
    for na, nb, common in ((0, 0, 0), (1, 0, 0), (5, 9, 40), (300, 200, 100), (0, 700, 3)):
        keys = np.array(rng.sample(range(1 << 62), na + nb + common), dtype=np.uint64)
        a, b = np.concatenate([keys[:na], keys[na + nb:]]), keys[na:]
        only_a, only_b = op6.differing(a, b)
        assert set(only_a) == set(keys[:na]) and set(only_b) == set(keys[na:na + nb])


def test_paragraphs_lose_nothing():
    rng = random.Random(1)
    for _ in range(300):
        t = "".join(rng.choice(["a", "bc ", ".", "\n", "! ", "é", "?", "x" * 50]) for _ in range(rng.randrange(60)))
        assert b"".join(op6.PARAGRAPH.findall(t.encode())) == t.encode()


def expected_fingerprints(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[:len(t) - half] + nxt[:half]
        a, b, c = (set(op6.digests(x).tolist()) for x in (t, edited, nxt))

        def like(x, y):
            return len(x & y) / len(x | y) if x | y else 1.0
        out.append((i, len(t), brute.sha(edited), round(like(a, b), 9), round(like(a, c), 9)))
    return out


def test_fingerprints_equal_exact_sets(spark):
    rows = [tuple(r) for r in read(spark, SF, "documents").select("doc_id", "text").collect()]
    rows += [(None, "null id. x"), (None, "another"), (1000, None), (1001, ""), (1001, "tie"), (-5, "𝒳é. " * 30), (10**15, "far away. " * 9), (10**15, "far away. " * 9)]
    docs = spark.createDataFrame([(*r, "?") for r in rows], "doc_id long, text string, bucket string").repartition(6)
    got = op6.fingerprints(docs).collect()
    assert brute.ordered([(r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got]) == brute.ordered(expected_fingerprints(rows))
    by_text = {}
    for r in got:
        if (r.doc_id, r.n_chars) == (10**15, 90):
            by_text.setdefault("far", set()).add(r.fingerprint)
    assert len(by_text["far"]) == 1
    one = op6.fingerprints(docs.where("doc_id = -5")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert op6.fingerprints(docs.limit(0)).count() == 0


def test_encoder_equals_tokenizer():
    from tokenizers import Tokenizer
    enc, whole = op10.Encoder(FILE), Tokenizer.from_file(FILE)
    rng = random.Random(3)
    parts = ["a", "b", " ", "  ", "\n", "\t", "it's", "é", "1", "!", "...", " \n", "<|endoftext|>", "漢", "\r\n", "'s", "\x1c", "\x85", "​", "ſ", "²", " ", "é", "𝒳"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert np.frombuffer(enc.encode(t), enc.dtype).tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)


def test_token_files(spark, tmp_path):
    from tokenizers import Tokenizer
    rows = [tuple(r) for r in read(spark, SF, "documents").select("doc_id", "text").collect()]
    rows += [(None, "no id"), (5000, None), (5001, ""), (5001, "tie tie"), (-3, "first <|endoftext|> of all"), (5002, "word " * 20_000)]
    docs = spark.createDataFrame([(*r, "?") for r in rows], "doc_id long, text string, start string").repartition(6)
    got = op10.token_files(docs, FILE, folder=f"file://{tmp_path}/t").collect()
    t = Tokenizer.from_file(FILE)
    ids = [(i, [*t.encode(x or "", add_special_tokens=False).ids, 0]) for i, x in rows]
    assert brute.ordered([(r.doc_id, r.n_tokens, r.ids_crc32) for r in got]) == brute.ordered([(i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids])
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    assert op10.token_files(docs.limit(0), FILE).count() == 0


def test_registered_queries_run(spark):
    assert queries.op10_token_files_index(spark, SF).count() == queries.op6_document_fingerprints(spark, SF).count() == 200


def foreign(kind, block, extra=(), content="application/warc-fields"):
    head = ["WARC/1.0", f"WARC-Type: {kind}", "WARC-Record-ID: <urn:x:1>", "WARC-Date: 2020-01-01T00:00:00Z", f"Content-Type: {content}", *extra, f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def sha1(data):
    import base64
    import hashlib
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


FOREIGN = [foreign("warcinfo", b"software: other\r\n"),
           foreign("request", b"GET / HTTP/1.1\r\nHost: x\r\n\r\n", ["WARC-Target-URI: http://x/"], "application/http; msgtype=request"),
           foreign("response", b"HTTP/1.1 200 OK\r\nX: y\r\n\r\nbody of it", ["WARC-Target-URI: http://x/", "WARC-Payload-Digest: " + sha1(b"body of it")], "application/http; msgtype=response"),
           foreign("response", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\nContent-Length: 3\r\n\r\n5\r\nhello\r\n0\r\n\r\n", (), "application/http"),
           foreign("metadata", b"via: http://y/\r\n", ["X-Long: first", "  and more"]), foreign("conversion", "é text".encode(), (), "text/plain"),
           foreign("revisit", b"HTTP/1.1 304 Not Modified\r\nContent-Length: 77\r\n\r\n", ["WARC-Refers-To-Target-URI: http://x/"], "application/http"),
           foreign("resource", b"", (), "image/png"), foreign("own-kind", b"\x00\x01")]


def test_records_of_other_writers():
    got = [op4.parse_record(r) for r in FOREIGN]
    assert [r["headers"]["warc-type"] for r in got][:3] == ["warcinfo", "request", "response"]
    assert got[2]["payload"] == b"body of it" and got[3]["payload"].startswith(b"5\r\n") and got[6]["payload_bytes"] == 77 and got[8]["payload"] == b"\x00\x01"
    assert got[4]["headers"]["x-long"] == "first and more"
    for bad in (FOREIGN[2].replace(b"body of it", b"body of me"), foreign("response", b"HTTP/1.1 200 OK\r\nContent-Length: 9\r\n\r\nshort", (), "application/http"),
                foreign("revisit", b""), foreign("response", b"no message", (), "application/http"), foreign("warcinfo", b"x", ["no colon"]), FOREIGN[0][:-2]):
        with pytest.raises(ValueError):
            op4.parse_record(bad)


def test_archives_of_other_writers(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "one.warc.zst").write_bytes(archive(FOREIGN).getvalue())
    (tmp_path / "sub" / "two.warc.zst").write_bytes(archive(FOREIGN[:2], dictionary=False).getvalue())
    (tmp_path / "empty.warc.zst").write_bytes(b"")
    (tmp_path / "other.txt").write_bytes(b"no archive")
    folder = f"file://{tmp_path}"
    rows = op4.read_archives(spark, folder).collect()
    assert sorted((r.archive.rsplit("/", 1)[1], r.record_no, r.record_type) for r in rows) == sorted(
        [("one.warc.zst", i, op4.parse_record(f)["headers"]["warc-type"]) for i, f in enumerate(FOREIGN)] + [("two.warc.zst", 0, "warcinfo"), ("two.warc.zst", 1, "request")])
    assert all(r.error is None for r in rows) and {bytes(r.payload) for r in rows if r.record_type == "conversion"} == {"é text".encode()}
    broken = FOREIGN[2].replace(b"body of it", b"body of me")
    (tmp_path / "three.warc.zst").write_bytes(archive([FOREIGN[0], broken, FOREIGN[5]]).getvalue()[:-3])
    marked = [(r.record_no, r.error is None) for r in op4.read_archives(spark, folder, on_error="mark").where("archive LIKE '%three%'").orderBy("record_no").collect()]
    assert marked == [(0, True), (1, False), (2, False)]
    with pytest.raises(Exception, match="three"):
        op4.read_archives(spark, folder).count()
    (tmp_path / "none").mkdir()
    assert op4.read_archives(spark, f"{folder}/none").count() == 0


def test_own_archives_by_the_general_reader(spark, tmp_path):
    pages = read(spark, SF, "pages")
    op4.write_warc(pages, f"file://{tmp_path}/w")
    for file in (tmp_path / "w").glob("*.warc.zst"):  # the bytes on disk are the frames themselves
        records = list(op4.read_records(open(file, "rb")))
        assert all(r.startswith(b"WARC/1.1\r\n") for r in records) and records
    got = op4.read_archives(spark, f"file://{tmp_path}/w").collect()
    assert len(got) == pages.count() and {r.record_type for r in got} <= {"response", "revisit"}
    assert {r.payload_digest for r in got} == {brute.sha(r.html or "") for r in pages.collect()}


def test_versions_and_published_fingerprints(spark):
    rng = random.Random(11)
    old = [(i, " ".join(f"Sentence {rng.randrange(50)} of {i}." for _ in range(rng.randrange(0, 60)))) for i in range(60)]
    new = [(i, t + (" More here." if i % 3 else "") if i % 5 else t[len(t) // 2:]) for i, t in old if i != 7] + [(900, "Only new.")]
    old += [(None, "A. B. C."), (901, None), (902, "x. " * 30_000), (3, "~ a larger text of a repeated id")]
    new += [(None, "A. B. D."), (902, "x. " * 30_000 + "End.")]
    a = spark.createDataFrame([(*r, 1) for r in old], "doc_id long, text string, added int").repartition(3)
    b = spark.createDataFrame([(*r, 1) for r in new], "doc_id long, text string, added int").repartition(4)
    got = {r.doc_id: r for r in op6.changed_paragraphs(a, b).collect()}
    first = lambda rows: {i: min(t or "" for j, t in rows if j == i) for i, _ in rows}
    x, y = first(old), first(new)
    assert set(got) == set(x) | set(y)
    for i, r in got.items():
        p, q = (set(op6.digests(t.get(i, "")).view(np.int64).tolist()) for t in (x, y))
        assert (r.n_old, r.n_new, set(r.removed), set(r.added)) == (len(p), len(q), p - q, q - p) and r.removed == sorted(r.removed)
    assert op6.changed_paragraphs(a.limit(0), b.limit(0)).count() == 0
    # From the fingerprints alone: small differences come back, large ones are refused.
    prints = {r.doc_id: r.fingerprint for r in op6.fingerprints(a.where("doc_id < 60 AND text NOT LIKE '~%'")).collect()}
    later = {r.doc_id: r.fingerprint for r in op6.fingerprints(b.where("doc_id < 60")).collect()}
    small = refused = 0
    for i in set(prints) & set(later):
        found, (p, q) = op6.fingerprint_difference(prints[i], later[i]), (set(op6.digests(dict(t)[i]).tolist()) for t in (old[:60], new))
        assert op6.decode(prints[i])[0] == len(p)
        if found is None:
            refused += 1
            assert len(p ^ q) > 3
        else:
            small += 1
            assert set(found[0].tolist()) == p - q and set(found[1].tolist()) == q - p
    assert small > 20 and refused > 0
    with pytest.raises(ValueError):
        op6.decode("AAAA")
