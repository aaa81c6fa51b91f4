"""WARC archives in Zstandard: one frame per record, the dictionary in a leading
skippable frame.

Writing: every task writes one archive below a shared folder under a name of its own
attempt; the accepted attempts are listed in ``manifest.parquet``. Reading streams an
archive frame by frame, loads the dictionary, and checks version, headers, block
length, record end and payload digest; what does not agree raises."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm.common import open_fs, scratch, spare

SKIPPABLE = 0x184D2A5D  # fixed value: the frame that carries a .warc.zst dictionary
ZSTD_MAGIC = 0xFD2FB528  # fixed value: start of a Zstandard frame
DICT_BYTES, DICT_SAMPLE = 16 << 10, 1 << 20  # trained on at most this much of a task's first payloads
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value of the format
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: URL name space


def with_roles(pages: DataFrame, id_col: str, payload_col: str, min_bytes: int = 100) -> DataFrame:
    """``pages`` with ``_payload`` (null: empty), ``_digest`` (SHA-256), ``_refers``: of equal
    payloads of at least ``min_bytes`` bytes the smallest id is the response, and the
    others refer to it. Rows that share the smallest id are all responses; a null id is
    never the smallest, and payloads with null ids only are all responses. A column of ``pages`` that has one
    of the new names is an error."""
    if any(spare(c, pages) != c for c in ("_payload", "_digest", "_refers", "_first", "_n")):
        raise ValueError("_payload, _digest, _refers, _first and _n are names of new columns")
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.withColumns({"_payload": payload, "_digest": F.sha2(payload, 256)})
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = (rows.where(F.octet_length("_payload") >= min_bytes).groupBy("_digest")
             .agg(F.min(id_col).alias("_first"), F.count("*").alias("_n"))
             .where("_n > 1 AND _first IS NOT NULL").drop("_n").repartition(n))
    joined = rows.join(first, "_digest", "left")
    return joined.withColumn("_refers", F.when(~F.col(id_col).eqNullSafe(F.col("_first")), F.col("_first"))).drop("_first")


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'page:{page_id}')}>"


def record_bytes(page_id, url: str | None, payload: bytes, digest: str, refers, date: str) -> bytes:
    """One WARC record; a revisit has the HTTP header of its payload and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}",
            f"WARC-Date: {date}", f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~') if url else 'urn:page'}",
            "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers)}", f"X-Refers-To-Page-Id: {refers}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_headers(raw: bytes) -> tuple[dict, bytes]:
    """Named headers (lower case; of repeated ones the last) and the block of one record. Raises ValueError where the
    version, a mandatory header or a length is wrong."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not sep or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("not a WARC record")
    h, name = {}, None
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and name:  # goes on with the header before
            h[name] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"bad header line {line!r}")
        name = name.strip().lower()
        h[name] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in h:
            raise ValueError(f"header {name} is missing")
    if not h["content-length"].isdigit():
        raise ValueError("Content-Length is no number")
    n = int(h["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"block of {len(rest) - 4} bytes, {n} announced")
    return h, rest[:n]


def check_digest(data: bytes, announced: str | None) -> str | None:
    """The bare announced digest if it agrees: SHA-256, SHA-1 or MD5, in hex or base 32. Others are not checked (null)."""
    if not announced or ":" not in announced:
        return None
    kind, _, value = announced.partition(":")
    kind = kind.strip().lower().replace("-", "")
    if kind not in ("sha256", "sha1", "md5"):
        return None
    raw = hashlib.new(kind, data).digest()
    value = value.strip()
    if value.lower() == raw.hex() or value.upper().rstrip("=") == base64.b32encode(raw).decode().rstrip("="):
        return value
    raise ValueError("digest does not agree")


def parse_record(raw: bytes, verify: bool = True) -> dict:
    """Headers and payload facts of one record of any type; raises ValueError on any disagreement.

    The payload of an HTTP message is its body, of any other record the whole block (``warcinfo``, ``metadata``, ``resource``,
    ``conversion``, ``continuation`` and types yet unknown). A body is compared with its Content-Length where the message names one
    and is not sent in chunks. A revisit may leave the payload out; then its size is the one its message names."""
    h, block = parse_headers(raw)
    kind, payload, size = h["warc-type"].lower(), block, len(block)
    if verify and kind != "revisit":
        check_digest(block, h.get("warc-block-digest"))
    message = h.get("content-type", "").lower().startswith("application/http")
    if kind in ("response", "revisit", "request") and (message or block.startswith(b"HTTP/")):
        http, sep, payload = block.partition(b"\r\n\r\n")
        if kind != "request" and (not http.startswith(b"HTTP/") or not sep):
            raise ValueError("block is no HTTP response")
        fields = dict((x.split(b":", 1) + [b""])[:2] for x in http.lower().split(b"\r\n")[1:] if x)
        told = fields.get(b"content-length", b"").strip()
        size = int(told) if told.isdigit() and (kind == "revisit" and not payload) else len(payload)
        if kind == "response" and told.isdigit() and b"transfer-encoding" not in fields and "warc-truncated" not in h and len(payload) != int(told):
            raise ValueError(f"payload of {len(payload)} bytes, {int(told)} announced")
    digest = h.get("warc-payload-digest")
    if kind == "revisit":
        if "warc-refers-to" not in h and "warc-refers-to-target-uri" not in h:
            raise ValueError("revisit without what it refers to")
    elif verify and digest is not None:
        check_digest(payload, digest)
    return {"headers": h, "payload": payload, "payload_bytes": size, "payload_digest": (digest or "").partition(":")[2].strip() or None}


def dictionary_for(samples: list[bytes]):
    """A Zstandard dictionary of the sample; None without one. Too little to train on:
    the sample's own first bytes."""
    import zstandard

    body = b"".join(samples)[:DICT_BYTES]
    if len(body) < 256:
        return None
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(body, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def read_records(stream, block: int = 1 << 15):
    """The records (bytes) of an archive opened for reading, one frame at a time."""
    import zstandard

    held = stream.read(8)
    dictionary = None
    if len(held) == 8 and struct.unpack("<I", held[:4])[0] == SKIPPABLE:
        size = struct.unpack("<I", held[4:])[0]
        raw = stream.read(size)
        if len(raw) != size:
            raise ValueError("the dictionary frame is cut short")
        if len(raw) > 4 and struct.unpack("<I", raw[:4])[0] == ZSTD_MAGIC:  # a dictionary may itself be compressed
            raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=1 << 27)
        dictionary, held = zstandard.ZstdCompressionDict(raw), b""
    decoder = zstandard.ZstdDecompressor(dict_data=dictionary)
    while True:
        held = held or stream.read(block)
        if not held:
            return
        frame, out = decoder.decompressobj(), []
        while not frame.eof:
            if not held and not (held := stream.read(block)):
                raise ValueError("the archive ends inside a frame")
            out.append(frame.decompress(held))
            held = frame.unused_data if frame.eof else b""
        yield b"".join(out)


def _writer(folder: str, date: str):
    def run(batches):
        import pyarrow as pa
        import zstandard

        fs, top = open_fs(folder)
        fs.create_dir(top, recursive=True)
        name, out, n, pending, sampled = f"archive-{uuid.uuid4().hex}.warc.zst", None, 0, [], 0

        def start():
            dictionary = dictionary_for([r[2][:4096] for r in pending])
            stream = fs.open_output_stream(f"{top}/{name}", compression=None)  # the name alone would make it compress again
            if dictionary is not None:
                raw = dictionary.as_bytes()
                stream.write(struct.pack("<II", SKIPPABLE, len(raw)) + raw)
            return stream, zstandard.ZstdCompressor(level=3, dict_data=dictionary)

        for b in batches:
            for page, url, payload, digest, refers in zip(*(b.column(i).to_pylist() for i in range(5))):
                row = (page, url, payload.encode("utf-8", "surrogatepass"), digest, refers)
                if out is None:
                    pending.append(row)
                    sampled += min(len(row[2]), 4096)
                    if sampled < DICT_SAMPLE:
                        continue
                    out, coder = start()
                else:
                    pending = [row]
                for r in pending:
                    out.write(coder.compress(record_bytes(*r, date)))
                    n += 1
                pending = []
        if out is None and pending:
            out, coder = start()
            for r in pending:
                out.write(coder.compress(record_bytes(*r, date)))
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["archive", "records"])
    return run


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
               payload_col: str = "html", min_bytes: int = 100, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write one record per row below ``folder`` (a URI all executors share). Null payloads are empty, null ids and URLs are
    left out of the headers or stand as a URN; repeated rows are written once each; no rows, no archives."""
    rows = with_roles(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"),
                                   F.col(payload_col).alias("payload")), "page_id", "payload", min_bytes)
    (rows.select("page_id", "url", "_payload", "_digest", "_refers")
     .mapInArrow(_writer(folder, date), "archive string, records bigint")
     .write.parquet(f"{folder}/manifest.parquet"))


def _reader(folder: str, with_payload: bool, rows_per_batch: int = 512):
    def run(batches):
        import pyarrow as pa

        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", "payload"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        fs, top = open_fs(folder)
        for b in batches:
            for archive, announced in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows, n = [], 0
                with fs.open_input_stream(f"{top}/{archive}", compression=None) as f:
                    for raw in read_records(f):
                        r = parse_record(raw)
                        h = r["headers"]
                        page, refers = h.get("x-page-id"), h.get("x-refers-to-page-id")
                        rows.append((None if page is None else int(page), r["payload_bytes"], r["payload_digest"], h["warc-type"],
                                     None if refers is None else int(refers), h.get("warc-target-uri"),
                                     r["payload"] if with_payload else None))
                        n += 1
                        if len(rows) == rows_per_batch:
                            yield batch(rows)
                            rows = []
                if rows:
                    yield batch(rows)
                if n != announced:
                    raise ValueError(f"{archive}: {n} records, {announced} written")
    return run


def read_warc(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """One row per record of the archives listed in the manifest (see ``read_archives`` for others'): no records, no rows;
    an archive that holds another number of records than listed fails the job."""
    manifest = spark.read.schema("archive string, records bigint").parquet(f"{folder}/manifest.parquet")
    return manifest.repartition(max(1, manifest.count())).mapInArrow(
        _reader(folder, with_payload), "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, "
        "refers_to bigint, target_uri string, payload binary")


def warc_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                    min_bytes: int = 100, folder: str | None = None) -> DataFrame:
    """Write the archives (to a new folder in the shared checkpoint folder by default)
    and return their records. Null payloads are empty, repeated rows are written once
    each, an empty table gives no archives and no rows; ids must be integers."""
    folder = folder or scratch(pages.sparkSession, "warc")
    write_warc(pages, folder, id_col, url_col, payload_col, min_bytes)
    return read_warc(pages.sparkSession, folder)


ARCHIVE = "archive string, record_no bigint, record_id string, record_type string, date string, target_uri string, content_type string, " \
          "refers_to string, payload_bytes bigint, payload_digest string, payload binary, error string"


def read_archives(spark: SparkSession, folder: str, verify: bool = True, with_payload: bool = True, on_error: str = "raise",
                  rows_per_batch: int = 512) -> DataFrame:
    """One row per record of all ``*.warc.zst`` files below ``folder``, whoever wrote them, in no order: ``archive``, ``record_no`` (from 0), the headers
    ``record_id``, ``record_type``, ``date``, ``target_uri``, ``content_type``, ``refers_to``, then ``payload_bytes``, ``payload_digest``
    (as announced, bare), ``payload`` and ``error``.

    Only names and lengths of files are listed; a task streams its archives a frame at a time, so its memory is one
    record's. Record types are passed through; headers that are missing are null. A record that breaks the format or whose digest
    disagrees fails the job, or with ``on_error="mark"`` comes back with ``error`` and what is known of it; what
    follows a broken frame in its file is not read then. Files without records give none; an archive listed twice is read
    twice; no files give an empty result."""
    if on_error not in ("raise", "mark"):
        raise ValueError("on_error is 'raise' or 'mark'")
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.warc.zst")
             .load(folder).select("path", "length"))

    def run(batches):
        import pyarrow as pa

        names = [f.split(" ")[0] for f in ARCHIVE.split(", ")]
        kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
        types = [kinds[f.split(" ")[1]] for f in ARCHIVE.split(", ")]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), types)], names)

        for b in batches:
            for path in b.column(0).to_pylist():
                fs, place = open_fs(path)
                rows, no = [], 0
                with fs.open_input_stream(place, compression=None) as f:
                    frames = read_records(f)
                    while True:
                        r, h, error = None, {}, None
                        try:
                            raw = next(frames, None)
                            if raw is None:
                                break
                            r = parse_record(raw, verify)
                            h = r["headers"]
                        except (ValueError, OSError) as e:
                            error = e
                        except Exception as e:  # the decompressor's own kind
                            if type(e).__name__ != "ZstdError":
                                raise
                            error = e
                        if error is not None and on_error == "raise":
                            raise ValueError(f"{path}, record {no}: {error}") from error
                        rows.append((path, no, h.get("warc-record-id"), h.get("warc-type"), h.get("warc-date"), h.get("warc-target-uri"),
                                     h.get("content-type"), h.get("warc-refers-to"), r and r["payload_bytes"], r and r["payload_digest"],
                                     r["payload"] if r and with_payload else None, str(error) if error is not None else None))
                        no += 1
                        if len(rows) == rows_per_batch:
                            yield batch(rows)
                            rows = []
                if rows:
                    yield batch(rows)

    parts = max(1, min(files.count(), 10_000))  # tasks, not files, are bounded
    return files.select("path").repartition(parts).mapInArrow(run, ARCHIVE)
