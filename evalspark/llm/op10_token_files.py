"""Token-ID files: flat unsigned integers plus 64-bit document offsets.

Documents are range-partitioned by id, so each task writes one shard in id order:

* ``<shard>.bin``  token ids, ``uint16`` where the vocabulary fits, else ``uint32``;
* ``<shard>.off``  ``uint64`` offsets into the shard, documents + 1 of them;
* ``<shard>.ids``  ``int64`` document ids, and ``<shard>.nul`` one byte per document
  (1: the id is null).

A shard's name is new for every task attempt and only the attempt that Spark accepts
is listed in the manifest, so a lost executor or a repeated task leaves no trace in
the result. Shard bases are prefix sums over the manifest (one row per shard)."""

from __future__ import annotations

import uuid
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalspark.llm.common import open_fs, scratch

CACHE_ENTRIES = 1_000_000
# Fixed rule of byte-level BPE: visible Latin-1 bytes stand for themselves, the others
# for the characters from 256 on, in order.
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
BYTE_CHARS = {b: chr(b) if b in _SHOWN else chr(256 + b - sum(s < b for s in _SHOWN)) for b in range(256)}
MARKS = "!#$%&*,.;:?)]}"  # ASCII characters that are neither letter, number nor white space
_ENCODERS: dict[str, "Encoder"] = {}


class Encoder:
    """Exact token ids of whole texts, with a bounded memory of words.

    Byte-level BPE never merges across the parts its pre-tokenizer cuts, and a part
    never crosses the white space before a word. So a text is cut at its spaces, each
    piece (a word with the space before it) into the pre-tokenizer's parts, and the ids
    of each distinct part come from one call of the tokenizers library. Texts that hold
    a special token, and tokenizers of another kind, are encoded whole."""

    def __init__(self, tokenizer_file: str):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size(True) <= 1 << 16 else np.dtype("<u4")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        conf = json.loads(self.tokenizer.to_str())
        pre = conf.get("pre_tokenizer") or {}
        self.by_piece = (conf.get("normalizer") is None and pre.get("type") == "ByteLevel"
                         and pre.get("use_regex", True) and not pre.get("add_prefix_space", True))

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
        return np.array(ids, dtype=self.dtype).tobytes()

    def _part(self, part: str) -> bytes:
        found = self.known.get(part)
        if found is None:
            shown = part.encode("utf-8", "surrogatepass").decode("latin-1").translate(BYTE_CHARS)
            found = np.array([t.id for t in self.tokenizer.model.tokenize(shown)], dtype=self.dtype).tobytes()
            if len(self.known) < CACHE_ENTRIES and len(part) <= 64:
                self.known[part] = found
        return found

    def _piece(self, piece: str) -> bytes:
        word = piece.rstrip(MARKS)
        if (word[1:] if word[:1] == " " else word).isalpha():  # letters, then marks: two parts
            return self._part(word) + (self._part(piece[len(word):]) if len(word) < len(piece) else b"")
        cuts = self.tokenizer.pre_tokenizer.pre_tokenize_str(piece)
        return b"".join([self._part(piece[x:y]) for _, (x, y) in cuts])

    def encode(self, text: str) -> bytes:
        """Token ids of the whole text, as bytes of ``dtype``."""
        if not text:
            return b""
        if not self.by_piece or any(s in text for s in self.special):
            return self._whole(text)
        words = text.split(" ")
        # A word that is empty or ends in white space shares that white space with the
        # next one: those form one longer piece.
        if "" in words or any(map(str.isspace, [w[-1] for w in words])):
            pieces, held = [], ""
            for i, w in enumerate(words):
                held += w if i == 0 else " " + w
                if w and not w[-1].isspace():
                    pieces.append(held)
                    held = ""
            if held:
                pieces.append(held)
        else:
            pieces = [words[0], *[" " + w for w in words[1:]]]
        known, piece = self.known.get, self._piece
        return b"".join([known(p) or piece(p) for p in pieces])


def encoder(tokenizer_file: str) -> Encoder:
    """One encoder per worker process."""
    if tokenizer_file not in _ENCODERS:
        _ENCODERS[tokenizer_file] = Encoder(tokenizer_file)
    return _ENCODERS[tokenizer_file]


def _writer(folder: str, tokenizer_file: str, end_id: int):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        enc = encoder(tokenizer_file)
        fs, top = open_fs(folder)
        name = f"shard-{uuid.uuid4().hex}"
        fs.create_dir(top, recursive=True)
        outs = {k: fs.open_output_stream(f"{top}/{name}.{k}") for k in ("bin", "off", "ids", "nul")}
        end, width = np.array([end_id], dtype=enc.dtype).tobytes(), enc.dtype.itemsize
        n_docs = n_tokens = 0
        outs["off"].write(np.zeros(1, "<u8").tobytes())
        for b in batches:
            ids = b.column(0)
            offs = []
            for text in b.column(1):
                raw = enc.encode(text.as_py() or "") + end
                outs["bin"].write(raw)
                n_tokens += len(raw) // width
                offs.append(n_tokens)
            outs["off"].write(np.array(offs, dtype="<u8").tobytes())
            outs["ids"].write(ids.fill_null(0).to_numpy().astype("<i8").tobytes())
            outs["nul"].write(ids.is_null().to_numpy(zero_copy_only=False).astype("u1").tobytes())
            n_docs += b.num_rows
        for o in outs.values():
            o.close()
        if n_docs:
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([name]), pa.array([width], pa.int32()),
                 pa.array([n_docs], pa.int64()), pa.array([n_tokens], pa.int64())],
                ["part", "shard", "width", "n_docs", "n_tokens"])
    return run


def write_token_files(docs: DataFrame, folder: str, tokenizer_file: str, end_id: int = 0,
                      id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the shards of ``docs`` in ascending id order (null ids first, repeated ids
    side by side) and ``manifest.parquet`` below ``folder``, a URI that all executors
    share. Null text counts as empty; every document ends with ``end_id``. An empty
    table writes an empty manifest. Ids must be integers."""
    rows = (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
            .repartitionByRange("id").sortWithinPartitions("id"))
    made = rows.mapInArrow(_writer(folder, tokenizer_file, end_id),
                           "part int, shard string, width int, n_docs bigint, n_tokens bigint")
    made.write.parquet(f"{folder}/manifest.parquet")


def shard_bases(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest with ``base``: ids in all shards before. One row per shard, so the
    running sum is over a table of file names, not of documents."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return (spark.read.parquet(f"{folder}/manifest.parquet")
            .withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long")))


def _mapped(fs, path: str, dtype: str) -> np.ndarray:
    """The file as an array: memory-mapped where it is local, else read."""
    from pyarrow import fs as pafs

    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, dtype=dtype, mode="r")
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read_buffer(), dtype=dtype)


def _reader(folder: str, rows_per_batch: int = 4096):
    def run(batches):
        import pyarrow as pa

        fs, top = open_fs(folder)
        for b in batches:
            for shard, width, n_docs, base in zip(*(b.column(c).to_pylist() for c in ("shard", "width", "n_docs", "base"))):
                off = _mapped(fs, f"{top}/{shard}.off", "<u8")
                tokens = _mapped(fs, f"{top}/{shard}.bin", f"<u{width}")
                ids, nul = _mapped(fs, f"{top}/{shard}.ids", "<i8"), _mapped(fs, f"{top}/{shard}.nul", "u1")
                if not len(off) == n_docs + 1 == len(ids) + 1 == len(nul) + 1 or off[-1] != len(tokens):
                    raise ValueError(f"{shard}: offsets and files do not agree")
                for at in range(0, n_docs, rows_per_batch):
                    o = np.asarray(off[at:at + rows_per_batch + 1]).astype(np.int64)
                    crc = [zlib.crc32(tokens[x:y].astype("<u4").tobytes()) for x, y in zip(o[:-1].tolist(), o[1:].tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.asarray(ids[at:at + rows_per_batch]), mask=np.asarray(nul[at:at + rows_per_batch]) == 1),
                         pa.array(o[:-1] + base), pa.array(np.diff(o)), pa.array(crc, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"])
    return run


def read_token_index(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, from the files: ``doc_id``, ``start`` (ids of all documents before),
    ``n_tokens`` (with the end id), ``ids_crc32`` (of the ids as little-endian uint32)."""
    bases = shard_bases(spark, folder)
    shards = spark.read.parquet(f"{folder}/manifest.parquet").count()
    return (bases.repartition(max(1, shards))
            .mapInArrow(_reader(folder), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"))


def token_files(docs: DataFrame, tokenizer_file: str, end_id: int = 0, id_col: str = "doc_id",
                text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Write the files (to a new folder in the shared checkpoint folder by default) and
    return the index read back from them."""
    folder = folder or scratch(docs.sparkSession, "token-files")
    write_token_files(docs, folder, tokenizer_file, end_id, id_col, text_col)
    return read_token_index(docs.sparkSession, folder)
