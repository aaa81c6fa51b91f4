"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.session import cut, ensure_checkpoint_dir  # noqa: F401  (cut is used by the operators)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole table, read by Spark (any store Spark can open)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared checkpoint folder of the session."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts the lineage with
    files that outlive any executor."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spare(name: str, *frames: DataFrame) -> str:
    """``name``, with underscores added until no frame has a column of that name."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def lower_az(c: Column) -> Column:
    """Lower-case A-Z only (no locale or Unicode rules)."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1, from 0) of an Arrow string column; null counts as empty."""
    import pyarrow as pa

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    arr = column.cast(pa.large_binary())
    arr = arr.fill_null(b"") if arr.null_count else arr  # copies only where it must
    offs = np.frombuffer(arr.buffers()[1], dtype=np.int64)[arr.offset:arr.offset + len(arr) + 1]
    data = arr.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offs[0]:offs[-1]] if data is not None and len(arr) else np.zeros(0, np.uint8)
    return raw, (offs - offs[0]) if len(arr) else np.zeros(1, np.int64)


def open_fs(uri: str):
    """File system and path of a folder that Spark names by URI; works in tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


FILTER_BITS_PER_KEY, FILTER_MAX_BITS = 16, 1 << 28  # at most 32 MB, whatever the number of keys


def _filter_places(keys: np.ndarray, bits: int) -> np.ndarray:
    from evalspark.llm.rolling import mix

    k = keys.view(np.uint64)
    return np.concatenate([mix(k + np.uint64(salt)) & np.uint64(bits - 1) for salt in (0x51ED27, 0xA2B3C5)])


def key_filter(keys: DataFrame) -> np.ndarray:
    """Bit set (Bloom filter) of the long column ``k``, as 64-bit words. Its size follows the
    number of keys up to a fixed bound; a full filter lets more rows pass, never fewer, so
    it only saves shuffled bytes and never decides a result."""
    n = keys.count()
    bits = 1 << 16
    while bits < min(FILTER_MAX_BITS, FILTER_BITS_PER_KEY * n):
        bits *= 2

    def run(batches):
        import pyarrow as pa

        for b in batches:
            place = np.unique(_filter_places(b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), bits))
            word, first = np.unique(place >> np.uint64(6), return_index=True)
            value = np.bitwise_or.reduceat(np.uint64(1) << (place & np.uint64(63)), first) if len(place) else place
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(value.view(np.int64))], ["w", "v"])

    got = keys.select("k").mapInArrow(run, "w bigint, v bigint").groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[got.column("w").to_numpy()] = got.column("v").to_numpy().view(np.uint64)
    return words


def may_hold(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """False only for keys that are not in the filter."""
    place = _filter_places(np.ascontiguousarray(keys, dtype=np.int64), len(words) * 64)
    hit = (words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)) == 1
    return hit[:len(keys)] & hit[len(keys):]
