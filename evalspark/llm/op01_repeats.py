"""Removal of repeated byte windows by a depth-limited radix sort.

All windows of ``length`` bytes are sorted only as far as equality needs, by passes over
digits from the most significant on, and a group of one leaves after every pass. The
digits are read in an order each window's own bytes fix, so that equal windows have equal
digits and neighbouring windows share the first ones:

1. the ``DIGIT`` bytes at the window's smallest k-gram (leftmost smallest hash). The windows
   with the same smallest k-gram form a run, so this pass has one row per run, about
   2 in ``length - DIGIT + 2`` bytes, and not one per byte;
2. the bytes of the whole run. Where all runs of a group are equal, all their windows are
   repeated, and the group is finished; runs that occur more than once are finished too;
3. the window itself, for the runs of the groups that are left, each distinct run once.

What is left in a group after the last pass are exactly the repeated windows (up to
collisions of two independent 64-bit hashes). Small groups take the third pass in one
task. Larger ones take it as rows, so that no group meets in one task, and by digits of
their own: blocks of ``LEVELS`` windows, from large to single ones. The digit of a block is
its core, the bytes all its windows share. A block whose core is alone holds no repeated
window, blocks that are equal as a whole are finished, and only the different blocks of a
core, those across the edge of a repeat, go on to smaller blocks, each once.

Text moves only for the rows that need it: a bounded bit set of the keys (see
``common.key_filter``) keeps the others out of the shuffles."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import key_filter, may_hold, stored, utf8
from evalspark.llm.rolling import Prefix, mix, sliding_min

LENGTH, DIGIT = 200, 64
BLOCK = 1 << 17  # bytes hashed at once; longer texts go in pieces that overlap
PIECE = 1 << 22
ROWS = 1024  # runs whose windows are hashed at once
LEVELS = (32, 8, 1)
SMALL_GROUP = 500  # distinct runs that take the third pass in one task
PLACE_BITS = 24


def runs_of(raw: np.ndarray, offsets: np.ndarray, length: int, digit: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with the same smallest k-gram in the documents ``raw[offsets[i]:offsets[i + 1]]``:
    document, first window (from the document's start), windows - 1, place of the k-gram
    after the first window, hash of the k-gram, hash of the whole run."""
    if len(raw) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    first, second = Prefix(raw, 0), Prefix(raw, 1)
    grams = first.windows(digit)
    place = np.arange(len(grams), dtype=np.uint64)
    low = np.uint64((1 << PLACE_BITS) - 1)
    best = (sliding_min((grams & ~low) | place, length - digit + 1) & low).astype(np.int64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:len(best)]
    inside = np.arange(len(best)) + length <= offsets[1:][doc]
    begins = inside & np.r_[True, (best[1:] != best[:-1]) | (doc[1:] != doc[:-1]) | ~inside[:-1]]
    start = np.flatnonzero(begins)
    ends = np.flatnonzero(inside & np.r_[begins[1:] | ~inside[1:], True])
    at = best[start]
    shape = (at - start).astype(np.uint64) << np.uint64(32) | (ends - start).astype(np.uint64)
    return (doc[start], start - offsets[doc[start]], ends - start, at - start, grams[at],
            mix(second.spans(start, ends + length) ^ mix(shape)))


def pieces(offsets: np.ndarray, length: int):
    """Spans of documents (from, to, byte from, byte to) small enough to hash at once; a long
    document comes alone, in pieces that share ``length - 1`` bytes, so every window is in one."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + BLOCK, side="right")) - 1))
        if j == i + 1 and offsets[j] - offsets[i] > PIECE:
            at = int(offsets[i])
            while at < offsets[j]:
                end = min(at + PIECE, int(offsets[j]))
                yield i, j, at, end
                if end == offsets[j]:
                    break
                at = end - length + 1
        else:
            yield i, j, int(offsets[i]), int(offsets[j])
        i = j


def _emit_runs(length: int, digit: int, wanted=None):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            ids, h = b.column(0), b.column(1)
            raw, offsets = utf8(b.column(2))
            for i, j, x, y in pieces(offsets, length):
                own = offsets[i:j + 1] - x if j > i + 1 or (x, y) == (offsets[i], offsets[j]) else np.array([0, y - x])
                doc, s, n, off, d1, d2 = runs_of(raw[x:y], own, length, digit)
                if j == i + 1:
                    s = s + (x - offsets[i])
                if wanted is not None:
                    keep = may_hold(wanted.value, d1.view(np.int64))
                    doc, s, n, off, d1, d2 = (v[keep] for v in (doc, s, n, off, d1, d2))
                if len(doc):
                    rows = pa.array(doc + i)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), ids.take(rows), h.take(rows),
                         pa.array(s), pa.array(n.astype(np.int32)), pa.array(off.astype(np.int32))], ["d1", "d2", "id", "h", "s", "n", "off"])
            pa.default_memory_pool().release_unused()
    return run


RUNS = "d1 bigint, d2 bigint, id bigint, h bigint, s bigint, n int, off int"


RUN_FIELDS = ("d1", "d2", "off", "many", "big", "body")


def _cut_runs(length: int):
    """Bytes of the runs listed for each document."""
    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for i in range(b.num_rows):
                text = (b.column(0)[i].as_py() or "").encode("utf-8", "surrogatepass")
                for r in b.column(1)[i].as_py():
                    out.append((r["d1"], r["d2"], r["off"], r["many"], r["big"], text[r["s"]:r["s"] + r["n"] + length]))
                if len(out) >= ROWS:
                    yield pa.RecordBatch.from_pylist([dict(zip(RUN_FIELDS, o)) for o in out])
                    out = []
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(RUN_FIELDS, o)) for o in out])
            pa.default_memory_pool().release_unused()
    return run


def _window_hashes(bodies, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Run, window number and hash of all windows of some runs."""
    raw, offsets = utf8(bodies)
    counts = np.maximum(np.diff(offsets) - length + 1, 0)
    owner = np.repeat(np.arange(len(counts)), counts)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = offsets[:-1][owner] + number
    return owner, number, Prefix(raw, 1).spans(start, start + length)


def _stretches(owner: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring windows of the same run as (run, first window, last window)."""
    if not len(owner):
        return owner, owner, owner
    new = np.r_[True, (owner[1:] != owner[:-1]) | (number[1:] != number[:-1] + 1)]
    at = np.flatnonzero(new)
    last = np.r_[at[1:], len(owner)] - 1
    return owner[at], number[at], number[last]


def _last_pass(length: int):
    """Third pass in one task: rows sorted by the first digit; every run is distinct."""
    def run(batches):
        import pyarrow as pa

        def solve(t):
            d1 = t.column("d1").to_numpy()
            group = np.cumsum(np.r_[0, d1[1:] != d1[:-1]]).astype(np.uint64)
            owner, number, h = _window_hashes(t.column("body"), length)
            key = mix(h + mix(group[owner] + np.uint64(7)))
            _, inverse, n = np.unique(key, return_inverse=True, return_counts=True)
            hit = n[inverse] > 1  # a run never holds a window twice: its k-gram would not be the leftmost
            who, a, z = _stretches(owner[hit], number[hit])
            once = ~t.column("many").to_numpy(zero_copy_only=False)[who]
            who, a, z = who[once], a[once], z[once]
            return pa.RecordBatch.from_arrays([t.column("d1").combine_chunks().take(pa.array(who)), t.column("d2").combine_chunks().take(pa.array(who)),
                                               pa.array(a), pa.array(z)], ["d1", "d2", "a", "z"])

        held = None
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                t = pa.Table.from_batches([b.slice(at, ROWS)])
                t = t if held is None else pa.concat_tables([held, t])
                d1 = t.column("d1").to_numpy()
                done = int(np.searchsorted(d1, d1[-1]))  # sorted; the last group may go on
                if done:
                    yield solve(t.slice(0, done))
                held = pa.Table.from_batches([t.slice(done).combine_chunks().to_batches()[0]])
        if held is not None:
            yield solve(held)
    return run


def _blocks(length: int, size: int):
    """Blocks of ``size`` windows of the listed parts of runs: core, hash of the whole block
    and of which of its windows the run has, and those windows. Blocks begin where the
    distance to the run's k-gram is a multiple of ``size``, so they agree between runs."""
    def run(batches):
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                t = b.slice(at, ROWS)
                raw, offsets = utf8(t.column("body"))
                parts = t.column("parts")
                owner = np.repeat(np.arange(t.num_rows), np.diff(np.asarray(parts.offsets)))
                flat = parts.flatten()
                off = t.column("off").to_numpy().astype(np.int64)[owner]
                lo = flat.field("a").to_numpy().astype(np.int64)
                hi = flat.field("z").to_numpy().astype(np.int64)
                first = (lo - off) // size
                count = (hi - off) // size - first + 1
                rows = np.repeat(np.arange(len(lo)), count)
                number = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
                start = (first[rows] + number) * size + off[rows]  # of the whole block, also where the run has less
                a, z = np.maximum(start, lo[rows]), np.minimum(start + size - 1, hi[rows])
                owner = owner[rows]
                base = offsets[:-1][owner]
                prefix = Prefix(raw, 1)
                d1 = t.column("d1").to_numpy().view(np.uint64)[owner]
                core = mix(prefix.spans(base + start + size - 1, base + start + length) + mix(d1 + np.uint64(size)))
                shape = (a - start).astype(np.uint64) << np.uint64(32) | (z - start).astype(np.uint64)
                whole = mix(prefix.spans(base + a, base + z + length) ^ mix(shape))
                take = pa.array(owner)
                yield pa.RecordBatch.from_arrays([pa.array(core.view(np.int64)), pa.array(whole.view(np.int64)), t.column("d1").take(take),
                                                  t.column("d2").take(take), pa.array(a), pa.array(z)], ["core", "whole", "d1", "d2", "a", "z"])
    return run


def _by_blocks(bodies: DataFrame, length: int) -> DataFrame:
    """Third pass of the large groups: ``d1``, ``d2``, ``a``, ``z`` of the repeated windows."""
    parts = int(bodies.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    span = F.struct(F.lit(0).cast("bigint").alias("a"), (F.length("body") - length).cast("bigint").alias("z"))
    listed, found = bodies.withColumn("parts", F.array(span)), []
    for size in [x for x in LEVELS if 2 * x <= length]:  # a core needs bytes
        blocks = stored(listed.select("d1", "d2", "off", "body", "parts").mapInArrow(
            _blocks(length, size), "core bigint, whole bigint, d1 bigint, d2 bigint, a bigint, z bigint"), f"repeat-blocks-{size}")
        wholes = blocks.groupBy("core", "whole").agg(F.count("*").alias("c"), F.min(F.struct("d1", "d2", "a", "z")).alias("one"))
        same = wholes.where("c > 1").select("core", "whole").repartition(parts)
        found.append(blocks.join(same, ["core", "whole"]).select("d1", "d2", "a", "z"))
        if size == LEVELS[-1]:
            break
        # Every different block of a core goes on once, if some block of that core stands alone.
        cores = wholes.groupBy("core").agg(F.count("*").alias("n"), F.min("c").alias("least")).where("n > 1 AND least = 1").select("core").repartition(parts)
        open_parts = (wholes.join(cores, "core").select("one.*").groupBy("d1", "d2").agg(F.collect_list(F.struct("a", "z")).alias("parts")))
        listed = bodies.join(open_parts, ["d1", "d2"])
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``h`` (hash of the text that tells rows with the same id apart), ``text``."""
    h = F.xxhash64("text")
    return (docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
            .select("id", F.when(F.col("id").isNull(), h).otherwise(h.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))).alias("h"), "text"))


def _same_row(a: DataFrame, b: DataFrame) -> Column:
    return a["id"].eqNullSafe(b["id"]) & (a["h"] == b["h"])


def _passes_filter(words: np.ndarray, spark):
    shared = spark.sparkContext.broadcast(words)

    @F.pandas_udf("boolean")
    def test(k: pd.Series) -> pd.Series:
        return pd.Series(may_hold(shared.value, k.to_numpy()))
    return test


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   digit: int = DIGIT) -> DataFrame:
    """``id``, ``h``, ``spans`` (sorted structs ``x``, ``y``: byte ranges covered by repeated
    windows, they may overlap) for the rows that have any."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = _keyed(docs, id_col, text_col)
    long_enough = rows.where(F.octet_length("text") >= length)
    # Pass 1: the k-gram.
    digits = (long_enough.mapInArrow(_emit_runs(length, digit), RUNS).groupBy("d1")
              .agg(F.count("*").alias("c"), F.min("d2").alias("lo"), F.max("d2").alias("hi")))
    again = stored(digits.where("c > 1").select("d1", (F.col("lo") != F.col("hi")).alias("mixed")), "repeat-digits")
    wanted = spark.sparkContext.broadcast(key_filter(again.select(F.col("d1").alias("k"))))
    runs = stored(long_enough.mapInArrow(_emit_runs(length, digit, wanted), RUNS).join(again, "d1"), "repeat-runs")
    whole = runs.where("NOT mixed").select("id", "h", F.col("s").alias("x"), (F.col("s") + F.col("n") + length).alias("y"))
    # Pass 2: the run.
    mixed = runs.where("mixed")
    distinct = stored(mixed.groupBy("d1", "d2", "n", "off").agg(F.count("*").alias("c"), F.min(F.struct("id", "h", "s")).alias("at"))
                      .select("d1", "d2", "n", "off", (F.col("c") > 1).alias("many"), "at.*"), "repeat-distinct")
    many = distinct.where("many").select("d1", "d2")
    whole = whole.union(mixed.join(many, ["d1", "d2"]).select("id", "h", F.col("s").alias("x"), (F.col("s") + F.col("n") + length).alias("y")))
    # Pass 3: the windows of the runs that are left.
    sizes = distinct.groupBy("d1").agg(F.count("*").alias("members"))
    left = distinct.join(sizes.where("members > 1").repartition(parts), "d1")
    lists = (left.groupBy("id", "h").agg(F.collect_list(F.struct("d1", "d2", "s", "n", "off", "many", (F.col("members") > SMALL_GROUP).alias("big"))).alias("runs")))
    row_key = F.xxhash64("id", "h")
    lists = stored(lists, "repeat-lists")
    needed = _passes_filter(key_filter(lists.select(row_key.alias("k"))), spark)
    texts = rows.where(needed(row_key)).join(lists.hint("shuffle_hash"), _same_row(rows, lists)).select("text", "runs")
    bodies = stored(texts.mapInArrow(_cut_runs(length), "d1 bigint, d2 bigint, off bigint, many boolean, big boolean, body binary"), "repeat-bodies")
    small = (bodies.where("NOT big").repartition("d1").sortWithinPartitions("d1")
             .mapInArrow(_last_pass(length), "d1 bigint, d2 bigint, a bigint, z bigint"))
    large = _by_blocks(bodies.where("big"), length)
    once = distinct.where("NOT many").select("d1", "d2", "id", "h", "s")
    partly = small.union(large).distinct().join(once, ["d1", "d2"]).select(
        "id", "h", (F.col("s") + F.col("a")).alias("x"), (F.col("s") + F.col("z") + length).alias("y"))
    return whole.union(partly).groupBy("id", "h").agg(F.sort_array(F.collect_set(F.struct("x", "y"))).alias("spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted ranges united where they overlap or touch."""
    out: list[tuple[int, int]] = []
    for x, y in spans:
        if out and x <= out[-1][1]:
            if y > out[-1][1]:
                out[-1] = (out[-1][0], y)
        else:
            out.append((x, y))
    return out


def _finish(with_spans: bool, with_kept: bool):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            n_bytes, n_removed, n_spans, digest, kept_texts = [], [], [], [], []
            for i in range(b.num_rows):
                raw = (b.column(1)[i].as_py() or "").encode("utf-8", "surrogatepass")
                spans = merged([(s["x"], s["y"]) for s in b.column(2)[i].as_py() or []]) if with_spans else []
                kept, at = [], 0
                for x, y in spans:
                    kept.append(raw[at:x])
                    at = y
                rest = b"".join([*kept, raw[at:]])
                n_bytes.append(len(raw))
                n_removed.append(len(raw) - len(rest))
                n_spans.append(len(spans))
                digest.append(hashlib.sha256(rest).hexdigest())
                kept_texts.append(rest if with_kept else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()),
                                              pa.array(digest, pa.string()), pa.array(kept_texts, pa.binary())],
                                             ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
    return run


DONE = "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   digit: int = DIGIT, with_kept: bool = False) -> DataFrame:
    """Per row: id, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``, and the remaining
    bytes ``kept`` (null unless asked for).

    Every byte under a window of ``length`` bytes that also starts elsewhere in any row is
    removed, the first occurrence too. Null text is empty; texts shorter than a window lose
    nothing; repeated rows are repeats of each other; null ids are kept. An empty table
    gives an empty result; other columns are not read. Ids must be integers, and
    ``digit`` smaller than ``length``."""
    spans = stored(repeated_spans(docs, id_col, text_col, length, digit), "repeat-spans")
    row_key = F.xxhash64("id", "h")
    has = _passes_filter(key_filter(spans.select(row_key.alias("k"))), docs.sparkSession)
    rows = _keyed(docs, id_col, text_col).withColumn("has", has(row_key))
    joined = rows.where("has").join(spans.hint("shuffle_hash"), _same_row(rows, spans), "left").select(rows["id"], "text", "spans")
    done = joined.mapInArrow(_finish(True, with_kept), DONE).union(
        rows.where("NOT has").select("id", "text", F.lit(None).cast("string").alias("spans")).mapInArrow(_finish(False, with_kept), DONE))
    return done.withColumnRenamed("id", id_col)
