"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints are compared only inside buckets that agree on ``blocks - radius`` of
``blocks`` bit blocks: by the pigeonhole rule two fingerprints within the radius
share at least one bucket, so no link is lost. Equal fingerprints are one row
before any bucket is built, and a bucket holds at most two to the power of the
free bits, whatever the number of documents. Inside the buckets the 64 bit planes
lie vertically (one bit per lane) and the distances of all lanes to the lane ``d``
further on are summed plane by plane in carry-save counters; words whose lanes are
all beyond the radius, in another bucket or already joined are abandoned."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import cut, spare, stored
from evalspark.operators.components import connected_components

FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
SHINGLE_BLOCK = 1 << 16


def fingerprint_of(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of one text, unsigned. ASCII lower case, words between white
    space; a bit is 1 if set in over half the shingle hashes. No words: 0."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    h64, join = xxhash.xxh64_intdigest, b" ".join
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, SHINGLE_BLOCK):
        part = words[at:at + SHINGLE_BLOCK + shingle - 1]
        rows = zip(*(part[i:] for i in range(shingle))) if len(words) >= shingle else [words]
        h = np.array([h64(s, seed) for s in map(join, rows)], dtype=np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = 3, seed: int = 42) -> DataFrame:
    """``id``, ``fp`` (the fingerprint's bits as a signed long), one row per input row."""
    def run(batches):
        import pyarrow as pa
        for b in batches:
            fps = np.array([fingerprint_of(t, shingle, seed) for t in b.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(run, f"id {kind}, fp bigint")


def block_masks(radius: int, blocks: int) -> list[int]:
    """Masks of the ``blocks - radius`` blocks a bucket agrees on, one per choice."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    part = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(part, blocks - radius)]


def _planes(fp: np.ndarray, pad: int) -> np.ndarray:
    """(64, words) bit planes: bit ``i`` of plane ``b`` is bit ``b`` of lane ``i``."""
    words = -(-len(fp) // 64) + pad
    bits = np.zeros((words * 64, 64), np.uint8)
    bits[:len(fp)] = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def _lanes(flags: np.ndarray, words: int) -> np.ndarray:
    out = np.zeros(words * 64, np.uint8)
    out[:len(flags)] = flags
    return np.packbits(out, bitorder="little").view("<u8")


def _exceeds(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose binary counter is above ``radius`` (last plane: overflow, sticky)."""
    above, equal = np.zeros_like(counter[0]), np.full_like(counter[0], FULL)
    for j in range(len(counter) - 2, -1, -1):
        if radius >> j & 1:
            equal = equal & counter[j]
        else:
            above = above | (equal & counter[j])
            equal = equal & ~counter[j]
    return above | counter[-1]


def close_lanes(planes: np.ndarray, open_lanes: np.ndarray, d: int, radius: int) -> np.ndarray:
    """Positions ``i`` among the open lanes with distance(lane i, lane i + d) <= radius."""
    q, r = divmod(d, 64)
    idx = np.flatnonzero(open_lanes)
    live = open_lanes[idx]
    counter = [np.zeros(len(idx), np.uint64) for _ in range(radius.bit_length() + 1)]
    for b in range(64):
        p = planes[b]
        far = p[idx + q] if r == 0 else (p[idx + q] >> np.uint64(r)) | (p[idx + q + 1] << np.uint64(64 - r))
        carry = p[idx] ^ far
        for j in range(len(counter) - 1):
            counter[j], carry = counter[j] ^ carry, counter[j] & carry
        counter[-1] |= carry
        if b % 8 == 7:
            live = live & ~_exceeds(counter, radius)
            keep = np.flatnonzero(live)
            if len(keep) < len(idx):
                idx, live, counter = idx[keep], live[keep], [c[keep] for c in counter]
            if not len(idx):
                return np.zeros(0, np.int64)
    word, bit = np.nonzero(np.unpackbits(live.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return idx[word] * 64 + bit


def forest(fp: np.ndarray, group: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links (positions) that join all members of a group which are reachable by
    steps within ``radius``; ``group`` is sorted. At most n - 1 links per group."""
    n = len(fp)
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if n else np.zeros(0, int)
    size = np.diff(np.r_[start, n])
    size_at = np.repeat(size, size)
    parent, links = np.arange(n), []
    if n < 2:
        return links
    planes = _planes(fp, int(size.max()) // 64 + 2)

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = int(parent[x])
        return x

    for d in range(1, int(size.max())):
        same = (group[d:] == group[:-d]) & (size_at[:-d] > d) & (parent[d:] != parent[:-d])
        if not same.any():
            continue
        hits = close_lanes(planes, _lanes(same, planes.shape[1]), d, radius)
        for i in hits.tolist():
            x, y = find(i), find(i + d)
            if x != y:
                parent[max(x, y)] = min(x, y)
                links.append((i, i + d))
        if len(hits):
            while True:
                up = parent[parent]
                if (up == parent).all():
                    break
                parent = up
    return links


def _bucket_links(radius: int):
    def run(batches):
        import pyarrow as pa

        def out(t, k, fp):
            g = np.cumsum(np.r_[0, (t[1:] != t[:-1]) | (k[1:] != k[:-1])]) if len(t) else t
            many = np.bincount(g)[g] > 1 if len(g) else np.zeros(0, bool)
            fp, g = fp[many], g[many]
            links = forest(fp.view(np.uint64), g, radius) if len(fp) else []
            a = np.array([x for x, _ in links], dtype=np.int64)
            b = np.array([y for _, y in links], dtype=np.int64)
            return pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], ["a", "b"])

        held = [np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        for x in batches:
            held = [np.concatenate([h, x.column(i).to_numpy()]) for i, h in enumerate(held)]
            t, k, fp = held
            if len(t) < 1 << 16 and len(t):  # gather some more whole buckets first
                continue
            last = np.flatnonzero((t != t[-1]) | (k != k[-1]))
            done = int(last[-1]) + 1 if len(last) else 0
            if done:
                yield out(t[:done], k[:done], fp[:done])
                held = [h[done:] for h in held]
        if len(held[0]):
            yield out(*held)
    return run


def fingerprint_links(fps: DataFrame, radius: int = 2, blocks: int = 6) -> DataFrame:
    """``a``, ``b``: links between distinct fingerprints of column ``fp`` that connect
    exactly the pairs reachable by steps of at most ``radius`` differing bits."""
    masks = block_masks(radius, blocks)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in signed])
    return (fps.select("fp", F.posexplode(keys).alias("t", "k"))
            .select("t", "k", "fp").repartition("t", "k").sortWithinPartitions("t", "k")
            .mapInArrow(_bucket_links(radius), "a bigint, b bigint").distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = 3, radius: int = 2, blocks: int = 6, seed: int = 42) -> DataFrame:
    """One row per input row: id, ``fingerprint`` (16 hex digits), ``component_id`` (the
    smallest id reachable over links of at most ``radius`` differing bits).

    Null and empty texts have fingerprint zero and link like any other. Rows with a
    null id belong to a component but never name it; a component with null ids only
    has a null ``component_id``. Repeated rows stay repeated. An empty table gives an
    empty result; other columns are not read."""
    fp = stored(fingerprints(docs, id_col, text_col, shingle, seed), "simhash")
    nodes = cut(fp.groupBy("fp").agg(F.min("id").alias("least")))
    comp = connected_components(fingerprint_links(nodes.select("fp"), radius, blocks))
    comp = comp.select(F.col("node").alias("fp"), "root")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = nodes.join(comp, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = cut(named)
    least = named.groupBy("root").agg(F.min("least").alias("component_id")).repartition(n)
    named = cut(named.join(least, "root").select("fp", "component_id"))
    return (fp.join(named, "fp")
            .select(F.col("id").alias(id_col),
                    F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                         shingle: int = 3, radius: int = 2, blocks: int = 6) -> DataFrame:
    """The rows of ``docs`` whose id names their component: one document of each group
    stays, with all its columns (rows that share its id stay together). Rows with a null id stay only if their whole group
    has null ids, and then all of them do (nothing tells them apart)."""
    near, kept = near_duplicates(docs, id_col, text_col, shingle, radius, blocks), spare("_kept_id", docs)
    keep = (near.where(F.col(id_col).eqNullSafe(F.col("component_id")))
            .select(F.col(id_col).alias(kept)).distinct())
    return docs.join(keep, F.col(id_col).eqNullSafe(F.col(kept)), "left_semi")
