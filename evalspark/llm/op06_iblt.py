"""Document fingerprints: an invertible Bloom lookup sketch of paragraph digests.

A text is cut into paragraphs at line and sentence ends (long ones also every
``PIECE`` bytes, counted from their start); each paragraph, numbered among its equals,
is a 64-bit digest in ``HASHES`` cells of count, key sum and check sum (sums are XOR).
The cells of two versions subtract, and peeling recovers the digests that differ; if
peeling stops early, both are sketched again with twice the cells. The likeness of two
texts is the share of digests they have in common, |A and B| / |A or B|."""

from __future__ import annotations

import base64
import hashlib
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE = 96
PARAGRAPH = re.compile(rb"[^\n.!?]{1,%d}(?:[.!?\n]+\s*)?|[.!?\n]+\s*" % PIECE)
HASHES = 3
CELLS = 18  # cells of the published fingerprint
PAIRS, PAIR_CHARS = 256, 4 << 20  # rows answered at once
ONE, GOLDEN = np.uint64(1), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def digests(text: str) -> np.ndarray:
    """Digests of all paragraphs; equal paragraphs differ by their number among equals."""
    import xxhash

    parts = PARAGRAPH.findall(text.encode("utf-8", "surrogatepass"))
    h64 = xxhash.xxh64_intdigest
    counts = Counter(parts)
    keys = [h64(p, i) for p, n in counts.items() for i in range(n)]
    return np.unique(np.array(keys, dtype=np.uint64))


class Sketches:
    """Sketches of many sets of 64-bit keys side by side; set ``i`` has ``HASHES * parts[i]``
    cells, so one numpy call works on all of them."""

    def __init__(self, parts: np.ndarray):
        self.parts = parts.astype(np.int64)
        self.base = np.concatenate(([0], np.cumsum(HASHES * self.parts)))
        n = int(self.base[-1])
        self.count, self.key, self.check = np.zeros(n, np.int64), np.zeros(n, np.uint64), np.zeros(n, np.uint64)

    @classmethod
    def of(cls, sets: list[np.ndarray], parts: np.ndarray) -> "Sketches":
        out = cls(parts)
        out.add(np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate(sets), 1)
        return out

    def places(self, owner: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Cell numbers, one in each third of the owner's cells, from one mixed hash."""
        part, base = self.parts[owner], self.base[owner]
        size = part.astype(np.uint64)
        h = _mix(keys ^ (size * GOLDEN))
        thirds = (h % size, _mix(h) % size, _mix(h + ONE) % size)
        return np.concatenate([t.astype(np.int64) + base + i * part for i, t in enumerate(thirds)])

    def add(self, owner: np.ndarray, keys: np.ndarray, sign) -> None:
        """Add (sign 1) or take away (sign -1) keys; ``sign`` may be one per key."""
        if len(keys):
            at = self.places(owner, keys)
            np.add.at(self.count, at, sign if np.isscalar(sign) else np.concatenate((sign,) * HASHES))
            np.bitwise_xor.at(self.key, at, np.concatenate((keys,) * HASHES))
            np.bitwise_xor.at(self.check, at, np.concatenate((_mix(keys + ONE),) * HASHES))

    def minus(self, other: "Sketches") -> "Sketches":
        d = Sketches(self.parts)
        d.count, d.key, d.check = self.count - other.count, self.key ^ other.key, self.check ^ other.check
        return d

    def take(self, which: np.ndarray) -> "Sketches":
        out = Sketches(self.parts[which])
        cells = np.repeat(self.base[which] - out.base[:-1], HASHES * out.parts) + np.arange(len(out.count))
        out.count, out.key, out.check = self.count[cells], self.key[cells], self.check[cells]
        return out

    def sizes(self) -> np.ndarray:
        """Estimated number of keys in each difference: over a third of the cells, the squares
        of the counts' deviations from their mean add up to about that number."""
        thirds = (self.base[:-1, None] + np.arange(HASHES) * self.parts[:, None]).ravel()
        total, squares = np.add.reduceat(self.count, thirds), np.add.reduceat(self.count ** 2, thirds)
        spread = squares - total ** 2 / np.repeat(self.parts, HASHES)
        return spread.reshape(-1, HASHES).mean(axis=1).astype(np.int64)

    def peel(self, check_mask: np.uint64 = ~np.uint64(0)) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Empties the sketches: which were emptied, and owner, key and sign (1: only in the
        first set) of all that was found. ``check_mask``: the bits of the check sums that are known."""
        cell_owner = np.repeat(np.arange(len(self.parts)), HASHES * self.parts)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        look = np.arange(len(self.count))
        while True:
            at = look[np.abs(self.count[look]) == 1]
            at = at[((_mix(self.key[at] + ONE) ^ self.check[at]) & check_mask) == 0]
            if not len(at):
                break
            owner, key, sign = cell_owner[at], self.key[at], self.count[at]
            order = np.lexsort((key, owner))  # a key may stand alone in several cells: once is enough
            owner, key, sign = owner[order], key[order], sign[order]
            new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])))
            owner, key, sign = owner[new], key[new], sign[new]
            self.add(owner, key, -sign)
            found.append((owner, key, sign))
            look = np.unique(self.places(owner, key))
        rest = np.add.reduceat(((self.count != 0) | (self.key != 0)).astype(np.int64), self.base[:-1])
        return rest == 0, *(np.concatenate(x) for x in zip(*found))

    def text(self, i: int, n: int) -> str:
        own = slice(int(self.base[i]), int(self.base[i + 1]))
        raw = (np.array([n], "<u4").tobytes() + self.count[own].astype("<i2").tobytes() + self.key[own].astype("<u8").tobytes()
               + self.check[own].astype("<u4").tobytes())
        return base64.b64encode(raw).decode("ascii")


def decode(fingerprint: str) -> tuple[int, Sketches]:
    """Number of paragraphs and the sketch of a published fingerprint; ValueError if it is none."""
    raw, cells = base64.b64decode(fingerprint, validate=True), CELLS // HASHES * HASHES
    if len(raw) != 4 + 14 * cells:
        raise ValueError("no fingerprint of this size")
    s = Sketches(np.array([CELLS // HASHES]))
    s.count = np.frombuffer(raw, "<i2", cells, 4).astype(np.int64)
    s.key = np.frombuffer(raw, "<u8", cells, 4 + 2 * cells).astype(np.uint64)
    s.check = np.frombuffer(raw, "<u4", cells, 4 + 10 * cells).astype(np.uint64)
    return int(np.frombuffer(raw, "<u4", 1)[0]), s


def fingerprint_difference(a: str, b: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Paragraph digests only in ``a`` and only in ``b``, from the fingerprints alone; None where they differ in more
    than their cells can tell (then the texts are needed, see ``changed_paragraphs``)."""
    low = np.uint64(0xFFFFFFFF)
    (_, x), (_, y) = decode(a), decode(b)
    d = x.minus(y)
    d.check &= low
    done, _, key, sign = d.peel(check_mask=low)
    return (np.sort(key[sign == 1]), np.sort(key[sign == -1])) if done[0] else None


def changed_paragraphs(old: DataFrame, new: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Two versions of a table: for every id, ``n_old``, ``n_new`` (paragraphs), ``removed`` and ``added`` (sorted arrays of the 64-bit digests, signed, of the
    paragraphs that only the old, only the new version has). Sketches of both versions subtract and peel, larger ones
    where that fails, for as many rows at once as ``PAIRS``.

    An id that one version lacks has an empty text there, as null texts count. Of several texts of an id the smallest
    counts. Null ids are one id. Empty tables give an empty result; other columns are not read."""
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(F.col(id_col).alias("id")).agg(F.min(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias(name))

    left, right = side(old, "a"), side(new, "b").withColumnRenamed("id", "id2")
    both = left.join(right, F.col("id").eqNullSafe(F.col("id2")), "full").select(F.coalesce("id", "id2").alias("id"), F.coalesce("a", F.lit("")).alias("a"), F.coalesce("b", F.lit("")).alias("b"))

    def run(batches):
        import pyarrow as pa

        def signed(some):
            ends = np.concatenate(([0], np.cumsum([len(x) for x in some]))).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *(np.sort(x.view(np.int64)) for x in some)])))

        for whole in batches:
            for at in range(0, whole.num_rows, PAIRS):
                b = whole.slice(at, PAIRS)
                x, y = ([digests(t) for t in b.column(i).to_pylist()] for i in (1, 2))
                found = differences(x, y)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(v) for v in x], pa.int64()), pa.array([len(v) for v in y], pa.int64()),
                                                  signed([p for p, _ in found]), signed([q for _, q in found])], ["id", "n_old", "n_new", "removed", "added"])

    kind = old.schema[id_col].dataType.simpleString()
    return both.mapInArrow(run, f"id {kind}, n_old bigint, n_new bigint, removed array<bigint>, added array<bigint>").withColumnRenamed("id", id_col)


def first_sketches(sets: list[np.ndarray]) -> Sketches:
    return Sketches.of(sets, np.full(len(sets), CELLS // HASHES))


def differences(a: list[np.ndarray], b: list[np.ndarray], d: Sketches | None = None):
    """For every pair of sets the digests only in the first and only in the second, by
    subtracting and peeling sketches (``d``: the subtracted smallest ones). Pairs whose
    peeling stops early are sketched again with more cells: at least twice as many, and
    as many as the estimated size of the difference calls for."""
    if not a:
        return []
    d = d or first_sketches(a).minus(first_sketches(b))
    out: list = [None] * len(a)
    open_pairs = np.arange(len(a))
    counts = np.array([abs(len(x) - len(y)) for x, y in zip(a, b)])
    while len(open_pairs):
        size = np.maximum(d.sizes(), counts[open_pairs])
        cells = HASHES * d.parts
        able = np.flatnonzero(size <= cells)  # the others hold more than peeling can find
        done = np.zeros(len(open_pairs), bool)
        if len(able):
            ok, owner, key, sign = d.take(able).peel()
            done[able[ok]] = True
            keep = ok[owner]
            owner, key, sign = owner[keep], key[keep], sign[keep]
            order = np.argsort(owner, kind="stable")
            owner, key, sign = owner[order], key[order], sign[order]
            cut = np.searchsorted(owner, np.arange(len(able) + 1))
            for i in np.flatnonzero(ok):
                k, s = key[cut[i]:cut[i + 1]], sign[cut[i]:cut[i + 1]]
                out[open_pairs[able[i]]] = (k[s == 1], k[s == -1])
        more = np.maximum(2 * cells, size + size // 2)[~done]
        open_pairs = open_pairs[~done]
        if len(open_pairs):
            parts = -(-more // HASHES)
            d = Sketches.of([a[i] for i in open_pairs], parts).minus(Sketches.of([b[i] for i in open_pairs], parts))
    return out


def differing(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digests only in ``a`` and only in ``b``."""
    return differences([a], [b])[0]


def likenesses(a: list[np.ndarray], b: list[np.ndarray], d: Sketches | None = None) -> list[float]:
    """|A and B| / |A or B| of every pair; 1 for two empty texts."""
    return [(len(x) - len(only)) / (len(y) + len(only)) if len(y) + len(only) else 1.0
            for x, y, (only, _) in zip(a, b, differences(a, b, d))]


def edited_text(text: str, following: str) -> str:
    """The last half (rounded down) of the characters replaced by as many of the next text's first."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


SCHEMA = ("n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def pair_facts(texts: list[str], following: list[str]) -> list[tuple]:
    """The results of some rows; ``following``: the text after each."""
    changed = [edited_text(t, f) for t, f in zip(texts, following)]
    mine, other, theirs = ([digests(t) for t in some] for some in (texts, changed, following))
    first, second, third = first_sketches(mine), first_sketches(other), first_sketches(theirs)
    near_edited = likenesses(mine, other, first.minus(second))
    near_next = likenesses(mine, theirs, first.minus(third))
    return [(len(t), hashlib.sha256(c.encode("utf-8", "surrogatepass")).hexdigest(), first.text(i, len(mine[i])),
             second.text(i, len(other[i])), near_edited[i], near_next[i]) for i, (t, c) in enumerate(zip(texts, changed))]


def _walk(batches):
    """Rows sorted by bucket and id; the last row of a bucket is a guest, the first row of
    the next one. Every row but the guests is answered when the row after it is seen."""
    import pyarrow as pa

    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    before = None  # bucket, id, text

    def answered(rows, kind):
        cols = list(zip(*((i, *f) for (i, _, _), f in zip(rows, pair_facts([r[1] for r in rows], [r[2] for r in rows])))))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), pa.array(cols[1], pa.int64()),
                                           *(pa.array(c) for c in cols[2:5]), *(pa.array(c, pa.float64()) for c in cols[5:])], names)

    for b in batches:
        kind, rows, size = b.column(2).type, [], 0
        for bucket, guest, key, text in zip(*(b.column(i).to_pylist() for i in range(4))):
            if before is not None and before[0] == bucket:
                rows.append((before[1], before[2], text))
                size += len(before[2]) + len(text)
                before = None if guest else (bucket, key, text)
            elif not guest:
                before = (bucket, key, text)
            # else: a further row of a guest's id, the bucket is done
            if len(rows) == PAIRS or size > PAIR_CHARS:
                yield answered(rows, kind)
                rows, size = [], 0
        if rows:
            yield answered(rows, kind)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``,
    ``near_edited``, ``near_next``.

    The next document is the next one in ascending id order; after the last comes the
    first. Null ids come first; rows with equal ids are ordered by their text, and a
    document that is alone is its own next. Null text counts as empty. An empty table
    gives an empty result. Ids must be integers.

    Rows are spread over id ranges whose bounds are quantiles (a few per shuffle
    partition), so the text is shuffled once; a range learns its successor from a copy
    of the next range's first row."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = rows.agg(F.percentile_approx("id", F.array(*[F.lit(i / n) for i in range(1, n)]), 10_000)).first()[0]
    bounds = np.unique(np.array(got or [], dtype=np.int64))

    @F.pandas_udf("int")
    def bucket_of(ids: pd.Series) -> pd.Series:
        known = ids.notna()
        place = np.zeros(len(ids), np.int32)
        place[known.to_numpy()] = np.searchsorted(bounds, ids[known].to_numpy().astype(np.int64), side="right")
        return pd.Series(place)

    rows = rows.withColumn("bucket", bucket_of("id"))
    heads = sorted((r["bucket"], r["head"][0]) for r in rows.groupBy("bucket").agg(F.min(F.struct("id")).alias("head")).collect())
    guests = [(h, heads[i - 1][0]) for i, (_, h) in enumerate(heads)]  # a row for each range, whatever the input
    named = F.broadcast(spark.createDataFrame(guests, "head long, target int"))
    visiting = (rows.select("id", "text").join(named, F.col("id").eqNullSafe(F.col("head")))
                .select(F.col("target").alias("bucket"), F.lit(True).alias("guest"), "id", "text"))
    both = rows.select("bucket", F.lit(False).alias("guest"), "id", "text").union(visiting)
    walked = both.repartition("bucket").sortWithinPartitions("bucket", "guest", "id", "text").mapInArrow(_walk, f"id bigint, {SCHEMA}")
    return walked.withColumnRenamed("id", id_col)
