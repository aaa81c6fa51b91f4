"""Fuzzy join of texts by a prefix filter on q-grams.

The ``difflib`` ratio 2 M / (|a| + |b|) can only exceed t if the texts are few insertions and
deletions apart: their number is at most |a| + |b| - 2 M < (1 - t) (|a| + |b|). With at most k of
them, at most k q of a text's q-grams are touched, so of any k q + 1 q-grams at least one
is in the other text too, less than k + 1 places away. Taking for every text the first k q + 1 of its q-grams in one order
for all (with all repeats of the last one) -- rarest in the indexed side first, so most of what is looked up is not there at
all -- two similar texts have one of those in common. What is joined is (q-gram, length
bucket): no key is a length alone, and common q-grams are in no prefix unless a text has no others.

A text so short that k edits could touch all its q-grams enters with all of them, which finds its longer
partners; two such texts meet by length and the bound by character counts. q is the largest up to
``Q`` for which long texts are not of that kind.

Every different text is joined once, whatever its copies; the ratio itself is computed for the
candidates only. The counts that give the order are kept by ``SLOTS`` hash slots: their size is fixed,
and a shared slot changes the order, never the result."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.session import cut

Q = 4
SLOTS = 1 << 16
MULTIPLIER = 1_000_003


def edits(length: int, threshold: float) -> int:
    """Most insertions and deletions a pair above ``threshold`` can be apart, if one text has ``length`` characters."""
    longest = math.floor(length * (2 - threshold) / threshold + 1e-9)
    return max(0, math.ceil((1 - threshold) * (length + longest) - 1e-9) - 1)


def _edits(n: Column, threshold: float) -> Column:
    longest = F.floor(n * F.lit((2 - threshold) / threshold) + 1e-9)
    return F.greatest(F.lit(0), F.ceil(F.lit(1 - threshold) * (n + longest) - 1e-9) - 1).cast("int")


def gram_size(threshold: float) -> int:
    """The largest q up to ``Q`` with which k q + 1 q-grams are fewer than long texts have; 1 if none is."""
    return max([q for q in range(1, Q + 1) if edits(1000, threshold) * q + 1 <= 1001 - q], default=1)


def gram_hashes(text: str, q: int) -> np.ndarray:
    """One 64-bit number per q-gram, by place; equal q-grams have equal numbers."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    n = len(codes) - q + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    return _mixed(codes, n, q)


def _mixed(codes: np.ndarray, n: int, q: int) -> np.ndarray:
    h = np.zeros(n, np.uint64)
    for j in range(q):
        h = h * np.uint64(MULTIPLIER) + codes[j:j + n]
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32)


def _slot_counts(texts: DataFrame, q: int) -> np.ndarray:
    """Occurrences of q-grams by slot, over all texts (partial aggregation; ``SLOTS`` rows come back at most)."""
    def run(batches):
        import pyarrow as pa

        total = np.zeros(SLOTS, np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                total += np.bincount((gram_hashes(t, q) % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
        slots = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(total[slots])], ["slot", "n"])

    got = texts.select("t").mapInArrow(run, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS, np.int64)
    out[got.column("slot").to_numpy()] = got.column("n").to_numpy()
    return out


def prefix(text: str, counts: np.ndarray, threshold: float, q: int) -> tuple[np.ndarray, np.ndarray]:
    """The q-grams of a text's prefix and their places; all it has if it is too short for one."""
    h = gram_hashes(text, q)
    first = edits(len(text), threshold) * q + 1
    if len(h) <= first:
        return h, np.arange(len(h))
    order = np.lexsort((h, counts[(h % np.uint64(SLOTS)).astype(np.int64)]))
    last = h[order[first - 1]]
    while first < len(h) and h[order[first]] == last:
        first += 1
    return h[order[:first]], order[:first]


def reaching(texts: list[str], counts: np.ndarray, threshold: float, q: int) -> np.ndarray:
    """Places of the texts whose prefix can hold a q-gram of the indexed side. A slot without a count has none, and such q-grams come
    first: a text with as many of them as a prefix is long has no others in it. Counted for all texts at once."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    least, size = np.unique(lengths, return_inverse=True)
    first = np.array([edits(int(n), threshold) * q + 1 for n in least], np.int64)[size]
    n = len(codes) - q + 1
    if n < 1:
        return np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(texts)), lengths)[:n]
    ends = np.cumsum(lengths)
    inside = np.arange(n) + q <= ends[owner]  # the others begin in one text and end in the next
    known = counts[(_mixed(codes, n, q) % np.uint64(SLOTS)).astype(np.int64)] > 0
    unknown = np.bincount(owner[inside & ~known], minlength=len(texts))
    some = np.bincount(owner[inside & known], minlength=len(texts)) > 0
    return np.flatnonzero(some & (unknown < first))


def _prefixes(texts: DataFrame, counts: np.ndarray, threshold: float, q: int) -> DataFrame:
    """One row per q-gram of the prefix of ``texts`` (``id``, ``t``, ``n``): ``id``, ``n``, ``g``, ``at``; q-grams that the indexed
    side has not are left out."""
    def run(batches):
        import pyarrow as pa

        for b in batches:
            b = b.take(pa.array(reaching(b.column(1).to_pylist(), counts, threshold, q)))
            found = [prefix(t, counts, threshold, q) for t in b.column(1).to_pylist()]
            if found:
                rows = np.repeat(np.arange(b.num_rows), [len(g) for g, _ in found])
                grams, places = np.concatenate([g for g, _ in found]), np.concatenate([p for _, p in found])
                known = counts[(grams % np.uint64(SLOTS)).astype(np.int64)] > 0
                rows = pa.array(rows[known])
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(2).take(rows), pa.array(grams[known].view(np.int64)),
                                                  pa.array(places[known].astype(np.int32))], ["id", "n", "g", "at"])

    return texts.select("id", "t", "n").mapInArrow(run, "id bigint, n int, g bigint, at int")


def similar_texts(left: DataFrame, right: DataFrame, threshold: float = 0.98) -> DataFrame:
    """``lt``, ``rt``, ``ratio``: the pairs of different texts of the string columns ``t`` of both sides whose ``difflib``
    ratio exceeds ``threshold`` (above 0, below 1). ``right`` is the indexed side. Null and empty texts have no partner;
    an empty side gives an empty result. Exact: no candidate is capped."""
    from evalspark.functions.udfs import ratio_above
    from evalspark.operators.textops import char_counts, ratio_bound

    if not 0 < threshold < 1:
        raise ValueError("the threshold lies above 0 and below 1")

    def texts(side: DataFrame) -> DataFrame:
        distinct = side.where(F.length("t") > 0).select("t").distinct()
        return cut(distinct.select(F.monotonically_increasing_id().alias("id"), "t", F.length("t").alias("n")))

    q, lt, rt = gram_size(threshold), texts(left), texts(right)
    counts = _slot_counts(rt, q)
    # Lengths of a pair differ by a factor below (2 - t) / t: the same bucket of that width, or the next.
    step = math.log((2 - threshold) / threshold)
    bucket = F.floor(F.log(F.col("n").cast("double")) / F.lit(step)).cast("int")
    lp = (_prefixes(lt, counts, threshold, q)
          .select(F.col("id").alias("l"), F.col("n").alias("ln"), "g", F.col("at").alias("la"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("b")))
    rp = _prefixes(rt, counts, threshold, q).select(F.col("id").alias("r"), F.col("n").alias("rn"), "g", F.col("at").alias("ra"), bucket.alias("b"))
    room = F.lit(1 - threshold) * (F.col("ln") + F.col("rn")) + 1e-9  # insertions and deletions stay below this
    near = (F.abs(F.col("ln") - F.col("rn")) < room) & (F.abs(F.col("la") - F.col("ra")) < room)
    ids = lp.join(rp, ["g", "b"]).where(near).select("l", "r").distinct()
    found = (ids.join(lt.select(F.col("id").alias("l"), F.col("t").alias("lt")), "l")
             .join(rt.select(F.col("id").alias("r"), F.col("t").alias("rt")), "r").select("lt", "rt"))

    def short(side: DataFrame, name: str) -> DataFrame:
        k = _edits(F.col("n"), threshold)
        rows = side.where(k * q + 1 > F.col("n") - q + 1)
        # Without room for an edit only the same text is a partner: it joins by itself.
        return rows.select(F.col("t").alias(name), F.col("n").alias("n_" + name), F.when(k == 0, F.col("t")).otherwise("").alias("same"))

    ls = short(lt, "lt").withColumn("n_rt", F.explode(F.sequence(F.ceil(F.col("n_lt") * F.lit(threshold / (2 - threshold)) - 1e-9).cast("int"),
                                                                 F.floor(F.col("n_lt") * F.lit((2 - threshold) / threshold) + 1e-9).cast("int"))))
    few = (ls.join(short(rt, "rt"), ["n_rt", "same"])
           .where(ratio_bound(char_counts("lt"), char_counts("rt"), F.length("lt"), F.length("rt")) > threshold).select("lt", "rt"))
    candidates = cut(found.unionByName(few).distinct())
    scored = candidates.withColumn("ratio", ratio_above(F.col("lt"), F.col("rt"), F.lit(float(threshold))))
    return scored.where(F.col("ratio") > threshold)
