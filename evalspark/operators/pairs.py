"""Exact pairs of balls that touch: blocks of points against blocks of points.

Distances between random directions in many dimensions are nearly all the same, so little can be
ruled out by pivots and nearly every pair has to be looked at. What must not grow with the pairs is what is shuffled and what a task
holds. Points are dealt into blocks of at most about ``size`` points (by radius, then by distance to the first pivot),
so each point goes to one task per block, not to one per handful of points: about 8 copies, or one per ``BLOCK_BYTES`` of vectors
where there are more blocks. Pairs of blocks that the distances to the pivots rule out are not
compared. A task screens its pair of blocks by one matrix product per strip of rows, with room for rounding, and computes the distance
of what is left term by term, in the order and precision of :func:`vectors.euclid`. Nothing is dropped or capped."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.operators.vectors import as_double_array, euclid
from evalspark.session import cut

PIVOTS = 6
BLOCK_BYTES = 1 << 24  # of the vectors of a block
BLOCKS, LEAST = 8, 1024  # blocks at least, unless they had fewer points than that
BANDS = 64  # of the distance to the first pivot; a band with more points is cut by row number
STRIP = 1 << 21  # pairs that are screened at once
SLACK = 1e-9


def _strips(x: np.ndarray, rx: np.ndarray, y: np.ndarray, ry: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in ``x`` and ``y`` and distances of the pairs no further apart than the sum of their radii; of a block with itself each pair
    once."""
    with np.errstate(all="ignore"):  # what overflows is not screened out
        # |a|^2 + |b|^2 - 2 a b - (ra + rb)^2 as one product; the norms are made smaller by more than it can be off.
        room = (x.shape[1] + 16) * 1e-15

        def norms(v, r):
            n = np.einsum("ij,ij->i", v, v)
            return n - r * r - room * (n + r * r)

        a = np.column_stack([-2 * x, norms(x, rx), np.ones(len(x)), -2 * rx])
        b = np.column_stack([y, np.ones(len(y)), norms(y, ry), ry]).T
        step = max(1, STRIP // max(1, len(y)))
        xt, yt = x.T.copy(), y.T.copy()
        for at in range(0, len(x), step):
            least = at + 1 if same else 0
            i, j = np.nonzero(~(a[at:at + step] @ b[:, least:] > 0))
            i, j = i + at, j + least
            if same:
                keep = i < j
                i, j = i[keep], j[keep]
            for k in range(0, len(i), 1 << 17):
                p, q = i[k:k + (1 << 17)], j[k:k + (1 << 17)]
                d = np.zeros(len(p))
                for u, v in zip(xt, yt, strict=True):
                    t = u[p] - v[q]
                    d += t * t
                d = np.sqrt(d)
                ok = d <= rx[p] + ry[q]
                if ok.any():
                    yield p[ok], q[ok], d[ok]


def _block_pair(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids: list[list] = [[], []]
    vectors: list[list] = [[], []]
    radii: list[list] = [[], []]
    for b in batches:
        right = b.column("right").to_numpy(zero_copy_only=False)
        for side in (0, 1):
            mine = b.filter(pa.array(right == bool(side)))
            if mine.num_rows:
                ids[side].append(mine.column("id"))
                vectors[side].append(mine.column("v").flatten().to_numpy(zero_copy_only=False).reshape(mine.num_rows, -1))
                radii[side].append(mine.column("r").to_numpy(zero_copy_only=False))
    same = key[0].as_py() == key[1].as_py()
    other = 0 if same else 1
    if not ids[0] or not ids[other]:
        return
    names = [pa.concat_arrays(x) if x else None for x in ids]
    arrays = [np.concatenate(x) if x else None for x in vectors]
    sizes = [np.concatenate(x) if x else None for x in radii]
    for p, q, d in _strips(arrays[0], sizes[0], arrays[other], sizes[other], same):
        yield pa.RecordBatch.from_arrays([names[0].take(pa.array(p)), names[other].take(pa.array(q)), pa.array(d)], ["i", "j", "dist"])


def touching(points: DataFrame, pid: str, vec: str, radius: Column, n_pivots: int = PIVOTS, size: int | None = None) -> DataFrame:
    """``i`` < ``j`` (ids), ``dist``: every pair of rows with different ids whose Euclidean distance is at most the sum of their radii.
    Rows with a null id or radius, a null vector or a null in it have no partner, nor have vectors of different lengths."""
    pts = points.select(F.col(pid).alias("id"), as_double_array(vec).alias("v"), radius.cast("double").alias("r"))
    pts = pts.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.isnan("r") & ~F.exists("v", lambda x: x.isNull()))
    # Radii of a class differ by a factor of two at most: a large ball does not widen the search among small ones.
    kind = F.when(F.col("r") > 0, F.floor(F.log2("r"))).otherwise(-1100).cast("int")
    pts = cut(pts.withColumns({"dim": F.size("v"), "class": kind, "row": F.monotonically_increasing_id()}))
    piv = pts.orderBy(F.xxhash64("id", F.lit(17)), "id").limit(n_pivots).agg(F.collect_list("v")).scalar()
    pts = pts.withColumn("_piv", piv).withColumn("pd", F.transform("_piv", lambda p: euclid("v", p))).drop("_piv")
    n, dim = pts.agg(F.count(F.lit(1)), F.max("dim")).first()
    if size is None:
        size = max(LEAST, min(-(-n // BLOCKS), BLOCK_BYTES // (8 * max(1, dim or 1))))
    first = F.coalesce(F.get("pd", F.lit(0)), F.lit(0.0))
    edges = F.percentile_approx(first, [k / BANDS for k in range(1, BANDS)], 1000)
    classes = cut(pts.groupBy("dim", "class").agg(F.least(F.lit(BANDS), F.ceil(F.count(F.lit(1)) / size)).alias("bands"), edges.alias("edges")))
    rank = F.size(F.filter("edges", lambda x: x <= first))
    banded = pts.join(F.broadcast(classes), ["dim", "class"]).withColumn("band", F.floor(rank * F.col("bands") / BANDS)).drop("bands", "edges")
    tiles = cut(banded.groupBy("dim", "class", "band").agg(F.ceil(F.count(F.lit(1)) / size).alias("tiles")))
    tile = F.pmod(F.xxhash64("row"), F.col("tiles"))
    dealt = banded.join(F.broadcast(tiles), ["dim", "class", "band"]).withColumn("block", F.concat_ws("/", "dim", "class", "band", tile))
    # Pairs of blocks: those that no pivot rules out.
    blocks = cut(dealt.groupBy("block").agg(
        F.first("dim").alias("dim"), F.max("r").alias("most"),
        F.array(*[F.struct(F.min(F.get("pd", F.lit(k))).alias("lo"), F.max(F.get("pd", F.lit(k))).alias("hi")) for k in range(n_pivots)]).alias("rings")))
    p, q = (blocks.select("dim", F.col("block").alias(s), F.col("most").alias(f"most_{s}"), F.col("rings").alias(f"rings_{s}")) for s in "pq")
    reach = F.col("most_p") + F.col("most_q")
    gaps = F.zip_with("rings_p", "rings_q", lambda a, b: F.greatest(a["lo"] - b["hi"], b["lo"] - a["hi"]) - SLACK * (1 + F.abs(a["hi"]) + F.abs(b["hi"])))
    apart = F.exists(gaps, lambda g: F.coalesce((g > reach) & (g < float("inf")), F.lit(False)))
    near = cut(p.join(q, "dim").where((F.col("p") <= F.col("q")) & ~apart).select("p", "q"))
    sides = near.select(F.col("p").alias("block"), "p", "q", F.lit(False).alias("right")).unionByName(
        near.where("p < q").select(F.col("q").alias("block"), "p", "q", F.lit(True).alias("right")))
    kind_of_id = pts.schema["id"].dataType.simpleString()
    found = dealt.select("block", "id", "v", "r").join(sides, "block").groupBy("p", "q").applyInArrow(
        _block_pair, f"i {kind_of_id}, j {kind_of_id}, dist double")
    return found.where("i <> j").select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "dist")
