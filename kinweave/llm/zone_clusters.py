"""Clusters around centroids, with zone maps over vectors in the order of a Hilbert curve.

Vectors are laid out once: sorted along a Hilbert curve through a grid over all components, cut into
blocks of consecutive ones and written with each block's least and largest components (its box). In every
round a task first bounds, from the box alone, how far each centroid is from any vector of the block;
centroids that some other one beats everywhere in the box are no candidates. Only candidates are compared
with the vectors themselves; a block with one candidate is not compared at all, and adds the sum that its
layout has stored.

Components are integers, ``floor(scale * x)``, so distances, sums and means are exact and do not depend on
the layout. Between rounds a few numbers for each centroid and component reach the driver, summed up by Spark.

A vector takes part if it has exactly ``dim`` components, none of them null or not finite, and the squared
length of its integer form is at most 2^60, since the squared distances of longer ones do not fit a long.
Others have no row in the result. Repeated rows take part as often as they occur; of equal distances the
smaller centroid number wins; vectors equal in the starting order follow their stored bytes. Fewer vectors than
centroids give as many centroids as there are vectors, an empty table an empty result. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from kinweave.operators.skew import cut, drop_cut

#: Vectors in a block.
BLOCK = 512
#: Bits for a component on the grid that the curve runs through.
BITS = 4
#: Boxes with components beyond this are not bounded but compared in full, as their bounds might not fit a long.
WIDE = 1 << 25
LONGEST = 1 << 60


# ------------------------------------------------------------------ layout ----


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows that hold ``dim`` components, as a matrix with nan for null, and which rows these are."""
    column = column.cast(pa.large_list(pa.float64()))
    length = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False).astype(float), nan=-1)
    fits = np.flatnonzero(length == dim)
    values = column.take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False)
    return values.reshape(-1, dim), fits


def fixed_point(vectors: DataFrame, vec_id: str, embedding: str, dim: int, scale: int) -> DataFrame:
    """(vec_id, vector): the vectors that take part, as little-endian 32-bit integers."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, row = _matrix(batch.column(1), dim)
            with np.errstate(over="ignore", invalid="ignore"):
                x = np.floor(scale * x)
                good = np.isfinite(x).all(axis=1) & (np.einsum("ij,ij->i", x, x) <= 2 * LONGEST)
            x, row = x[good].astype(np.int64), row[good]
            good = np.einsum("ij,ij->i", x, x) <= LONGEST
            x, row = x[good].astype("<i4"), row[good]
            data = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * dim), len(x), [None, pa.py_buffer(np.ascontiguousarray(x))])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), data.cast(pa.binary())], ["vec_id", "vector"])

    kind = vectors.schema[vec_id].dataType.simpleString()
    plain = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    return plain.mapInArrow(convert, f"vec_id {kind}, vector binary")


def _read(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors of a binary column as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, dim)


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of each row of grid cells, as big-endian bytes that sort in the curve's order.

    Bit planes are worked on from the highest down for all rows at once: where a component has its
    bit set the lower bits of the first one are flipped, else they are exchanged with its own (the
    transposed form of the curve); a Gray code over the planes then gives the place.
    """
    x = cells.astype(np.uint32).T.copy()
    top = np.uint32(1 << (bits - 1))
    plane = top
    while plane > 1:
        low = plane - np.uint32(1)
        for i in range(len(x)):
            is_set = (x[i] & plane) != 0
            changed = np.where(is_set, low, (x[0] ^ x[i]) & low)
            x[0] ^= changed
            x[i] ^= np.where(is_set, np.uint32(0), changed)
        plane >>= np.uint32(1)
    x = np.bitwise_xor.accumulate(x, axis=0)
    flip = np.zeros_like(x[0])
    plane = top
    while plane > 1:
        flip ^= np.where(x[-1] & plane, plane - np.uint32(1), np.uint32(0))
        plane >>= np.uint32(1)
    x ^= flip
    planes = [(x >> np.uint32(b)) & np.uint32(1) for b in reversed(range(bits))]
    return np.packbits(np.concatenate(planes).T.astype(np.uint8), axis=1)


def _spread(fixed: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of each component: sums by task, added up by Spark, ``dim`` rows here."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, np.zeros(dim), np.zeros(dim)
        for batch in batches:
            x = _read(batch.column(0), dim).astype(float)
            n, s, q = n + len(x), s + x.sum(axis=0), q + (x * x).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"at": np.arange(dim, dtype=np.int32), "n": np.full(dim, n, np.int64), "s": s, "q": q})

    rows = fixed.select("vector").mapInArrow(sums, "at int, n long, s double, q double") \
        .groupBy("at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).orderBy("at").collect()
    n = max(1, rows[0]["n"]) if rows else 1
    mean = np.array([r["s"] for r in rows] or [0.0] * dim) / n
    square = np.array([r["q"] for r in rows] or [0.0] * dim) / n
    return mean, np.sqrt(np.maximum(square - mean * mean, 1e-12))


def zone_blocks(fixed: DataFrame, dim: int) -> DataFrame:
    """(ids, vectors, low, high, total): blocks of consecutive vectors along the curve, with box and sum.

    One range shuffle; a place that very many vectors share is dealt to several tasks by row number.
    """
    mean, spread = _spread(fixed, dim)
    kind = fixed.schema["vec_id"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = (_read(batch.column(1), dim) - mean) / spread * (1 << BITS) / 4 + (1 << (BITS - 1))
            key = hilbert_keys(np.clip(at, 0, (1 << BITS) - 1), BITS)
            data = pa.FixedSizeBinaryArray.from_buffers(pa.binary(key.shape[1]), len(key), [None, pa.py_buffer(np.ascontiguousarray(key))])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), data.cast(pa.binary())], ["vec_id", "vector", "place"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, BLOCK):
                part = batch.slice(begin, BLOCK)
                x = _read(part.column(1), dim)
                yield pa.RecordBatch.from_arrays([
                    pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), part.column(0)), pa.array([x.tobytes()], pa.binary()),
                    *[pa.array([v.astype("<i8").tobytes()], pa.binary()) for v in (x.min(axis=0), x.max(axis=0), x.sum(axis=0, dtype=np.int64))],
                ], ["ids", "vectors", "low", "high", "total"])

    placed = fixed.mapInArrow(place, f"vec_id {kind}, vector binary, place binary")
    ranged = placed.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange("place", "_row").sortWithinPartitions("place")
    return ranged.select("vec_id", "vector").mapInArrow(gather, f"ids array<{kind}>, vectors binary, low binary, high binary, total binary")


# ------------------------------------------------------------------ rounds ----


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that may be nearest to some point of the box.

    ``d(x, c) - d(x, b)`` is linear in x, so its least value over the box is exact; a centroid for which it is
    above 0 is farther than ``b`` from every point. ``b`` is the centroid with the smallest upper bound of its distance.
    """
    if max(np.abs(low).max(), np.abs(high).max(), np.abs(centroids).max()) > WIDE:
        return np.arange(len(centroids))
    farthest = np.maximum((centroids - low) ** 2, (centroids - high) ** 2).sum(axis=1)
    nearest = (np.maximum(np.maximum(low - centroids, centroids - high), 0) ** 2).sum(axis=1)
    b = int(np.argmin(farthest))
    slope = 2 * (centroids[b] - centroids)
    least = np.where(slope > 0, slope * low, slope * high).sum(axis=1) + (centroids**2).sum(axis=1) - (centroids[b] ** 2).sum()
    return np.flatnonzero((nearest <= farthest[b]) & (least <= 0))


def compared(x: np.ndarray, which: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest candidate and squared distance of each vector; of equal ones the smallest number."""
    distance = np.stack([((x - centroids[k]) ** 2).sum(axis=1) for k in which], axis=1)
    best = np.argmin(distance, axis=1)
    return which[best], distance[np.arange(len(x)), best]


def _boxes(batch: pa.RecordBatch, names: tuple[str, ...]) -> Iterator[tuple]:
    for row in zip(*[batch.column(n).to_pylist() for n in names], strict=True):
        yield tuple(np.frombuffer(v, "<i8") for v in row)


def _sums(centroids: np.ndarray, inertia: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each task and centroid: the sums of the components, the number of vectors and, if asked, the sum of distances."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [[0] * (dim + 2) for _ in range(k)]
        for batch in batches:
            for i, (low, high, whole) in enumerate(_boxes(batch, ("low", "high", "total"))):
                data = batch.column("vectors")[i].as_buffer()
                which = candidates(low, high, centroids)
                if len(which) == 1 and not inertia:
                    found = [(which[0], whole, data.size // (4 * dim), 0)]
                else:
                    x = np.frombuffer(data, "<i4").reshape(-1, dim).astype(np.int64)
                    mine, distance = compared(x, which, centroids)
                    found = [(c, x[mine == c].sum(axis=0), int((mine == c).sum()), sum(distance[mine == c].tolist())) for c in np.unique(mine)]
                for c, parts, n, far in found:
                    total[c] = [a + b for a, b in zip(total[c], [*parts.tolist(), n, far], strict=True)]
        rows = [(c, at, v) for c in range(k) for at, v in enumerate(total[c]) if total[c][dim]]
        yield pa.RecordBatch.from_arrays([
            pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
            pa.array([r[2] for r in rows], pa.decimal128(38, 0))], ["cluster", "at", "value"])

    return run


def totals(blocks: DataFrame, centroids: np.ndarray, inertia: bool = False) -> dict[int, list[int]]:
    """By cluster: its summed components, its size, its inertia. ``k * (dim + 2)`` numbers reach the driver."""
    found = blocks.select("vectors", "low", "high", "total").mapInArrow(_sums(centroids, inertia), "cluster int, at int, value decimal(38,0)")
    out = {}
    for r in found.groupBy("cluster", "at").agg(F.sum("value").alias("value")).collect():
        out.setdefault(r["cluster"], [0] * (centroids.shape[1] + 2))[r["at"]] = int(r["value"])
    return out


def moved(centroids: np.ndarray, sums: dict[int, list[int]]) -> np.ndarray:
    """Each centroid at the floored mean of its vectors; those without any stay."""
    out = centroids.copy()
    for c, values in sums.items():
        out[c] = [v // values[-2] for v in values[:-2]]
    return out


def cluster(
    vectors: DataFrame, order: Column, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024,
    vec_id: str = "vec_id", embedding: str = "embedding",
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid): every vector with its nearest centroid.

    The centroids start as the ``k`` vectors that come first by ``order``, an expression over ``vec_id``. In each of
    ``rounds`` all vectors are assigned and all centroids moved; then vectors are assigned once more. A round that
    moves nothing ends the loop, since the ones after it would not either. Inertias are null where a long cannot hold them.
    """
    fixed = cut(fixed_point(vectors, vec_id, embedding, dim, scale))
    start = fixed.select(order.alias("_order"), "vector").orderBy(F.asc_nulls_last("_order"), "vector").limit(k).collect()
    kind = fixed.schema["vec_id"].dataType.simpleString()
    result = f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid array<int>"
    if not start:
        return vectors.sparkSession.createDataFrame([], result)
    centroids = np.array([np.frombuffer(bytes(r["vector"]), "<i4") for r in start], np.int64)
    blocks = cut(zone_blocks(fixed, dim))
    drop_cut(fixed)
    for _ in range(rounds):
        last, centroids = centroids, moved(centroids, totals(blocks, centroids))
        if (last == centroids).all():
            break
    inertia = {c: values[-1] for c, values in totals(blocks, centroids, inertia=True).items()}
    fit = lambda v: v if v < 1 << 63 else None
    each, whole = {c: fit(v) for c, v in inertia.items()}, fit(sum(inertia.values()))
    listed = pa.array([c.tolist() for c in centroids], pa.list_(pa.int32()))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (low, high) in enumerate(_boxes(batch, ("low", "high"))):
                x = np.frombuffer(batch.column("vectors")[i].as_buffer(), "<i4").reshape(-1, dim).astype(np.int64)
                mine, distance = compared(x, candidates(low, high, centroids), centroids)
                yield pa.RecordBatch.from_arrays([
                    batch.column("ids")[i].values, pa.array(mine, pa.int32()), pa.array(distance),
                    pa.array([each[c] for c in mine.tolist()], pa.int64()), pa.array([whole] * len(x), pa.int64()), listed.take(pa.array(mine)),
                ], ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"])

    return blocks.select("ids", "vectors", "low", "high").mapInArrow(assign, result)

