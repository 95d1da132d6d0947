"""N-gram Jaccard self-join: size-banded tiles, bitmap bounds, exact intersection.

Two texts link when |A and B| / |A or B| >= t over their sets of word n-grams
(64-bit hashes of the lower-cased words). The result is exact; no candidate is
capped or sampled.

* **Classes.** Texts with equal sets are one class, named by a 64-bit hash of the
  set. Everything below works on one row per class, so exact copies cost nothing.
* **Tiles.** Bands of set sizes; tile b holds the sets of band b and those larger
  ones that may still link with them (size <= size of b / t). Two linked sets of a
  tile differ in at most d = (1 - t) / (1 + t) * (|A| + |B|) elements. The hash space is cut
  into more than d parts, so a linked pair has a part without a difference: each
  set files itself under (tile, part, content of the part), and linked sets meet
  under a common key. A common passage alone does not bring texts together, since
  the other n-grams of a part differ. Empty parts are left out where the surplus
  of parts allows it. In the lowest tile linked sets differ by one element, and
  sets are filed under themselves and themselves less one element instead.
* **Stars.** Every key names three of its sets, the smallest and the largest class and the one
  that meets most sets under all keys. A set is compared with one of those its keys name, the
  one named most often (linear, however many share a key); verified links are contracted.
* **Blocks.** Keys whose sets then still belong to several clusters are compared
  in full, in blocks of bounded size (keys with the same sets are one): bit counts of
  hashed signatures bound the overlap from above, (|A| + |B| - bits of A xor B) / 2,
  and drop nearly all pairs inside the task; only survivors become rows and are
  intersected as sorted arrays. A signature has four to eight bits per n-gram.

Null and empty texts have an empty set and link with nothing. A row without id
gets no component. Repeated ids are one document with several texts, ties do not
matter, an empty table gives an empty result, other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kinweave.llm.words import Texts, mix, shingle_sets, slices
from kinweave.operators.components import connected_components
from kinweave.operators.skew import cut, cut_counted, drop_cut

BLOCK = 2048
BUCKET = 20_000
CHUNK = 1 << 18
# Up to so many classes (16 bytes each) are sent to every executor to fetch their texts.
FETCH = 1_000_000
_A, _B, _C = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3)


def need(a, b, t: Fraction):
    """The least overlap of linked sets of sizes a and b: ceil(t * (a + b) / (1 + t)), as integers."""
    top, low = t.numerator, t.numerator + t.denominator
    return -((-(a + b) * top) // low)


class Tiles:
    """Bands of set sizes and the number of hash parts of each."""

    def __init__(self, t: Fraction, growth: float = 1.6):
        self.t = t
        # Up to this size a linked larger set has one element more and is a superset.
        self.tiny = next(n for n in range(1, 1 << 30) if self.reach(n + 1) > n + 2 or need(n + 1, n + 1, t) <= n)
        edges = [1, self.tiny + 1]
        while edges[-1] < 1 << 40:
            edges.append(max(edges[-1] + 2, int(edges[-1] * growth)))
        self.edges = np.array(edges)
        most = [self.differ(e - 1) + 1 for e in edges[1:]]
        self.spare = np.array([self.empty(e, k) for e, k in zip(edges[:-1], most)])
        self.parts = np.array(most) + self.spare

    def empty(self, n: int, k: int) -> int:
        """So many parts beyond ``k`` that a set of ``n`` or more hardly ever has more empty parts than these.

        Empty parts may be left out as keys as long as there are not more of them, which keeps sets
        apart that have nothing but empty parts in common.
        """
        if n < 60:
            return 0
        spare = 1
        while spare < k:
            expected = (k + spare) * (1 - 1 / (k + spare)) ** n
            wanted = int(np.ceil(expected + 3 * expected**0.5))
            if spare >= wanted:
                return spare
            spare = wanted
        return 1  # so small that no number would do

    def reach(self, n: int) -> int:
        """The largest set that can link with one of size n."""
        return n * self.t.denominator // self.t.numerator

    def differ(self, n: int) -> int:
        """The most elements in which a set of at most n and a linked larger set differ: (1 - t) / (1 + t) of both sizes."""
        low, top = self.t.denominator - self.t.numerator, self.t.denominator + self.t.numerator
        return (n + self.reach(n)) * low // top

    def of(self, n: int) -> list[int]:
        """Tiles of a set: its own band, and those below whose sets can link with one of its size."""
        tile = int(np.searchsorted(self.edges, n, side="right")) - 1
        out = [tile]
        while tile and self.reach(int(self.edges[tile]) - 1) >= n:
            tile -= 1
            out.append(tile)
        return out


def keys_of(hashes: np.ndarray, tiles: Tiles) -> np.ndarray:
    """The keys of one sorted set; linked sets have one in common or are equal."""
    out, n = [], len(hashes)
    for tile in tiles.of(n) if n else ():
        salt = mix(np.array([tile], np.uint64) * _A + _B)
        if tile == 0:
            each = mix(hashes * _C + _A)
            whole = each.sum(dtype=np.uint64)
            out.append(mix(np.append(whole - each, whole) + salt))
            continue
        k = int(tiles.parts[tile])
        part = (((hashes >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)).astype(np.int64)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(hashes * _C + _A), out=total[1:])
        border = np.searchsorted(part, np.arange(k + 1))
        content = total[border[1:]] - total[border[:-1]]
        full = border[1:] > border[:-1]
        if k - full.sum() > tiles.spare[tile]:
            full[:] = True
        out.append(mix(mix(content + np.arange(k, dtype=np.uint64) * _B) + salt)[full])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def class_of(hashes: np.ndarray) -> int:
    return int(mix(np.sum(mix(hashes * _A + _C), dtype=np.uint64, keepdims=True) + np.uint64(len(hashes)))[0])


def bitmap_of(hashes: np.ndarray) -> bytes:
    """A bit per n-gram at its hash modulo a power of two, at least four times the size of the set."""
    width = np.uint64(max(512, 1 << (4 * len(hashes) - 1).bit_length()))
    bits = np.zeros(int(width), bool)
    bits[(mix(hashes + _B) % width).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


class Signatures:
    """The signatures of some sets, laid over themselves (folded) to any smaller width on demand."""

    def __init__(self, bits: list[bytes], size: np.ndarray):
        self.bits, self.size = bits, size
        self.width = np.array([len(b) for b in bits], np.int64)
        self.folded: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def at(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        if width not in self.folded:
            rows = np.flatnonzero(self.width >= width)
            place = np.full(len(self.width), -1)
            place[rows] = np.arange(len(rows))
            self.folded[width] = place, np.stack(
                [np.bitwise_or.reduce(np.frombuffer(self.bits[i], np.uint64).reshape(-1, width // 8), axis=0) for i in rows])
        return self.folded[width]

    def overlap_bound(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The most that the sets x and y can have in common, pair by pair; of two widths the smaller counts."""
        bound = np.minimum(self.size[x], self.size[y]).astype(np.int64)
        width = np.minimum(self.width[x], self.width[y])
        for w in np.unique(width):
            place, bits = self.at(int(w))
            pairs = np.flatnonzero(width == w)
            step = max(1, (8 << 20) // int(w))
            for k in range(0, len(pairs), step):
                at = pairs[k:k + step]
                apart = np.bitwise_count(bits[place[x[at]]] ^ bits[place[y[at]]]).sum(1, dtype=np.int64)
                bound[at] = np.minimum(bound[at], (self.size[x[at]] + self.size[y[at]] - apart) // 2)
        return bound


def _sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.asarray(values, np.uint64).view(np.int64))


def describe(docs: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, class, bits) per row; class and bits are null for an empty set."""
    source = _sets(docs, id_col, text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sets = shingle_sets(Texts(part.column(1)), n)
            named = pa.array([np.uint64(class_of(s)).view(np.int64).item() if len(s) else None for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(s) for s in sets], pa.int64()), named,
                 pa.array([bitmap_of(s) if len(s) else None for s in sets], pa.binary())],
                ["id", "n_shingles", "class", "bits"],
            )

    return source.mapInArrow(scan, f"id {source.schema['id'].dataType.simpleString()}, n_shingles long, class long, bits binary")


def file_keys(docs: DataFrame, n: int, t: Fraction, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, class) rows: every set under all of its keys."""
    tiles = Tiles(t)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sets = [s for s in shingle_sets(Texts(part.column(1)), n) if len(s)]
            named = {class_of(s): s for s in sets}
            keys = [keys_of(s, tiles) for s in named.values()]
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [_signed(np.concatenate(keys)),
                     _signed(np.repeat(np.array(list(named), np.uint64), [len(k) for k in keys]))],
                    ["key", "class"],
                )

    return _sets(docs, id_col, text_col).mapInArrow(scan, "key long, class long")


def _sizes_allow(t: Fraction) -> str:
    """Even full containment must reach the overlap that sizes na and nb ask for."""
    return f"{t.numerator + t.denominator} * least(na, nb) >= {t.numerator} * (na + nb)"


def bounded(pairs: DataFrame, classes: DataFrame, t: Fraction) -> DataFrame:
    """Pairs (a, b) of classes whose sizes and bit counts allow a link."""
    size = lambda x: classes.select(F.col("class").alias(x), F.col("n_shingles").alias(f"n{x}"))
    side = lambda x: classes.select(F.col("class").alias(x), F.col("bits").alias(f"bits{x}"))
    sized = pairs.join(size("a"), "a").join(size("b"), "b").where(_sizes_allow(t))
    signed = sized.join(side("a"), "a").join(side("b"), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, na, nb = (batch.column(i).to_numpy() for i in range(4))
            n = np.arange(len(a))
            both = Signatures(batch.column(4).to_pylist() + batch.column(5).to_pylist(), np.concatenate([na, nb]))
            fine = both.overlap_bound(n, n + len(a)) >= need(na, nb, t)
            yield pa.RecordBatch.from_arrays([pa.array(a[fine]), pa.array(b[fine])], ["a", "b"])

    return signed.select("a", "b", "na", "nb", "bitsa", "bitsb").mapInArrow(check, "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, members: DataFrame, n: int, t: Fraction, id_col: str, text_col: str) -> DataFrame:
    """Pairs (a, b) of classes whose sorted n-gram arrays reach the overlap, as a written table.

    ``members`` names one document per class; only the texts of classes on a pair
    are read again.
    """
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    chosen, rows = cut_counted(members.join(wanted, "class", "left_semi").select("id", F.col("class").alias("named")))
    # A checked size decides how the texts are fetched: without moving them, or through a shuffle.
    texts = _sets(docs, id_col, text_col).join(F.broadcast(chosen) if rows <= FETCH else chosen.hint("shuffle_hash"), "id")

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sets = shingle_sets(Texts(part.column(0)), n)
            # A repeated id may have several texts: only the text of the class counts.
            right = [i for i, c in enumerate(part.column(1).to_numpy()) if len(sets[i]) and np.uint64(class_of(sets[i])).view(np.int64) == c]
            yield pa.RecordBatch.from_arrays(
                [part.column(1).take(pa.array(right, pa.int64())), pa.array([sets[i].tobytes() for i in right], pa.binary())], ["class", "grams"]
            )

    grams = cut(texts.select("text", "named").mapInArrow(arrays, "class long, grams binary").dropDuplicates(["class"]))
    side = lambda x: grams.select(F.col("class").alias(x), F.col("grams").alias(f"grams{x}"))

    def intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                common = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(common >= need(len(x), len(y), t))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    found = cut(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "gramsa", "gramsb").mapInArrow(intersect, "a long, b long"))
    drop_cut(grams)
    drop_cut(chosen)
    return found


def _block_pairs(shared: DataFrame, classes: DataFrame, t: Fraction) -> DataFrame:
    """Pairs of different clusters under a common key that sizes and bit counts allow.

    ``shared`` has (key, class, root). A key with many classes is dealt into blocks of
    about ``BLOCK`` and every two blocks meet; small keys are handed to a task many at a time.
    """
    sizes = shared.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("class").alias("low"))
    dealt, rows = cut_counted(
        shared.join(sizes, "key")
        .withColumn("blocks", F.ceil(F.col("n") / BLOCK))
        .withColumn("own", F.pmod(F.xxhash64("class", "key"), F.col("blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("low", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "key", "own", "class", "root")
    )
    # Keys with the same smallest set have most of their sets in common; together they need each signature once.
    placed = dealt.select(
        F.pmod(F.xxhash64("low", "i", "j"), F.lit(rows // BUCKET + 1)).alias("bucket"),
        F.xxhash64("key", "i", "j").alias("block"), (F.col("i") != F.col("j")).alias("mixed"), "own", "class", "root")
    signed = placed.select(F.col("bucket").alias("near"), F.col("class").alias("named")).distinct() \
        .join(classes.select(F.col("class").alias("named"), "n_shingles", "bits"), "named")

    def tile(key: tuple, rows: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["block", "root", "class"], ignore_index=True)
        sets = sets.sort_values("named", ignore_index=True)
        root, own, mixed, block, named = (rows[c].to_numpy() for c in ("root", "own", "mixed", "block", "class"))
        at = np.searchsorted(sets["named"].to_numpy(), named)
        size = sets["n_shingles"].to_numpy()[at]
        signs = Signatures(sets["bits"].tolist(), sets["n_shingles"].to_numpy())
        # Sorted by cluster, a set meets the rest of its block after the end of its own cluster.
        edge = np.flatnonzero((np.diff(block) != 0) | (np.diff(root) != 0)) + 1
        behind = np.append(edge, len(rows))[np.searchsorted(edge, np.arange(len(rows)), side="right")]
        many = np.searchsorted(block, block, side="right") - behind
        ahead = np.cumsum(many)
        begin, found, waiting = 0, np.zeros(0, np.int64), []
        while begin < len(rows):
            past = max(begin + 1, int(np.searchsorted(ahead, (ahead[begin - 1] if begin else 0) + CHUNK, side="right")))
            n = many[begin:past]
            x = np.repeat(np.arange(begin, past), n)
            y = behind[x] + np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
            enough = need(size[x], size[y], t)
            fine = (np.minimum(size[x], size[y]) >= enough) & (~mixed[x] | (own[x] != own[y]))
            x, y, enough = x[fine], y[fine], enough[fine]
            fine = signs.overlap_bound(at[x], at[y]) >= enough
            x, y = at[x[fine]].astype(np.int64), at[y[fine]]
            waiting.append(np.unique(np.minimum(x, y) * len(sets) + np.maximum(x, y)))
            begin = past
            # Keys with the same sets make the same pairs again and again: only distinct ones are held.
            if begin == len(rows) or sum(map(len, waiting)) > 4 * CHUNK:
                found, waiting = np.unique(np.concatenate([found, *waiting])), []
        named = sets["named"].to_numpy()
        a, b = named[found // max(len(sets), 1)], named[found % max(len(sets), 1)]
        return pd.DataFrame({"a": a, "b": b})

    return placed.groupBy("bucket").cogroup(signed.groupBy("near")).applyInPandas(tile, "a long, b long").distinct()


def similar_components(
    docs: DataFrame, n: int = 4, threshold: float | str = "0.85", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, n_shingles, component_id) per row of ``docs``.

    ``component_id`` is the smallest id that links reach, the own id included; null
    where the id is null. Intermediate tables are written to the shared folder.
    """
    t = Fraction(str(threshold))
    rows = cut(describe(docs, n, id_col, text_col))
    classes = cut(
        rows.where("class IS NOT NULL AND id IS NOT NULL").groupBy("class")
        .agg(F.min("id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("bits").alias("bits"))
    )
    keys = file_keys(docs.where(F.col(id_col).isNotNull()), n, t, id_col, text_col)
    met = cut(
        keys.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high")
    )
    # Sets under a shared key: again through the shuffle, but only those that meet stay.
    shared = cut(keys.join(met.hint("shuffle_hash"), "key").distinct())
    drop_cut(met)
    # The set that meets others most often under a key is the likely original of a group of near copies.
    weight = shared.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    degree = shared.join(weight, "key").groupBy("class").agg(F.sum(F.col("n") - 1).alias("degree"))
    middle = shared.join(degree, "class").groupBy("key").agg(F.max(F.struct("degree", "class")).alias("top"))
    met_often = (
        shared.join(middle, "key")
        .select(F.col("class").alias("a"), F.explode(F.array_distinct(F.array("low", "high", "top.class"))).alias("b"))
        .where("a <> b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    )
    # Of these every set tries the one that it shares most keys with, among those of a size that can link.
    size = lambda x: classes.select(F.col("class").alias(x), F.col("n_shingles").alias(f"n{x}"))
    fitting = met_often.join(size("a"), "a").join(size("b"), "b").where(_sizes_allow(t))
    stars = cut(
        fitting.groupBy("a").agg(F.max(F.struct("n", "b")).alias("most"))
        .select(F.least("a", "most.b").alias("x"), F.greatest("a", "most.b").alias("b")).withColumnRenamed("x", "a").distinct()
    )
    members = classes.select("class", "id")
    links = verified(cut(bounded(stars, classes, t)), docs, members, n, t, id_col, text_col)
    roots = connected_components(links)

    labelled = shared.select("key", "class").join(roots.withColumnRenamed("id", "class"), "class", "left") \
        .withColumn("root", F.coalesce("root", "class"))
    # Keys with sets of several clusters; of keys with the same sets one is enough.
    open_keys = (
        labelled.groupBy("key")
        .agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count(F.lit(1)).alias("n"),
             F.bit_xor(F.xxhash64("class")).alias("h1"), F.bit_xor(F.xxhash64(F.lit(1), "class")).alias("h2"))
        .where("x < y").groupBy("n", "h1", "h2").agg(F.min("key").alias("key")).select("key")
    )
    # Pairs that a star has already tried are not tried again.
    rest = _block_pairs(cut(labelled.join(open_keys, "key", "left_semi")), classes, t).join(stars, ["a", "b"], "left_anti")
    rest = cut(rest)
    if not rest.isEmpty():
        more = verified(rest, docs, members, n, t, id_col, text_col)
        roots = connected_components(cut(links.unionByName(more)))

    named = classes.select("class", "id").join(roots.withColumnRenamed("id", "class"), "class")
    smallest = named.groupBy("root").agg(F.min("id").alias("component_id"))
    answer = named.join(smallest, "root").select("class", "component_id") \
        .unionByName(members.join(roots.select(F.col("id").alias("class")), "class", "left_anti").withColumnRenamed("id", "component_id"))
    return rows.join(answer, "class", "left").select(
        F.col("id").alias(id_col), "n_shingles",
        F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"),
    )
