"""Exact n-gram Jaccard join in the metric space of shingle sets.

Jaccard distance is a metric, so every document may be placed by its distances
to pivots. The steps:

1. *Filter.* A size class fixes how many shingles two linked sets of it can
   differ in at most. The universe is cut into more parts than that; every
   differing shingle touches one part, so of the parts a set fills all but that
   many are whole in a linked set too. A set goes on only if so many of its
   parts are shared (told by a Bloom filter of repeated parts, then exactly);
   a passage in common is not enough. Copies are one set from here.
2. *Pivots and regions.* Of the sets that share a part the one of smallest hash
   is the pivot. A set goes to its pivots in the order of their hashes, and
   stops when fewer parts are left than any linked set shares with it: two
   linked sets share more parts than either leaves out, so both go to the pivot
   of their first common part. Most sets go to one pivot; those between regions
   are replicated. Only ids are dealt; the texts of the sets follow, packed.
3. *Voronoi regions.* Inside a region further pivots are measured against all its
   sets, far ones first. A pivot links what lies within the radius of it, and
   sets it links need no further look at each other. A set belongs to its
   nearest pivot and to every pivot no further than two radii beyond it, which
   keeps linked pairs together; regions are divided again until they are small.
4. *Windows.* d(x, p) and d(y, p) of linked sets differ by at most the radius
   (triangle inequality); only sets of different components inside such windows
   are compared, by whole numbers.
5. *Size.* A region above what a task may hold is divided by Spark the same way;
   one that does not fall apart is compared in pairs of blocks, and blocks of
   sets that a pivot has linked are not paired with each other.
6. *Links* of a region become a spanning forest; components of all forests are
   found by passing on the smallest label, with pointer jumps.

Cases: null or empty texts and texts without words have no shingles and stay
alone; a text of fewer words than a shingle is one shingle; repeated rows and
copies are one set; an empty table gives no rows; other columns are not read.
Rows without an id are alone, with null as their component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from itemspark.llm.arrays import RepeatedFilter, mix, repeated, shingle_sets, stretches
from itemspark.llm.common import free_names, written
from itemspark.session import durable, ship

ship(__name__)

_U = np.uint64
#: Sets of one region that one task compares, and their shingles in all.
REGION_SETS = 4_000
REGION_SHINGLES = 4_000_000
#: Pivots that divide a region, and the sets below which it is not divided.
_PIVOTS = 16
_BLOCK = 256
_ROUNDS = 3


def _classes(percent: int, largest: int = 1 << 31) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per size class: largest size, most differing shingles of a linked pair, number of parts."""
    tops = [1]
    while tops[-1] < largest:
        tops.append(max(tops[-1] + 1, tops[-1] * 100 // percent))
    top = np.array(tops, np.int64)
    differ = 2 * top * (100 - percent) // (100 + percent)
    return top, differ, differ + 1 + np.where(differ > 0, differ // 4 + 2, 0)


def _signatures(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of the parts of all sets for their own size class and the next; the place (twice the set's, one more
    for the next class) of each; and per place how many of its signatures a linked set has at least."""
    top, differ, parts = _classes(percent)
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    every = np.concatenate([*sets, np.zeros(0, _U)])
    found, places, needs = [], [], np.zeros(2 * len(sets), np.int64)
    for step in (0, 1):
        k = np.searchsorted(top, np.maximum(sizes, 1)) + step
        m = np.where(sizes > 0, parts[k], 0)
        base = np.cumsum(m) - m
        with np.errstate(over="ignore"):
            salted = mix(every ^ (k[owner].astype(_U) * _U(0x9FB21C651E98DF25)))
            cell = base[owner] + (salted >> _U(32)).astype(np.int64) * m[owner] // (1 << 32)
            value = mix(every + _U(0x2545F4914F6CDD1D))
            n = int(m.sum())
            low = np.bincount(cell, (value & _U(0xFFFFFFFF)).astype(np.float64), n).astype(_U)
            high = np.bincount(cell, (value >> _U(32)).astype(np.float64), n).astype(_U)
            count = np.bincount(cell, minlength=n)
            of = np.repeat(np.arange(len(sets)), m)
            part = np.arange(n) - base[of]
            name = (k[of].astype(_U) << _U(40)) + part.astype(_U)
            signature = mix(low * _U(0xC2B2AE3D27D4EB4F) + high * _U(0x165667B19E3779F9) + mix(name) + count.astype(_U))
        full = count > 0
        # a set whose filled parts could all differ from a linked one also shows its empty parts
        filled = np.bincount(of, full, len(sets)).astype(np.int64)
        sparse = filled <= differ[k]
        shown = full | (sparse[of] & (m[of] > 0))
        found.append(signature[shown])
        places.append(2 * of[shown] + step)
        needs[step::2] = np.where(sparse, 1, filled - differ[k])
    return np.concatenate(found), np.concatenate(places), needs


def _shared(sets: list[np.ndarray], percent: int, seen: RepeatedFilter) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The signatures that may be shared, of places that may have a linked set."""
    signature, place, needs = _signatures(sets, percent)
    held = seen.holds(signature)
    signature, place = signature[held], place[held]
    enough = np.bincount(place, minlength=len(needs)) >= needs
    return signature[enough[place]], place[enough[place]], needs


def _hashes(width: int, percent: int):
    def run(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, _, data, offsets in stretches(batch.column("text")):
            yield _signatures(shingle_sets(data, offsets, width), percent)[0]

    return run


def _digests(sets: list[np.ndarray]) -> list[list[int]]:
    with np.errstate(over="ignore"):
        return [[int(mix(s + _U(c)).sum(dtype=_U).astype(np.int64)) if len(s) else 0 for s in sets] for c in (11, 12)]


def _sketch(width: int, percent: int, seen):
    """Per document: size, two digests of the set, and per class the signatures that may be shared with what a link needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filtered = RepeatedFilter(*seen.value)
        for batch in batches:
            ids = batch.column("doc_id")
            for at, end, data, offsets in stretches(batch.column("text")):
                sets = shingle_sets(data, offsets, width)
                signature, place, needs = _shared(sets, percent, filtered)
                order = np.argsort(place, kind="stable")
                cut = np.searchsorted(place[order], np.arange(2 * len(sets) + 1))
                lists = [np.unique(signature[order[a:b]]).view(np.int64) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                arrays = [ids.slice(at, end - at), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(d, pa.int64()) for d in _digests(sets))]
                for step in (0, 1):
                    arrays += [pa.array(lists[step::2], pa.list_(pa.int64())), pa.array(needs[step::2], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "d1", "d2", "shared0", "need0", "shared1", "need1"])

    return run


_SKETCH = "doc_id long, n long, d1 long, d2 long, shared0 array<long>, need0 long, shared1 array<long>, need1 long"


def _packed(width: int, percent: int, seen):
    """The texts of documents that may have a link, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filtered, codec = RepeatedFilter(*seen.value), pa.Codec("zstd", 3)
        for batch in batches:
            ids = batch.column("doc_id")
            for at, _, data, offsets in stretches(batch.column("text")):
                sets = shingle_sets(data, offsets, width)
                _, place, _ = _shared(sets, percent, filtered)
                rows = np.unique(place // 2)
                first = _digests([sets[i] for i in rows])[0]
                texts = [codec.compress(data[offsets[i] : offsets[i + 1]].tobytes(), asbytes=True) for i in rows]
                sizes = [int(offsets[i + 1] - offsets[i]) for i in rows]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at + rows)), pa.array(first, pa.int64()), pa.array(sizes, pa.int64()), pa.array(texts, pa.binary())], ["doc_id", "d1", "bytes", "packed"])

    return run


def _sets_of(part: pd.DataFrame, width: int) -> list[np.ndarray]:
    """Sets of packed texts."""
    codec, out = pa.Codec("zstd"), []
    for size, packed in zip(part["bytes"], part["packed"], strict=True):
        raw = codec.decompress(packed, decompressed_size=int(size), asbytes=True)
        out += shingle_sets(np.frombuffer(raw, np.uint8), np.array([0, len(raw)], np.int64), width)
    return out


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def roots(self, rows: np.ndarray) -> np.ndarray:
        return np.array([self.root(int(i)) for i in rows], np.int64)


class _Region:
    """Sets as rows of an incidence list over the shingles that two or more of them hold."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent, self.radius = percent, (100 - percent) / 100 + 1e-9
        self.sizes = np.array([len(s) for s in sets], np.int64)
        row = np.repeat(np.arange(len(sets)), self.sizes)
        _, column, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        renamed, keep = np.cumsum(n > 1) - 1, (n > 1)[column]
        self.row, self.column, self.width = row[keep], renamed[column[keep]], int((n > 1).sum())
        self.begin = np.searchsorted(self.row, np.arange(len(sets) + 1))
        self.forest = _Forest(len(sets))

    def own(self, i: int) -> np.ndarray:
        return self.column[self.begin[i] : self.begin[i + 1]]

    def cells(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number (within ``rows``) and column of all incidences of some rows."""
        n = self.begin[rows + 1] - self.begin[rows]
        of = np.repeat(np.arange(len(rows)), n)
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + self.begin[rows][of]
        return of, self.column[at]

    def linked(self, both: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return 100 * both >= self.percent * (a + b - both)

    def to_pivots(self, rows: np.ndarray, by_hash: np.ndarray) -> np.ndarray:
        """Distances of rows to pivots chosen one by one; what a pivot links is joined."""
        of, column = self.cells(rows)
        found, least, flag = [], np.full(len(rows), np.inf), np.zeros(self.width, bool)
        chosen = int(by_hash[0])
        while True:
            p = rows[chosen]
            flag[:] = False
            flag[self.own(p)] = True
            both = np.bincount(of, flag[column], len(rows)).astype(np.int64)
            both[chosen] = self.sizes[p]
            for i in np.nonzero(self.linked(both, self.sizes[rows], self.sizes[p]))[0]:
                self.forest.join(int(rows[i]), int(p))
            distance = 1 - both / (self.sizes[rows] + self.sizes[p] - both)
            found.append(distance)
            least = np.minimum(least, distance)
            chosen = int(np.argmax(least))
            if len(found) >= min(_PIVOTS, len(rows)) or least[chosen] <= 0 or len(np.unique(self.forest.roots(rows))) == 1:
                return np.stack(found, axis=1)

    def divide(self, rows: np.ndarray, by_hash: np.ndarray) -> None:
        """Link all pairs of ``rows`` that no component joins already."""
        if len(rows) < 2:
            return
        distances = self.to_pivots(rows, by_hash)
        roots = self.forest.roots(rows)
        if (roots == roots[0]).all():
            return
        if len(rows) > _BLOCK:
            near = distances <= distances.min(axis=1, keepdims=True) + 2 * self.radius
            if near.sum(axis=0).max() <= 0.8 * len(rows) and near.sum() <= 4 * len(rows):
                rank = np.empty(len(rows), np.int64)
                rank[by_hash] = np.arange(len(rows))
                for p in range(distances.shape[1]):
                    inside = np.nonzero(near[:, p])[0]
                    if len(inside) < len(rows):
                        self.divide(rows[inside], np.argsort(rank[inside], kind="stable"))
                return
        self.compare(rows, distances, roots)

    def compare(self, rows: np.ndarray, distances: np.ndarray, roots: np.ndarray) -> None:
        """Blocks in the order of component and distance; pairs of blocks of one component or outside the windows are left out."""
        order = np.lexsort((distances[:, 0], roots))
        rows, distances, roots = rows[order], distances[order], roots[order]
        blocks = [slice(at, min(at + _BLOCK, len(rows))) for at in range(0, len(rows), _BLOCK)]
        low = np.stack([distances[s].min(axis=0) for s in blocks])
        high = np.stack([distances[s].max(axis=0) for s in blocks])
        for i, a in enumerate(blocks):
            for j in range(i, len(blocks)):
                b = blocks[j]
                one = roots[a.start] == roots[a.stop - 1] == roots[b.start] == roots[b.stop - 1]
                if not one and (np.maximum(low[i] - high[j], low[j] - high[i]) <= self.radius).all():
                    self.product(rows[a], rows[b])

    def product(self, a: np.ndarray, b: np.ndarray) -> None:
        """Sizes of all intersections of two blocks as products of 0/1 matrices over strips of shared columns."""
        (ra, ca), (rb, cb) = self.cells(a), self.cells(b)
        common = np.intersect1d(ca, cb)
        both = np.zeros((len(a), len(b)), np.float32)
        ra, ca, rb, cb = (x[np.isin(c, common)] for c, pair in ((ca, (ra, ca)), (cb, (rb, cb))) for x in pair)
        ca, cb = np.searchsorted(common, ca), np.searchsorted(common, cb)
        for at in range(0, len(common), 4096):
            sides = []
            for r, c, n in ((ra, ca, len(a)), (rb, cb, len(b))):
                inside = (c >= at) & (c < at + 4096)
                m = np.zeros((n, min(4096, len(common) - at)), np.float32)
                m[r[inside], c[inside] - at] = 1
                sides.append(m)
            both += sides[0] @ sides[1].T
        whole = both.astype(np.int64)
        for i, j in zip(*np.nonzero(self.linked(whole, self.sizes[a][:, None], self.sizes[b][None])), strict=True):
            if a[i] != b[j]:
                self.forest.join(int(a[i]), int(b[j]))


def _region_links(ids: np.ndarray, sets: list[np.ndarray], percent: int, labels: np.ndarray | None = None, sides: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links of a region, as pairs (id, smallest id of its tree).

    Sets of one label (not -1) are of one component already. With ``sides`` only
    sets of different sides are compared.
    """
    region = _Region(sets, percent)
    if labels is not None:
        for label in np.unique(labels[labels >= 0]):
            same = np.nonzero(labels == label)[0]
            for i in same[1:]:
                region.forest.join(int(same[0]), int(i))
    rows = np.arange(len(sets))
    if sides is not None and len(np.unique(sides)) > 1:
        parts = [np.nonzero(sides == s)[0] for s in (0, 1)]
        for a in range(0, len(parts[0]), _BLOCK):
            for b in range(0, len(parts[1]), _BLOCK):
                region.product(parts[0][a : a + _BLOCK], parts[1][b : b + _BLOCK])
    else:
        region.divide(rows, np.argsort(mix(ids.astype(np.int64).view(_U)), kind="stable"))
    roots = region.forest.roots(rows)
    smallest: dict[int, int] = {}
    for i, r in zip(ids.tolist(), roots.tolist(), strict=True):
        smallest[r] = min(smallest.get(r, i), i)
    return [(i, smallest[r]) for i, r in zip(ids.tolist(), roots.tolist(), strict=True) if smallest[r] != i]


def _compare(width: int, percent: int):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.drop_duplicates("rep")
        labels = part["label"].fillna(-1).to_numpy(np.int64)
        codes = np.where(labels >= 0, np.unique(labels, return_inverse=True)[1], -1)
        sides = part["side"].to_numpy(np.int64) if "side" in part else None
        return pd.DataFrame(_region_links(part["rep"].to_numpy(np.int64), _sets_of(part, width), percent, codes, sides), columns=["a", "b"], dtype="int64")

    return run


def _distances(width: int, percent: int):
    """Distance of every set to the pivot beside it, and whether they are linked."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[int, np.ndarray] = {}

        def unpacked(rep: int, size: int, packed: bytes) -> np.ndarray:
            if rep not in known:
                if len(known) > 8 * _PIVOTS:
                    known.clear()
                known[rep] = _sets_of(pd.DataFrame({"bytes": [size], "packed": [packed]}), width)[0]
            return known[rep]

        for batch in batches:
            out = []
            for row in batch[["rep", "bytes", "packed", "pivot", "pivot_bytes", "pivot_packed"]].itertuples(index=False):
                x, p = unpacked(*row[:3]), unpacked(*row[3:])
                both = int(np.isin(x, p, assume_unique=True).sum())
                either = len(x) + len(p) - both
                out.append((1 - both / either, 100 * both >= percent * either))
            yield batch[["region", "rep", "pivot"]].assign(distance=[d for d, _ in out], linked=[k for _, k in out])

    return run


def _measured(regions: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Distances of the sets of large regions to further pivots of their region."""
    hashed = regions.withColumn("h", F.xxhash64("rep", "region")).withColumn("k", F.row_number().over(W.partitionBy("region").orderBy("h", "rep")))
    pivots = hashed.filter(F.col("k") <= _PIVOTS).select("region", F.col("rep").alias("pivot"))
    with_texts = pivots.join(texts.select(F.col("rep").alias("pivot"), F.col("bytes").alias("pivot_bytes"), F.col("packed").alias("pivot_packed")), "pivot")
    # a large region is spread over as many tasks as there are partitions
    salts = int(regions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = regions.select("region", "rep").join(texts, "rep").withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(salts)).cast("int"))
    right = with_texts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    far = left.join(right, ["region", "salt"]).select("region", "rep", "bytes", "packed", "pivot", "pivot_bytes", "pivot_packed")
    return written(far.mapInPandas(_distances(width, percent), "region long, rep long, pivot long, distance double, linked boolean"), "distances")


def _labelled(big: DataFrame, far: DataFrame) -> DataFrame:
    """Members of large regions; ``label`` is one for all sets that pivots link with each other, directly or through further sets."""
    linked = far.filter("linked")
    first = linked.groupBy("region", "rep").agg(F.min("pivot").alias("first"))
    others = linked.join(first, ["region", "rep"]).filter("pivot <> first").select(F.col("pivot").alias("a"), F.col("first").alias("b")).distinct()
    merged = components(others).select(F.col("node").alias("first"), F.col("label").alias("merged"))
    named = first.join(merged, "first", "left").select("region", "rep", F.coalesce("merged", "first").alias("now"))
    return big.join(named, ["region", "rep"], "left").select("region", "rep", "n", F.coalesce("now", "label").alias("label"))


def _divided(big: DataFrame, far: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(members of the Voronoi regions of the pivots, with windows of two radii; members of regions that do not fall apart).

    A region falls apart if none of its parts has most of its sets, and all parts
    together are not many times as large. Regions of one component are done.
    """
    state = big.groupBy("region").agg(F.count(F.lit(1)).alias("m"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("label").alias("named"))
    state = state.filter((F.col("named") < F.col("m")) | (F.col("lo") < F.col("hi"))).select("region", "m")
    nearest = far.groupBy("region", "rep").agg(F.min("distance").alias("nearest"))
    near = far.join(nearest, ["region", "rep"]).filter(F.col("distance") <= F.col("nearest") + 2 * (100 - percent) / 100 + 1e-9)
    parts = near.groupBy("region", "pivot").agg(F.count(F.lit(1)).alias("c")).groupBy("region").agg(F.max("c").alias("most"), F.sum("c").alias("all"))
    judged = state.join(parts, "region").select("region", ((F.col("most") <= 0.8 * F.col("m")) & (F.col("all") <= 4 * F.col("m"))).alias("apart"))
    judged = durable(judged)
    sized = near.join(judged.filter("apart").select("region"), "region").join(big, ["region", "rep"])
    cells = sized.select(F.xxhash64("region", "pivot").alias("region"), "rep", "n", "label")
    return cells, big.join(judged.filter("NOT apart").select("region"), "region")


def _blocks(large: DataFrame, big: DataFrame) -> DataFrame:
    """Pairs of blocks of regions that stay large (``cell``), without pairs of blocks that one label has linked."""
    parts = F.ceil(F.greatest(2 * F.col("m") / REGION_SETS, 2 * F.col("n") / REGION_SHINGLES)).cast("int")
    dealt = big.join(large.select("region", parts.alias("blocks")), "region")
    dealt = dealt.withColumn("block", F.xxhash64(F.coalesce("label", F.lit(-1)), F.pmod(F.xxhash64("rep"), F.col("blocks"))))
    others = dealt.select("region", F.col("block").alias("other"), F.col("label").alias("other_label")).distinct()
    met = dealt.join(others, "region").filter(F.col("label").isNull() | F.col("other_label").isNull() | (F.col("label") != F.col("other_label")))
    side = F.when(F.col("block") > F.col("other"), 1).otherwise(0)
    return met.select(F.xxhash64("region", F.least("block", "other"), F.greatest("block", "other")).alias("region"), "rep", "label", side.alias("side"))


def _links(regions: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (``a``, ``b``) within all regions, by recursion where a region is large."""
    found = []

    def in_blocks(rows: DataFrame) -> DataFrame:
        sizes = rows.groupBy("region").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("n"))
        return _blocks(sizes, rows).join(texts, "rep").groupBy("region").applyInPandas(_compare(width, percent), "a long, b long")

    for left in range(_ROUNDS, -1, -1):
        sizes = regions.groupBy("region").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("n"))
        fits = (F.col("m") <= REGION_SETS) & (F.col("n") <= REGION_SHINGLES)
        small = sizes.filter((F.col("m") > 1) & fits).select("region")
        large = durable(sizes.filter((F.col("m") > 1) & ~fits).select("region"))
        rows = regions.join(small, "region").select("region", "rep", "label").join(texts, "rep")
        found.append(rows.groupBy("region").applyInPandas(_compare(width, percent), "a long, b long"))
        if large.isEmpty():
            break
        big = durable(regions.join(large, "region").select("region", "rep", "n", "label"))
        if not left:  # still large: pairs of blocks, each compared by one task
            found.append(in_blocks(big))
            break
        far = _measured(big, texts, width, percent)
        found.append(far.filter("linked AND rep <> pivot").select(F.greatest("rep", "pivot").alias("a"), F.least("rep", "pivot").alias("b")))
        cells, whole = _divided(durable(_labelled(big, far)), far, percent)
        found.append(in_blocks(whole))
        regions = durable(cells.groupBy("region", "rep").agg(F.min("n").alias("n"), F.min("label").alias("label")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``label``, the smallest node that links reach, for every linked node."""
    edges = durable(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = durable(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        offered = edges.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("offer"))
        better = labels.join(offered, "node", "left").select("node", F.col("label").alias("before"), F.least("label", "offer").alias("label"))
        jump = better.select(F.col("node").alias("label"), F.col("label").alias("further"))
        moved = durable(better.join(jump, "label", "left").select("node", "before", F.least("label", "further").alias("label")))
        if moved.filter("label < before").isEmpty():
            return moved.select("node", "label")
        labels = moved.select("node", "label")


def regions_of(reps: DataFrame) -> DataFrame:
    """``region``, ``rep``, ``n`` and a null ``label``: every set at the pivots where linked sets meet (step 2)."""
    shown = [reps.select("rep", "n", F.lit(step).alias("step"), F.col(f"need{step}").alias("need"), F.explode(f"shared{step}").alias("signature")) for step in (0, 1)]
    shown = shown[0].unionByName(shown[1])
    pivots = (
        shown.groupBy("signature")
        .agg(F.min(F.struct(F.xxhash64("rep").alias("h"), F.col("rep"))).alias("p"), F.count(F.lit(1)).alias("m"))
        .filter("m > 1")
        .select(F.col("signature").alias("_s"), F.col("p.h").alias("h"), F.col("p.rep").alias("region"))
    )
    met = shown.join(pivots, F.col("signature") == F.col("_s"))
    parts = met.groupBy("rep", "n", "step", "need", "h", "region").agg(F.count(F.lit(1)).alias("parts"))
    own = W.partitionBy("rep", "step", "need", "n")
    before = own.orderBy("h", "region").rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("parts").over(own) - F.coalesce(F.sum("parts").over(before), F.lit(0))
    chosen = parts.withColumn("left", left).filter(F.col("left") >= F.col("need"))
    return chosen.select("region", "rep", "n").distinct().withColumn("label", F.lit(None).cast("long"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bits: int = 1 << 27) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row (integer ids)."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # plain arrays are broadcast; tasks make the filter of them
    seen = spark.sparkContext.broadcast(repeated(texts, ["text"], _hashes(width, percent), bits).parts())
    drawn = written(texts.mapInArrow(_sketch(width, percent, seen), _SKETCH), "sketches")
    some = drawn.filter("doc_id IS NOT NULL AND (size(shared0) > 0 OR size(shared1) > 0)")
    # one document stands for all with the same set
    keyed = durable(some.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep")))
    keyed = keyed.select(F.col("n").alias("_n"), F.col("d1").alias("_d1"), F.col("d2").alias("_d2"), "rep")
    same = (F.col("d1") == F.col("_d1")) & (F.col("d2") == F.col("_d2")) & (F.col("n") == F.col("_n"))
    # joined by one digest, so that Spark may split a set that many documents have
    member = some.select("doc_id", "n", "d1", "d2").join(keyed, same).select("doc_id", "rep")
    reps = some.join(keyed, same & (F.col("doc_id") == F.col("rep"))).dropDuplicates(["rep", "d1"])
    regions = durable(regions_of(reps))
    met = regions.join(regions.groupBy("region").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("region"), "region", "left_semi")
    wanted = met.select("rep").distinct().join(keyed, "rep").select(F.col("rep").alias("_rep"), "_d1")
    packed = texts.filter("doc_id IS NOT NULL").mapInArrow(_packed(width, percent, seen), "doc_id long, d1 long, bytes long, packed binary")
    sets = packed.join(wanted, (F.col("doc_id") == F.col("_rep")) & (F.col("d1") == F.col("_d1"))).select(F.col("_rep").alias("rep"), "bytes", "packed")
    sets = written(sets.dropDuplicates(["rep"]), "sets")
    linked = components(_links(met, sets, width, percent))
    whole = member.join(linked, member["rep"] == linked["node"], "left").select("doc_id", F.coalesce("label", "rep").alias("component"))
    whole = whole.groupBy(F.col("doc_id").alias("_id")).agg(F.min("component").alias("_component"))
    return drawn.select("doc_id", "n").join(whole, F.col("doc_id") == F.col("_id"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("_component", "doc_id").alias("component_id")
    )


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents without near copies: of a component one row of the smallest id stays, a null id last; same columns.

    Rows whose id is null or repeated are told apart by a number; only those are copied.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("id"))
    n_rows, n_ids, largest, least = ids.agg(F.count(F.lit(1)), F.countDistinct("id"), F.max("id"), F.min("id")).first()
    row, copy, place = free_names(docs, "row", "copy", "place")
    if n_rows == n_ids:
        found = near_duplicates(docs, width, percent)
        copies = found.filter(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias(copy))
        return docs.join(copies, docs["doc_id"].cast("long") == copies[copy], "left_anti")
    own = docs.withColumn(copy, F.col("doc_id").cast("long"))
    repeats = own.groupBy(copy).agg(F.count(F.lit(1)).alias("n")).filter(F.col(copy).isNotNull() & (F.col("n") > 1)).select(F.col(copy).alias(row))
    plain = own.filter(F.col(copy).isNotNull()).join(repeats, F.col(copy) == F.col(row), "left_anti").withColumn(place, F.col(copy))
    odd = own.filter(F.col(copy).isNull()).unionByName(own.join(repeats, F.col(copy) == F.col(row), "left_semi"))
    # numbers that no id has: above the largest or below the smallest one
    number = F.monotonically_increasing_id()
    odd = written(odd.withColumn(place, F.lit(largest or 0) + 1 + number if (largest or 0) < 1 << 62 else F.lit(least) - 1 - number), "odd_rows")
    rows = plain.unionByName(odd)
    found = near_duplicates(rows.select(F.col(place).alias("doc_id"), "text"), width, percent)
    order = F.struct(F.col("copy").isNull().alias("no_id"), F.col("copy"), F.col("t"), F.col("place"))
    keys = rows.select(F.col(place).alias("place"), F.col(copy).alias("copy"), F.xxhash64("text").alias("t")).join(found, F.col("place") == F.col("doc_id"))
    kept = keys.groupBy("component_id").agg(F.min(order).alias("o")).select(F.col("o.place").alias(row))
    return rows.join(kept, F.col(place) == F.col(row), "left_semi").select(*docs.columns)
