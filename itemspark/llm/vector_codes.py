"""Vectors as short codes: one codebook per part, fitted by exact rounds in whole numbers.

A component becomes ``floor(scale * x)``; a vector is cut into equal consecutive
parts. A codebook starts as that part of the vectors of smallest id; a round
assigns every part to its nearest entry and moves each entry to the floor of its
parts' mean.

LAESA: a few fixed pivots per part position (start entries far from each other)
are measured against all parts once, and the distances are written with the
vectors. A round measures only pivots against entries; ``|d(x, p) - d(p, e)|``
bounds d(x, e) from below, entries are tried in the order of that bound, and a
part is done when the bound passes its best exact distance. Bounds are lowered
by a slack for rounding, distances that decide are whole numbers.

Per task a round sends one sum per entry, place and 32-bit limb, so sums are
exact at any size; the codebooks (``entries`` times the vector's length) are all
that comes to the driver.

Cases: vectors that are null or hold null or non-finite components are left out;
the length of most vectors counts (the smaller on ties), vectors of another
length keep their row with null code and error; a length that the parts do not
divide gives the first parts one place less; fewer vectors than entries start
smaller codebooks; null ids come last in the start order, equal ids by their
vector; repeated rows count each; equal labels include null; an error beyond a
long is null; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemspark.llm.common import spread_join, written
from itemspark.session import ship

ship(__name__)

#: Numbers held at once when parts are compared with entries.
_HELD = 1 << 22
#: Entries tried per step, after the order of their bounds.
_STEPS = (4, 12, 48)
_SLACK = 1e-9
#: Components up to here keep squared distances of 2**20 places inside a long.
_PLAIN = 1 << 20
#: Labels whose sums are broadcast; the others are shuffled.
HOT_LABELS = 1000


def whole(values: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)``, as longs where distances of those surely fit, as Python numbers otherwise."""
    if np.abs(values).max(initial=0) * scale < _PLAIN:
        return np.floor(values * scale).astype(np.int64)
    exact = np.frompyfunc(lambda x: math.floor(x * scale) if abs(x) < 2.0**52 else int(x) * scale, 1, 1)
    return exact(values).astype(object)


def _as_numbers(rows: list[list[int]]) -> np.ndarray:
    small = all(abs(x) < _PLAIN for r in rows for x in r)
    return np.array(rows, np.int64 if small else object)


def _square(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances along the last axis."""
    if a.dtype == object or b.dtype == object:
        a, b = a.astype(object), b.astype(object)
    gap = a - b
    return (gap * gap).sum(axis=-1) if gap.shape[-1] else np.zeros(gap.shape[:-1], np.int64)


def _root(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64))


def far_pivots(entries: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` entries, each the farthest from those before it (the first of equals)."""
    chosen = [0]
    least = _root(_square(entries, entries[0]))
    while len(chosen) < min(n, len(entries)):
        chosen.append(int(np.argmax(least)))
        least = np.minimum(least, _root(_square(entries, entries[chosen[-1]])))
    return entries[chosen]


def nearest(parts: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, pivots_to_entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index and exact squared distance of the nearest entry (the lowest of equals), and how many distances were evaluated."""
    n, m = len(parts), len(entries)
    index, tried = np.zeros(n, np.int64), 0
    best = np.full(n, None, object) if object in (parts.dtype, entries.dtype) else np.full(n, np.iinfo(np.int64).max)
    bound = np.zeros((n, m))
    for p in range(to_pivots.shape[1]):
        a, b = to_pivots[:, p, None], pivots_to_entries[None, p]
        with np.errstate(invalid="ignore"):
            low = np.abs(a - b) - _SLACK * (a + b)
        np.fmax(bound, low, out=bound)
    order = np.argsort(bound, axis=1, kind="stable")
    bound = np.take_along_axis(bound, order, axis=1) ** 2
    open_rows, at = np.arange(n), 0
    for step in (*_STEPS, m):
        end = min(at + step, m)
        if at == end or not len(open_rows):
            break
        columns = order[open_rows, at:end]
        squares = _square(parts[open_rows, None, :], entries[columns])
        tried += squares.size
        least = squares.min(axis=1)
        lowest = np.where(squares == least[:, None], columns, m).min(axis=1)
        before, held = best[open_rows], index[open_rows]
        better = np.ones(len(open_rows), bool) if at == 0 else ((least < before) | ((least == before) & (lowest < held))).astype(bool)
        best[open_rows] = np.where(better, least, before)
        index[open_rows] = np.where(better, lowest, held)
        at = end
        if at < m:
            open_rows = open_rows[bound[open_rows, at] <= best[open_rows].astype(np.float64)]
    return index, best, tried


def _rows(cuts: list[int], entries: int) -> int:
    """Rows of a stretch, by the widest part."""
    return max(1, min(1024, _HELD // (max(1, entries) * max(1, *np.diff(cuts)))))


def _blocks(batch: pd.DataFrame, cuts: list[int], pivots: list[np.ndarray], books: list[np.ndarray], scale: int):
    """Per stretch of rows: the rows, and per part its numbers, indexes and distances."""
    links = [_root(_square(p[:, None, :], b[None])) for p, b in zip(pivots, books, strict=True)]
    step = _rows(cuts, len(books[0]))
    for at in range(0, len(batch), step):
        rows = batch.iloc[at : at + step]
        values = np.stack(rows["v"].to_numpy()).astype(np.float64)
        gaps = np.stack(rows["gaps"].to_numpy()).reshape(len(rows), len(pivots), -1)
        parts = [whole(values[:, a:b], scale) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        yield rows, parts, [nearest(x, gaps[:, k], books[k], links[k]) for k, x in enumerate(parts)]


def _measure(cuts: list[int], pivots: list[np.ndarray], scale: int):
    """Adds the distances of every part to the pivots of its place."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = _rows(cuts, len(pivots[0]))
        for batch in batches:
            for at in range(0, len(batch), step):
                rows = batch.iloc[at : at + step]
                values = np.stack(rows["v"].to_numpy()).astype(np.float64)
                gaps = [_root(_square(whole(values[:, a:b], scale)[:, None, :], p[None])) for a, b, p in zip(cuts[:-1], cuts[1:], pivots, strict=True)]
                yield rows.assign(gaps=list(np.concatenate(gaps, axis=1)))

    return run


def _limbs(values: np.ndarray) -> list[np.ndarray]:
    """Whole numbers as longs of 32 bits each, the last one signed."""
    out = []
    while True:
        low = values & 0xFFFFFFFF
        values = values >> 32
        if not values.size or all(-(1 << 30) < x < 1 << 30 for x in (values.min(), values.max())):
            return [*out, low.astype(np.int64), values.astype(np.int64)]
        out.append(low.astype(np.int64))


def _sums(cuts: list[int], pivots: list[np.ndarray], books: list[np.ndarray], scale: int):
    """Per task: for every entry and place the sum of its parts, and their count at place -1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, int], np.ndarray] = {}
        count = [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            for _, parts, found in _blocks(batch, cuts, pivots, books, scale):
                for k, (x, (index, _, _)) in enumerate(zip(parts, found, strict=True)):
                    count[k] += np.bincount(index, minlength=len(books[k]))
                    for limb, low in enumerate(_limbs(x)):
                        np.add.at(held.setdefault((k, limb), np.zeros(books[k].shape, np.int64)), index, low)
        for k, n in enumerate(count):
            used = np.nonzero(n)[0]
            yield pd.DataFrame({"part": k, "entry": used, "place": -1, "limb": 0, "value": n[used]})
        for (k, limb), total in held.items():
            entry, place = np.nonzero(total)
            yield pd.DataFrame({"part": k, "entry": entry, "place": place, "limb": limb, "value": total[entry, place]})

    return run


def _moved(books: list[np.ndarray], sums: list) -> list[np.ndarray]:
    """The entries at the floor of their parts' means; unused ones stay."""
    total: dict[tuple[int, int, int], int] = {}
    for r in sums:
        at = (r["part"], r["entry"], r["place"])
        total[at] = total.get(at, 0) + (int(r["value"]) << (32 * r["limb"] if r["place"] >= 0 else 0))
    out = []
    for k, book in enumerate(books):
        rows = []
        for e, entry in enumerate(book.tolist()):
            n = total.get((k, e, -1), 0)
            rows.append([total.get((k, e, j), 0) // n for j in range(len(entry))] if n else entry)
        out.append(_as_numbers(rows).reshape(book.shape))
    return out


def _codes(cuts: list[int], pivots: list[np.ndarray], books: list[np.ndarray], scale: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rows, _, found in _blocks(batch, cuts, pivots, books, scale):
                code = ["".join(f"{i:02x}" for i in row) for row in zip(*(index for index, _, _ in found), strict=True)]
                error = [int(sum(int(d) for d in row)) for row in zip(*(best for _, best, _ in found), strict=True)]
                yield pd.DataFrame({"id": rows["id"], "label": rows["label"], "code": code, "error": pd.array([e if e < 1 << 63 else None for e in error], "Int64")})

    return run


def fit_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``id``, ``label`` and ``v`` of the vectors that take part."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), v.alias("v"), odd.alias("odd"))
    return rows.filter(F.col("v").isNotNull() & ~F.col("odd")).drop("odd")


def learn(fit: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, pivots: int = 16):
    """The measured vectors (a written table) with cuts, pivots and final codebooks; none where no vector has a length."""
    sizes = fit.filter(F.size("v") > 0).groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "dim").first()
    if sizes is None:
        return None
    dim = sizes["dim"]
    cuts = [dim * k // parts for k in range(parts + 1)]
    whole_ones = fit.filter(F.size("v") == dim)
    start = whole_ones.orderBy(F.col("id").isNull(), "id", "v").select("v").limit(entries).collect()  # as many rows as entries
    first = np.array([r["v"] for r in start], np.float64)
    books = [_as_numbers(whole(first[:, a:b], scale).tolist()).reshape(len(first), b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    fixed = [far_pivots(b, pivots) for b in books]
    types = dict(fit.dtypes)
    measured = written(whole_ones.mapInPandas(_measure(cuts, fixed, scale), f"id {types['id']}, label {types['label']}, v array<double>, gaps array<double>"), "vectors")
    for _ in range(rounds):
        sums = measured.select("v", "gaps").mapInPandas(_sums(cuts, fixed, books, scale), "part int, entry int, place int, limb int, value long")
        # bounded by the codebooks: entries times places times limbs
        books = _moved(books, sums.groupBy("part", "entry", "place", "limb").agg(F.sum(F.col("value").cast("decimal(19,0)")).alias("value")).collect())
    return measured, cuts, fixed, books


def books_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(x)) for b in books for entry in b.tolist() for x in entry).encode()).hexdigest()


def with_label_errors(coded: DataFrame) -> DataFrame:
    """Adds the error of all rows of the same label (nulls together); ``coded`` is read several times."""
    total = F.expr("try_cast(sum(cast(error AS decimal(38,0))) AS bigint)")
    sums = coded.groupBy(F.col("label").alias("_label")).agg(total.alias("label_error"), F.count(F.lit(1)).alias("_rows"))
    joined = spread_join(coded, sums, {"label": "_label"}, "_rows", HOT_LABELS)
    return joined.select("id", "code", "error", "label_error")


def compress(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, pivots: int = 16) -> DataFrame:
    """``id``, ``code``, ``error``, ``label_error`` and ``codebooks_sha256`` of every vector that takes part."""
    fit = fit_vectors(vectors)
    types = dict(fit.dtypes)
    unfit = fit.select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"), F.size("v").alias("dim"))
    learned = learn(fit, parts, entries, rounds, scale, pivots)
    if learned is None:
        coded, digest = unfit.drop("dim"), books_digest([])
    else:
        measured, cuts, fixed, books = learned
        made = measured.mapInPandas(_codes(cuts, fixed, books, scale), f"id {types['id']}, label {types['label']}, code string, error long")
        coded, digest = written(made.unionByName(unfit.filter(F.col("dim") != cuts[-1]).drop("dim")), "codes"), books_digest(books)
    return with_label_errors(coded).withColumn("codebooks_sha256", F.lit(digest))
