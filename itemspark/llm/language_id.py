"""The language of a text by the nearest of several centroids per language.

A text becomes lower-case words of letters with one space around each; its
letter n-grams are hashed to a fixed number of features, weighted by
``(1 + log(count)) * idf`` and brought to length one.

Learning: document frequencies come from all rows given. Of each language about
``per_language`` rows, drawn by a hash of id and text, are clustered around
``clusters`` centroids by cosine; a centroid's radius is the largest distance of
its own rows. At most ``languages`` languages are learned, those of most rows.
These three are the bounds of the fit; they also bound what is broadcast
(``languages * clusters * FEATURES`` numbers of four bytes at most).

Prediction: the centroid of largest cosine tells the language, and the cosine is
the score. A text farther from it than its radius is rejected: it keeps the
nearest language as a guess, with a score of 0.

Cases: null texts and texts without a letter are ``und`` with a score of 0, and
so is every text where nothing could be learned; a text that shares no feature
with any centroid is rejected, the language of most rows is the guess; very long
texts are counted in pieces and used whole; equal cosines go to the language of
more rows, then the smaller name; a null id is not held out; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from itemspark.llm.arrays import mix, stretches
from itemspark.session import ship

ship(__name__)

FEATURES = 1 << 14
GRAMS = (1, 2, 3)
UNKNOWN = "und"
_U = np.uint64
#: Texts whose features are held at once, and characters of a piece of a long text.
_TEXTS = 128
_PIECE = 1 << 20
_ROUNDS = 10


def words_only(text: str) -> np.ndarray:
    """Code points of the lower-cased words of letters, one space around each; empty without letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    seen, back = np.unique(points, return_inverse=True)
    letter = np.array([chr(p).isalpha() for p in seen.tolist()], bool)[back] if len(seen) else np.zeros(0, bool)
    padded = np.concatenate(([32], np.where(letter, points, 32), [32])).astype(np.uint32)
    keep = np.ones(len(padded), bool)
    keep[1:] = (padded[1:] != 32) | (padded[:-1] != 32)
    out = padded[keep]
    return out if len(out) > 1 else out[:0]


def _grams(points: np.ndarray, edges: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Start and feature of every n-gram that stays inside its text (``edges``: the text of each point)."""
    spread = mix(points.astype(_U) + _U(0x51ED270B))
    for n in GRAMS:
        count = len(points) - n + 1
        if count <= 0:
            continue
        with np.errstate(over="ignore"):
            h = np.zeros(count, _U)
            for j in range(n):
                h = h * _U(0xD1342543DE82EF95) + spread[j : j + count]
            feature = (mix(h + _U(n)) % _U(FEATURES)).astype(np.int64)
        inside = edges[:count] == edges[n - 1 :]
        if n == 1:
            inside &= points != 32
        at = np.nonzero(inside)[0]
        yield at, feature[at]


def counts_of(texts: list[np.ndarray]) -> np.ndarray:
    """How often each text has each feature."""
    total = np.zeros(len(texts) * FEATURES, np.float32)
    few, size = [], 0
    # texts are joined to pieces of bounded size; a longer one is cut into pieces that overlap by an n-gram less one
    pieces: list[list[tuple[int, np.ndarray]]] = []
    for i, t in enumerate(texts):
        if len(t) > _PIECE:
            for a in range(0, len(t), _PIECE):
                pieces.append([(i, t[a : a + _PIECE + max(GRAMS) - 1])])
            continue
        few.append((i, t))
        size += len(t)
        if size > _PIECE:
            pieces.append(few)
            few, size = [], 0
    pieces.append(few)
    for piece in pieces:
        if not piece:
            continue
        points = np.concatenate([t for _, t in piece])
        edges = np.repeat([i for i, _ in piece], [len(t) for _, t in piece])
        cut = len(piece) == 1 and len(piece[0][1]) > _PIECE
        for at, feature in _grams(points, edges):
            if cut:  # n-grams that start in the overlap belong to the next piece
                feature, at = feature[at < _PIECE], at[at < _PIECE]
            total += np.bincount(edges[at] * FEATURES + feature, minlength=len(total))
    return total.reshape(len(texts), FEATURES)


def _texts(column: pa.Array) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """(first row, end row, words) of up to ``_TEXTS`` texts at a time."""
    for at, end, data, offsets in stretches(column):
        raw = data.tobytes()
        for a in range(at, end, _TEXTS):
            b = min(a + _TEXTS, end)
            yield a, b, [words_only(raw[offsets[i - at] : offsets[i - at + 1]].decode("utf-8", "replace")) for i in range(a, b)]


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    out = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * idf
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return (out / np.maximum(norm, 1e-12)).astype(np.float32)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: in how many texts each feature is."""
    total = np.zeros(FEATURES, np.int64)
    for batch in batches:
        for _, _, texts in _texts(batch.column("text")):
            total += (counts_of(texts) > 0).sum(axis=0)
    used = np.nonzero(total)[0]
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["feature", "n"])


def _vectors(idf: np.ndarray):
    """Per text with letters: its language and its features with their weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in _texts(batch.column("text")):
                rows = _weighted(counts_of(texts), idf)
                full = [i for i, t in enumerate(texts) if len(t)]
                used = [np.nonzero(rows[i])[0].astype("<i4") for i in full]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("lang").slice(a, b - a).take(pa.array(full, pa.int64())), pa.array([u.tobytes() for u in used], pa.binary()), pa.array([rows[i][u].tobytes() for i, u in zip(full, used, strict=True)], pa.binary())],
                    ["lang", "features", "weights"],
                )

    return run


def cluster(rows: np.ndarray, clusters: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centroids of length one by cosine, their number of rows, and the largest distance (1 - cosine) of their rows."""
    mean = rows.mean(axis=0)
    start = [int(np.argmax(rows @ mean))]
    while len(start) < min(clusters, len(rows)):
        start.append(int(np.argmin((rows @ rows[start].T).max(axis=1))))
    centers = rows[start].copy()
    own = np.zeros(len(rows), np.int64)
    for _ in range(_ROUNDS):
        own = np.argmax(rows @ centers.T, axis=1)
        for c in range(len(centers)):
            if (own == c).any():
                middle = rows[own == c].mean(axis=0)
                centers[c] = middle / max(float(np.linalg.norm(middle)), 1e-12)
    near = rows @ centers.T
    own = np.argmax(near, axis=1)
    size = np.bincount(own, minlength=len(centers))
    far = np.array([float((1 - near[own == c, c]).max()) if size[c] else 0.0 for c in range(len(centers))])
    return centers[size > 0], size[size > 0], far[size > 0]


def _clusters(clusters: int):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["features", "weights"])  # the order of arrival does not count
        rows = np.zeros((len(part), FEATURES), np.float32)
        for i, (f, w) in enumerate(zip(part["features"], part["weights"], strict=True)):
            rows[i, np.frombuffer(f, "<i4")] = np.frombuffer(w, "<f4")
        centers, _, far = cluster(rows, clusters)
        return pd.DataFrame({"lang": part["lang"].iloc[0], "cluster": np.arange(len(centers), dtype="int32"), "center": [c.astype("<f4").tobytes() for c in centers], "radius": far})

    return run


def learn(labelled: DataFrame, clusters: int = 4, per_language: int = 2000, languages: int = 500) -> dict:
    """Features' weights, centroids with language and radius from rows with ``doc_id``, ``text`` and non-null ``lang``."""
    spark = labelled.sparkSession
    rows = labelled.select(F.col("lang").cast("string").alias("lang"), "text", F.xxhash64(F.col("doc_id").cast("string"), "text").alias("h"))
    seen = np.zeros(FEATURES, np.int64)
    for r in rows.select("text").mapInArrow(_frequencies, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect():  # one row per feature
        seen[r["feature"]] = r["n"]
    most = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "lang").limit(languages).collect()
    order = {r["lang"]: k for k, r in enumerate(most)}
    idf = np.log((1 + sum(r["n"] for r in most)) / (1 + seen)) + 1
    # about per_language rows of each language are drawn by their hash, and twice as many at most
    shares = spark.createDataFrame([(r["lang"], min(1.0, per_language / r["n"])) for r in most], "_lang string, share double")
    unit = F.pmod("h", F.lit(1 << 30)) / float(1 << 30)
    drawn = rows.join(F.broadcast(shares), F.col("lang") == F.col("_lang")).filter(unit < F.col("share")).select("lang", "text", "h")
    bounded = drawn.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("h", "text"))).filter(F.col("k") <= 2 * per_language)
    vectors = bounded.select("lang", "text").mapInArrow(_vectors(idf), "lang string, features binary, weights binary")
    found = vectors.groupBy("lang").applyInPandas(_clusters(clusters), "lang string, cluster int, center binary, radius double").collect()
    found.sort(key=lambda r: (order[r["lang"]], r["cluster"]))
    centers = np.array([np.frombuffer(r["center"], "<f4") for r in found], np.float32).reshape(len(found), FEATURES)
    return {"idf": idf, "centers": centers, "names": [r["lang"] for r in found], "radius": np.array([r["radius"] for r in found])}


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, centers, names, radius = model.value
        for batch in batches:
            passed = [batch.column(k) for k in range(batch.num_columns - 1)]
            for a, b, texts in _texts(batch.column("text")):
                lang, score, rejected = [UNKNOWN] * (b - a), [0.0] * (b - a), [True] * (b - a)
                if len(names):
                    near = _weighted(counts_of(texts), idf) @ centers.T
                    best = np.argmax(near, axis=1)
                    for i, t in enumerate(texts):
                        if len(t):
                            lang[i], cosine = names[best[i]], min(1.0, max(0.0, float(near[i, best[i]])))
                            rejected[i] = cosine <= 0 or 1 - cosine > radius[best[i]] + 1e-6
                            score[i] = 0.0 if rejected[i] else cosine
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(a, b - a) for c in passed), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                    [*batch.schema.names[:-1], "lang_pred", "score", "rejected"],
                )

    return run


def predict(rows: DataFrame, model: dict, passed: list[str], text: str = "text") -> DataFrame:
    """The columns ``passed`` with ``lang_pred``, ``score`` and ``rejected``."""
    sent = rows.sparkSession.sparkContext.broadcast((model["idf"], model["centers"], model["names"], model["radius"]))
    types = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in passed)
    return rows.select(*passed, text).mapInArrow(_predict(sent), f"{types}, lang_pred string, score double, rejected boolean")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, clusters: int = 4, per_language: int = 2000, languages: int = 500) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score`` and ``rejected`` of every row; held-out rows are not learned from."""
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang", "text")
    model = learn(rows.filter("NOT held_out AND lang IS NOT NULL AND text IS NOT NULL"), clusters, per_language, languages)
    return predict(rows, model, ["doc_id", "held_out"])
