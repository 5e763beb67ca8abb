"""Quality classifier by co-training: a text view and a page-metadata view teach each other.

The text view sees hashed byte trigrams of the whole text. The metadata view sees what is known
about the page without reading words: source, language, length and layout (lines, line length,
shares of upper case, digits, symbols, white space). Both are ridge logistic regressions. In every
round each view labels the unlabelled documents it is surest of, in the proportion of the classes,
for the other view. Both views are then calibrated on labels held out from training (Platt), and a
last regression on the calibrated log-odds combines them.

The fit works on a bounded, hashed sample of labelled and unlabelled documents; every document is
scored, from its whole text, in one pass without a shuffle.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aisleworks.llm.common import encoded, map_arrow, materialised, slices, text_of

#: Hashed byte trigrams of the text view.
BUCKETS = 512
#: Bounds of the sample the classifiers are fitted on: labelled and unlabelled documents.
LABELLED, POOL = 3000, 3000
ROUNDS = 3
#: Share of the pool that a view labels in one round, and how sure it must be.
SHARE, SURE = 0.1, 0.95
#: Documents whose combined probability of good quality is below this are rejected.
THRESHOLD = 0.5
RIDGE = 1.0
_NAMES = 16


def _table(characters: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=np.int64)
    out[list(characters)] = 1
    return out


_LAYOUT = (
    _table(bytes(range(65, 91))), _table(bytes(range(97, 123))), _table(b"0123456789"), _table(b"#*$%&|<>"),
    _table(b".,;:!?"), _table(b" \t\r\x0b\x0c"), _table(b"\n"), _table(bytes(range(128, 256))),
)


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), dtype=np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)


def _trigrams(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and text of every trigram inside a text, and the number of trigrams of each text."""
    n = np.maximum(np.diff(edges) - 2, 0)
    owner = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(owner)) + np.repeat(edges[:-1] - (np.cumsum(n) - n), n)
    wide = data.astype(np.uint32)
    code = (wide[at] << np.uint32(16)) | (wide[at + 1] << np.uint32(8)) | wide[at + 2]
    return ((code * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int64), owner, n


def text_features(texts: list[bytes]) -> np.ndarray:
    """Trigram frequencies, one row per text."""
    out = np.zeros((len(texts), BUCKETS), dtype=np.float32)
    for i, text in enumerate(texts):
        code, _, n = _trigrams(*_joined([text]))
        if n[0]:
            out[i] = np.bincount(code, minlength=BUCKETS) / n[0]
    return out


def page_features(texts: list[bytes], sources: list[str | None], langs: list[str | None]) -> np.ndarray:
    """Length, layout, and hashed source and language; one row per text."""
    import zlib

    data, edges = _joined(texts)
    size = np.diff(edges)
    columns = [np.log1p(size)]
    for table in _LAYOUT:
        sums = np.concatenate(([0], np.cumsum(table[data])))
        columns.append((sums[edges[1:]] - sums[edges[:-1]]) / np.maximum(size, 1))
        if table[10]:
            columns.append(np.log1p(size / (sums[edges[1:]] - sums[edges[:-1]] + 1)))
    names = np.zeros((len(texts), 2 * _NAMES))
    for shift, values in ((0, sources), (_NAMES, langs)):
        for i, value in enumerate(values):
            names[i, shift + (0 if value is None else 1 + zlib.crc32(value.encode()) % (_NAMES - 1))] = 1.0
    return np.column_stack([*columns, names]).astype(np.float32)


# --- fitting -----------------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = 12) -> np.ndarray:
    """Weights of a ridge logistic regression (the last one is the constant), by Newton steps."""
    x = np.column_stack((x, np.ones(len(x), dtype=x.dtype)))
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(steps):
        p = _sigmoid(x @ w)
        gradient = x.T @ (p - y) + penalty * w
        curve = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(penalty)
        move = np.linalg.solve(curve, gradient)
        w -= move
        if np.abs(move).max() < 1e-6:
            break
    return w


def _odds(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def _sure(p: np.ndarray, free: np.ndarray, good_share: float, share: float, sure: float) -> tuple[np.ndarray, np.ndarray]:
    """The surest documents among ``free``, at most their class's part of ``share``; their labels."""
    room = max(2, int(len(p) * share))
    picked = []
    for confidence, part in ((p, good_share), (1 - p, 1 - good_share)):
        order = np.argsort(-np.where(free, confidence, -1), kind="stable")[: max(1, round(room * part))]
        picked.append(order[(confidence[order] >= sure) & free[order]])
    return np.concatenate(picked), np.concatenate((np.ones(len(picked[0])), np.zeros(len(picked[1]))))


def cotrain(text: np.ndarray, page: np.ndarray, quality: np.ndarray, rounds: int = ROUNDS, share: float = SHARE, sure: float = SURE) -> dict:
    """Fit both views; ``quality`` is 1, 0 or NaN (unlabelled). Every fifth label calibrates only."""
    known = np.flatnonzero(~np.isnan(quality))
    prior = float(quality[known].mean()) if len(known) else 1.0
    held = known[::5]
    train = np.setdiff1d(known, held)
    if len(set(quality[held].tolist())) < 2 or len(set(quality[train].tolist())) < 2:
        held = train = known  # too few labels to hold any out
    if len(set(quality[known].tolist())) < 2:
        return {"prior": prior}
    views, scales = [text.astype(np.float64), page.astype(np.float64)], []
    for i, x in enumerate(views):
        mean, spread = x.mean(axis=0), x.std(axis=0)
        scales.append((mean, np.where(spread > 1e-9, spread, np.inf)))
        views[i] = (x - mean) / scales[i][1]
    pool = np.flatnonzero(np.isnan(quality))
    taught = [quality.copy(), quality.copy()]
    for y in taught:
        y[held if len(held) < len(known) else []] = np.nan
    weights = [None, None]
    for step in range(rounds + 1):
        for v in (0, 1):
            have = ~np.isnan(taught[v])
            weights[v] = logistic(views[v][have], taught[v][have])
        if step == rounds or not len(pool):
            break
        for v in (0, 1):
            other = taught[1 - v]
            chosen, labels = _sure(_sigmoid(_odds(views[v][pool], weights[v])), np.isnan(other[pool]), prior, share, sure)
            other[pool[chosen]] = labels
    calibration, calibrated = [], []
    for v in (0, 1):
        odds = _odds(views[v][held], weights[v])
        calibration.append(logistic(odds[:, None], quality[held], ridge=0.1))
        calibrated.append(_odds(odds[:, None], calibration[v]))
    both = logistic(np.column_stack(calibrated), quality[held], ridge=0.1)
    flat = []
    for v in (0, 1):  # scale, view and calibration are linear: fold them into one weight per feature
        mean, spread = scales[v]
        w = weights[v][:-1] / spread
        flat.append((calibration[v][0] * w, calibration[v][0] * (weights[v][-1] - mean @ w) + calibration[v][1]))
    return {"prior": prior, "text": flat[0], "page": flat[1], "both": both}


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", labelled: int = LABELLED, pool: int = POOL, seed: int = 3) -> dict:
    """Fit on at most ``labelled`` and ``pool`` documents, chosen by the hash of their id."""
    order = F.xxhash64(F.lit(seed), F.col("_id"))
    known = (
        labels.where(F.col("quality").isNotNull()).select(F.col(id_column).alias("_id"), "quality").where("_id IS NOT NULL")
        .groupBy("_id").agg(F.min("quality").cast("double").alias("_quality")).orderBy(order, "_id").limit(labelled)
    )
    known = materialised(known, "labelled-sample")
    others = (
        docs.select(F.col(id_column).alias("_id")).where("_id IS NOT NULL").join(F.broadcast(known), "_id", "left_anti").distinct()
        .orderBy(order, "_id").limit(pool).withColumn("_quality", F.lit(None).cast("double"))
    )
    chosen = materialised(known.unionByName(others), "sample")  # at most labelled + pool rows
    rows = (
        docs.select(F.col(id_column).alias("_id"), text_of().alias("_text"), F.col("source").cast("string").alias("_source"), F.col("lang").cast("string").alias("_lang"))
        .join(F.broadcast(chosen), "_id")
    )

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            texts = encoded(batch, "_text")
            text, page = text_features(texts), page_features(texts, batch.column("_source").to_pylist(), batch.column("_lang").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_quality"), pa.array([r.tobytes() for r in text], pa.binary()), pa.array([r.tobytes() for r in page], pa.binary())],
                names=["_id", "_quality", "_text", "_page"],
            )

    schema = T.StructType([rows.schema["_id"], T.StructField("_quality", T.DoubleType()), T.StructField("_text", T.BinaryType()), T.StructField("_page", T.BinaryType())])
    sample = map_arrow(rows, features, schema).groupBy("_id").agg(F.min(F.struct("_quality", "_text", "_page")).alias("s")).select("_id", "s.*")

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = pd.concat([pd.DataFrame({"_id": [], "_quality": [], "_text": [], "_page": []}), *frames]).sort_values("_id")
        model = {"prior": 1.0}
        if len(got):
            stack = lambda c: np.frombuffer(b"".join(got[c]), dtype=np.float32).reshape(len(got), -1)
            model = cotrain(stack("_text"), stack("_page"), got["_quality"].to_numpy(dtype=float))
        yield pd.DataFrame({"model": [pickle.dumps(model)]})

    # One task holds the bounded sample; the model is a few kilobytes.
    return pickle.loads(bytes(sample.repartition(1).mapInPandas(learn, "model binary").first()[0]))


def score_batch(model: dict, texts: list[bytes], sources: list[str | None], langs: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Calibrated probabilities of the text view, the metadata view and both."""
    if "both" not in model:
        flat = np.full(len(texts), model["prior"])
        return flat, flat, flat
    code, owner, n = _trigrams(*_joined(texts))
    w, constant = model["text"]
    text = np.bincount(owner, weights=w[code], minlength=len(texts)) / np.maximum(n, 1) + constant
    page = page_features(texts, sources, langs) @ model["page"][0] + model["page"][1]
    return _sigmoid(text), _sigmoid(page), _sigmoid(_odds(np.column_stack((text, page)), model["both"]))


def scored(docs: DataFrame, model: dict, threshold: float = THRESHOLD, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` columns of every row with text_score, page_score, score and kept (score >= threshold)."""
    schema = T.StructType([*[docs.schema[c] for c in carry], *[T.StructField(c, T.DoubleType()) for c in ("text_score", "page_score", "score")]])
    kept = [f"_c{i}" for i in range(len(carry))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            scores = score_batch(model, encoded(batch, "_text"), batch.column("_source").to_pylist(), batch.column("_lang").to_pylist())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *[pa.array(s, pa.float64()) for s in scores]], names=[f.name for f in schema])

    rows = docs.select(
        *[F.col(c).alias(k) for c, k in zip(carry, kept)], text_of().alias("_text"),
        F.col("source").cast("string").alias("_source"), F.col("lang").cast("string").alias("_lang"),
    )
    return map_arrow(rows, run, schema).withColumn("kept", F.col("score") >= threshold)


def classify(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", threshold: float = THRESHOLD, carry: tuple[str, ...] | None = None) -> DataFrame:
    """Scores of every row of ``docs``, learned from ``labels`` (id, quality 1 or 0).

    One row per row of ``docs``: ``carry`` (the id by default), text_score, page_score and score
    (calibrated probabilities of good quality) and kept. Null texts count as empty and are scored
    from their metadata and the constant of the text view; null sources and languages are values
    of their own. Null ids are scored but never learned from. Contradicting labels of one id count
    as 0, null labels as none. Labels of one class only, or none, give every row the share of
    good labels (1 without labels). Repeated rows stay; empty tables give no rows; other columns
    are ignored.
    """
    return scored(docs, fit(docs, labels, id_column), threshold, carry or (id_column,))
