"""Quality classifier: random-indexing word vectors pooled per document, a two-layer numpy network, calibrated by temperature.

Fit: labelled rows outside the held-out fold, at most `sample` of them (2,400; picked by a hash of the id so that the
bound is the same at any size), are collected once. Each token has a sparse ternary index vector; a word vector adds the index vectors
of its neighbours within two tokens, and every token also has the index vector of its shape (upper case, title, digits,
punctuation and so on), which is all that an unknown token has. A document is the mean over its tokens, the mean over its distinct
tokens and four plain figures of repetition and length. The network sees standardised pools; a temperature, fitted on a
fold it was not trained on, scales its logits.

Score: one narrow pass over every whole text; only the model (a bounded vocabulary) is broadcast. Nothing is shuffled.

Edge cases: null, empty and blank texts are scored like any other, from zero pools; repeated rows get equal scores; a null id
is never held out and never trained on; labels that contradict each other count by their maximum; with no usable label every score
is 0.5; an empty table gives no rows; columns other than the named ones are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import sliced

TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
DIM, NONZERO, VOCABULARY, HIDDEN = 96, 8, 20_000, 32
SHAPES = ("lower", "upper", "title", "mixed", "digits", "letter", "mark", "marks")


def shape(token: str) -> int:
    if token.isalpha():
        if len(token) == 1:
            return 5
        return 0 if token.islower() else 1 if token.isupper() else 2 if token.istitle() else 3
    return 4 if token.isdigit() else 6 if len(token) == 1 else 7


def index_vector(name: str) -> np.ndarray:
    rng = np.random.default_rng(zlib.crc32(name.encode()))
    v = np.zeros(DIM, np.float32)
    v[rng.choice(DIM, NONZERO, replace=False)] = rng.choice([-1, 1], NONZERO)
    return v


def word_vectors(texts: list[str]) -> tuple[dict[str, int], np.ndarray]:
    """Numbers of the known tokens, and the vectors: of the shapes first, then of the tokens."""
    split = [TOKEN.findall(t) for t in texts]
    counts: dict[str, int] = {}
    for tokens in split:
        for t in tokens:
            counts[t] = counts.get(t, 0) + 1
    known = sorted((t for t, n in counts.items() if n > 1), key=lambda t: (-counts[t], t))[:VOCABULARY]
    ids = {t: i + len(SHAPES) for i, t in enumerate(known)}
    shapes = np.array([index_vector(f"shape {s}") for s in SHAPES])
    index = np.concatenate([shapes, np.array([index_vector(t) for t in known], np.float32).reshape(-1, DIM)])
    where = np.argsort(-np.abs(index), axis=1, kind="stable")[:, :NONZERO]
    sign = np.take_along_axis(index, where, axis=1)
    context = np.zeros(index.size)
    for tokens in split:
        seq = np.array([ids.get(t, -1) for t in tokens] or [-1])
        seq = np.where(seq < 0, [shape(t) for t in tokens] or [0], seq)
        for gap in (1, 2):
            for a, b in ((seq[:-gap], seq[gap:]), (seq[gap:], seq[:-gap])):
                if len(a):
                    np.add.at(context, (a[:, None] * DIM + where[b]).ravel(), sign[b].ravel())
    context = context.reshape(index.shape).astype(np.float32)
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-6)
    vectors = unit(index) + unit(context)
    vectors[: len(SHAPES)] = unit(shapes)
    if known:
        vectors[len(SHAPES) :] += unit(shapes)[[shape(t) for t in known]]
    return ids, vectors.astype(np.float32)


def pooled(text: str, ids: dict[str, int], vectors: np.ndarray) -> np.ndarray:
    tokens = TOKEN.findall(text)
    out = np.zeros(2 * DIM + 4, np.float32)
    if not tokens:
        return out
    get = ids.get
    seq = [get(t, -1) for t in tokens]
    new = [shape(t) for t, i in zip(tokens, seq) if i < 0]
    full = np.array(seq)
    n = np.bincount(full[full >= 0], minlength=0)
    at = np.flatnonzero(n)
    weights = n[at].astype(np.float32)
    rare = np.bincount(new, minlength=len(SHAPES)).astype(np.float32)
    base = vectors[: len(SHAPES)]
    rows = vectors[at]
    out[:DIM] = (weights @ rows + rare @ base) / len(tokens)
    out[DIM : 2 * DIM] = (rows.sum(axis=0) + rare @ base) / (len(at) + len(new))
    distinct = len(set(tokens))
    out[2 * DIM :] = (np.log1p(len(tokens)), distinct / len(tokens), (weights.max() if len(at) else 1) / len(tokens), len(text) / len(tokens) / 10)
    return out


def train(x: np.ndarray, y: np.ndarray, epochs: int = 60, seed: int = 1) -> list[np.ndarray]:
    """Adam on the log loss of a tanh layer and a linear one, with weight decay."""
    rng = np.random.default_rng(seed)
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), 64):
            b = order[lo : lo + 64]
            h = np.tanh(x[b] @ p[0] + p[1])
            err = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - y[b]) / len(b)
            back = np.outer(err, p[2]) * (1 - h * h)
            grads = [x[b].T @ back + 2e-3 * p[0], back.sum(axis=0), h.T @ err + 2e-3 * p[2], err.sum(keepdims=True)]
            step += 1
            for a, g, mm, vv in zip(p, grads, m, v):
                mm += 0.1 * (g - mm)
                vv += 0.001 * (g * g - vv)
                a -= 2e-3 * (mm / (1 - 0.9**step)) / (np.sqrt(vv / (1 - 0.999**step)) + 1e-8)
    return p


def logits(x: np.ndarray, p: list[np.ndarray]) -> np.ndarray:
    return np.tanh(x @ p[0] + p[1]) @ p[2] + p[3]


def temperature(z: np.ndarray, y: np.ndarray) -> float:
    grid = np.geomspace(0.25, 16, 121)
    loss = [np.mean(np.logaddexp(0, -z / t * (2 * y - 1))) for t in grid]
    return float(grid[int(np.argmin(loss))])


def fit(texts: list[str], y: np.ndarray, fold: np.ndarray) -> dict | None:
    """The model; rows where fold is true set the temperature, the others train."""
    if not len(y) or y.min() == y.max():
        return None
    ids, vectors = word_vectors([t for t, f in zip(texts, fold) if not f] or texts)
    x = np.array([pooled(t, ids, vectors) for t in texts], np.float64)
    own = ~fold if (~fold).any() and len(set(y[~fold])) == 2 else np.ones(len(y), bool)
    mean, scale = x[own].mean(axis=0), x[own].std(axis=0) + 1e-3
    x = np.clip((x - mean) / scale, -6, 6)
    p = train(x[own], y[own])
    heat = temperature(logits(x[fold], p), y[fold]) if fold.sum() >= 20 else 1.0
    return {"ids": ids, "vectors": vectors, "mean": mean, "scale": scale, "net": p, "heat": heat}


def score_texts(texts: list[str], model: dict | None) -> np.ndarray:
    if model is None:
        return np.full(len(texts), 0.5)
    x = np.array([pooled(t, model["ids"], model["vectors"]) for t in texts], np.float64).reshape(len(texts), -1)
    x = np.clip((x - model["mean"]) / model["scale"], -6, 6)
    return 1 / (1 + np.exp(-np.clip(logits(x, model["net"]) / model["heat"], -30, 30)))


def fold_of(col, folds: int):
    """crc32 of the id as text, modulo folds."""
    return F.pmod(F.crc32(F.encode(col.cast("string"), "UTF-8")), F.lit(folds))


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_id: str, label_col: str, sample: int) -> dict | None:
    one = labels.select(F.col(label_id).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)")
    one = one.filter(fold_of(F.col("doc_id"), 5) != 0).groupBy("doc_id").agg(F.max("y").alias("y"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # ids first: the labelled rows of docs may be fewer than the labels, so some spare ones are drawn
    picked = one.join(texts.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(sample)
    # of a repeated id one text, the last, so that no more than `sample` texts reach the driver
    found = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y").agg(F.max("text").alias("text"))
    rows = sorted(found.collect(), key=lambda r: zlib.crc32(f"order {r.doc_id}".encode()))
    fold = np.array([zlib.crc32(str(r.doc_id).encode()) % 5 == 1 for r in rows], bool)
    return fit([r.text or "" for r in rows], np.array([r.y for r in rows], np.float64), fold)


def score_quality(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality", threshold: float = 0.3, sample: int = 2400, keep: tuple[str, ...] = ()
) -> DataFrame:
    """docs' id (as doc_id), the columns of keep, held_out, score and predicted."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, id_col=id_col, text_col=text_col, label_id=label_id, label_col=label_col, sample=sample))

    def run(batches):
        for batch in sliced(batches, "__text"):
            texts = [t or "" for t in batch.column("__text").to_pylist()]
            scores = np.concatenate([score_texts(texts[lo : lo + 256], model.value) for lo in range(0, len(texts), 256)] or [np.zeros(0)])
            names = [n for n in batch.schema.names if n != "__text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(scores)], [*names, "score"])

    ident = F.col(id_col).alias("doc_id")
    base = docs.select(ident, *[F.col(c) for c in keep if c != id_col], F.col(text_col).cast("string").alias("__text"))
    out = base.drop("__text").schema.add("score", "double")
    scored = base.mapInArrow(run, out)
    held = F.coalesce(fold_of(F.col("doc_id"), 5) == 0, F.lit(False))
    return scored.withColumns({"held_out": held, "predicted": (F.col("score") >= threshold).cast("int")})
