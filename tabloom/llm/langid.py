"""Language identification with a blended-spectrum string kernel, Nyström landmarks and one-versus-rest kernel ridge regression.

Kernel: two texts share so many of the character n-grams (n = 1, 2, 3, each counted as present or not) of a fixed inventory,
divided by the root of the product of how many each has. Fit: at most `per_lang` rows (300) of each language outside the
held-out fold are collected, picked by a hash of the id; the inventory is their commonest `GRAMS` n-grams, `LANDMARKS` of the rows, dealt evenly over
languages, are the Nyström landmarks, and ridge regression against +1/-1 for each language is solved on the features.

Score: every whole text becomes one presence row; a batch of rows times the landmark matrix times the weights gives all decisions
in two matrix products. One narrow pass; only the bounded model is broadcast.

Edge cases: a null text or one without a letter is `und` with score 0; with nothing to learn from all are `und`; repeated rows get
equal results; ties go to the first language in order; a null id is not held out and not learned from; an empty table gives no
rows; columns other than the named ones are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import sliced
from tabloom.llm.quality import fold_of

GRAMS, LANDMARKS, RIDGE, ALPHABET = 4096, 160, 1e-2, 160
LETTER = re.compile(r"[^\W\d_]")
_tables: dict = {}


def codes(text: str, alphabet: np.ndarray) -> np.ndarray:
    """Small numbers of the characters in lower case: 0 for what is no letter, 1 for letters outside the alphabet."""
    chars = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return alphabet[np.minimum(chars, len(alphabet) - 1)]


def grams(c: np.ndarray) -> list[np.ndarray]:
    """Codes of all 1-, 2- and 3-grams; the order of a gram is in its top bits."""
    c = np.concatenate([np.zeros(1, np.uint32), c, np.zeros(1, np.uint32)]).astype(np.uint32)
    two = (c[:-1] << np.uint32(8)) | c[1:]
    return [c, two | np.uint32(1 << 24), ((two[:-1] << np.uint32(8)) | c[2:]) | np.uint32(2 << 24)] if len(c) > 2 else [c]


def presence(texts: list[str], alphabet: np.ndarray, table: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(texts), width + 1), np.float32)
    for i, t in enumerate(texts):
        row = out[i]
        for lo in range(0, max(len(t), 1), 1 << 16):  # in runs that overlap by two characters
            for g in grams(codes(t[lo : lo + (1 << 16) + 2], alphabet)):
                row[table[g]] = 1
    return out[:, :width]


def unit(b: np.ndarray) -> np.ndarray:
    return b / np.sqrt(np.maximum(b.sum(axis=1, keepdims=True), 1))


def lookup(known: np.ndarray) -> np.ndarray:
    """Column of each gram; len(known) for the others."""
    key = (len(known), zlib.crc32(known.tobytes()))
    if key not in _tables:
        _tables.clear()
        table = np.full(3 << 24, len(known), np.uint16)
        table[known] = np.arange(len(known))
        _tables[key] = table
    return _tables[key]


def fit(texts: list[str], langs: list[str]) -> dict | None:
    names = sorted(set(langs))
    if not names:
        return None
    chars: dict[str, int] = {}
    for t in texts:
        for c in set(t.lower()):
            if c.isalpha() and ord(c) < 1 << 16:
                chars[c] = chars.get(c, 0) + 1
    alphabet = np.zeros((1 << 16) + 1, np.uint32)
    alphabet[[i for i in range(1 << 16) if chr(i).isalpha()]] = 1
    alphabet[-1] = 1
    for i, c in enumerate(sorted(chars, key=lambda c: (-chars[c], c))[:ALPHABET]):
        alphabet[ord(c)] = i + 2
    seen: dict[int, int] = {}
    for t in texts:
        for g in np.unique(np.concatenate(grams(codes(t, alphabet)))).tolist():
            seen[g] = seen.get(g, 0) + 1
    known = np.array(sorted(sorted(seen, key=lambda g: (-seen[g], g))[:GRAMS]), np.int64)
    b = unit(presence(texts, alphabet, lookup(known), len(known)))
    # landmarks: the first rows of each language in turn
    place: dict[str, int] = {}
    rank = [(place.setdefault(x, 0), place.update({x: place[x] + 1}))[0] for x in langs]
    marks = b[sorted(range(len(texts)), key=lambda i: (rank[i], langs[i]))[:LANDMARKS]]
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    root = vectors / np.sqrt(np.maximum(values, 1e-4))
    phi = np.c_[(b @ marks.T).astype(np.float64) @ root, np.ones(len(b))]
    share = {x: langs.count(x) for x in names}
    weight = np.array([1 / share[x] for x in langs]) * len(langs) / len(names)
    y = np.array([[1.0 if x == n else -1.0 for n in names] for x in langs])
    w = np.linalg.solve(phi.T @ (phi * weight[:, None]) + RIDGE * np.eye(phi.shape[1]), phi.T @ (y * weight[:, None]))
    return {"names": names, "alphabet": alphabet, "known": known, "marks": np.ascontiguousarray(marks.T), "w": (root @ w[:-1]).astype(np.float32), "b": w[-1].astype(np.float32)}


def predict(texts: list[str | None], model: dict | None) -> tuple[list[str], np.ndarray]:
    names, scores = ["und"] * len(texts), np.zeros(len(texts))
    at = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
    if model and at:
        b = unit(presence([texts[i] for i in at], model["alphabet"], lookup(model["known"]), len(model["known"])))
        f = (b @ model["marks"]) @ model["w"] + model["b"]
        best = f.argmax(axis=1)
        top = np.clip((f[np.arange(len(f)), best] + 1) / 2, 0, 1)
        for i, k, s in zip(at, best, top):
            names[i], scores[i] = model["names"][k], s
    return names, scores


#: Languages whose counts are broadcast; each language sends 2 x per_lang whole texts to the driver, about.
LANGUAGES = 1_000


def learn(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_lang: int) -> dict | None:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.filter("doc_id is not null and lang is not null and text is not null").filter(fold_of(F.col("doc_id"), 4) != 2)
    share = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # about twice as many as are kept, so that each language has enough; at least `per_lang` rows are taken of a small one
    few = share.limit(LANGUAGES + 1).count() <= LANGUAGES
    picked = rows.join(F.broadcast(share) if few else share, "lang").filter(draw < F.lit(2.0 * per_lang) / F.col("n")).select("doc_id", "text", "lang")
    got: dict[str, list] = {}
    for r in sorted(picked.collect(), key=lambda r: (zlib.crc32(f"pick {r.doc_id}".encode()), r.doc_id, r.text)):
        if len(got.setdefault(r.lang, [])) < per_lang:
            got[r.lang].append(r)
    flat = [r for x in sorted(got) for r in got[x]]
    return fit([r.text for r in flat], [r.lang for r in flat])


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 300) -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score)."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, id_col, text_col, lang_col, per_lang))

    def run(batches):
        for batch in sliced(batches, 1):
            texts, names, scores = batch.column(1).to_pylist(), [], []
            for lo in range(0, len(texts), 256):
                n, s = predict(texts[lo : lo + 256], model.value)
                names += n
                scores.append(s)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(np.concatenate([np.zeros(0), *scores]))], ["doc_id", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    got = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
    return got.withColumn("held_out", F.coalesce(fold_of(F.col("doc_id"), 4) == 2, F.lit(False)))
