"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinespark.llm.common import fold, keyed_text, small_batches, spread

BUCKETS = 1 << 15
SIZES = (1, 2, 3)
SMOOTHING = 0.5
#: Most languages that a model may have: with BUCKETS it bounds the matrix that is broadcast (some 250 MB).
MOST_LANGUAGES = 1000
#: Characters that are hashed together.
TOGETHER = 1 << 20


def _hashed(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Buckets of the n-grams of texts, where each text's begin, and the first text's number; a bounded part at a time."""
    a, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= TOGETHER or k == len(texts) - 1:
            yield *_grams(texts[a : k + 1]), a
            a, size = k + 1, 0


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    padded = [f" {t.lower()} " for t in texts]
    code = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    offsets = np.r_[0, np.cumsum(list(map(len, padded)))]
    n = len(code)
    out = np.empty((n, len(SIZES)), dtype=np.uint32)
    mixed = code * np.uint32(0x9E3779B1)
    rolling = np.zeros(n, dtype=np.uint32)
    for j in range(max(SIZES)):
        # the n-gram that begins here, one character longer; those over the end of a text hash the next text's padding
        rolling = rolling * np.uint32(31) + np.roll(mixed, -j)
        if j + 1 in SIZES:
            h = rolling ^ (rolling >> np.uint32(15))
            h = (h + np.uint32(j)) * np.uint32(0x85EBCA6B)
            out[:, SIZES.index(j + 1)] = (h >> np.uint32(16)) & np.uint32(BUCKETS - 1)
            for k in range(1, j + 1):  # no n-gram crosses a text's end
                out[offsets[1:] - k, SIZES.index(j + 1)] = BUCKETS
    return out.ravel(), offsets * len(SIZES)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # (BUCKETS + 1, langs); the last row is 0
    prior: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        lang, score = ["und"] * len(texts), np.zeros(len(texts))
        if not self.langs:
            return lang, score
        rows = [k for k, t in enumerate(texts) if has_letter(t)]
        for grams, offsets, first in _hashed([texts[k] for k in rows]):
            logs = np.stack([np.add.reduceat(self.weights[:, c][grams], offsets[:-1]) for c in range(len(self.langs))], axis=1) + self.prior
            best = logs.argmax(axis=1)
            p = np.exp(logs - logs.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            for i, b in enumerate(best.tolist()):
                lang[rows[first + i]] = self.langs[b]
                score[rows[first + i]] = p[i, b]
        return lang, score


def train(documents: DataFrame, *, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", holdout: tuple[int, int] | None = (4, 2)) -> Model:
    """Count n-grams by language over all rows with a language, but for those held out by crc32(id as text).

    Partitions add up to one dense row of counts for each language and task, which Spark sums; the driver gets the
    sums only. Without any row to learn from, the model knows no language and predicts `und`.
    """
    small_batches(documents.sparkSession)
    rows = documents.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang")).where("lang is not null and text is not null")
    if holdout:
        rows = rows.where(F.col("id").isNull() | (fold("id", holdout[0]) != holdout[1]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
                into = counts.setdefault(lang, np.zeros(BUCKETS + 1, dtype=np.int64))
                docs[lang] = docs.get(lang, 0) + len(own)
                for grams, _, _ in _hashed(own):
                    into += np.bincount(grams, minlength=BUCKETS + 1)
            if len(counts) > MOST_LANGUAGES:
                raise ValueError(f"more than {MOST_LANGUAGES} languages")
        for lang, c in counts.items():
            at = np.flatnonzero(c[:BUCKETS])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(at) + 1), pa.string()), pa.array(np.r_[-1, at], pa.int64()), pa.array(np.r_[docs[lang], c[at]], pa.int64())], names=["lang", "bucket", "n"])

    sums = spread(rows.select("text", "lang"), documents).mapInArrow(work, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = sums.toArrow()
    names, buckets, n = found.column("lang").combine_chunks().dictionary_encode(), found.column("bucket").to_numpy(), found.column("n").to_numpy()
    known = names.dictionary.to_pylist()
    langs = sorted(known)
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    column = np.array([langs.index(x) for x in known], dtype=np.int64)[names.indices.to_numpy()]
    counts = np.zeros((BUCKETS + 1, len(langs)))
    docs = np.zeros(len(langs))
    own = buckets >= 0
    counts[buckets[own], column[own]] = n[own]
    docs[column[~own]] = n[~own]
    smooth = counts + SMOOTHING
    weights = np.log(smooth / smooth[:BUCKETS].sum(axis=0))
    weights[BUCKETS] = 0.0
    return Model(langs, np.asfortranarray(weights.astype(np.float32)), np.log(docs / docs.sum()) if len(langs) else docs)


def predict(documents: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score): the likeliest language and its posterior, a row for each row of documents.

    Null texts and texts without a letter are `und` with score 0; equal posteriors go to the first language by name.
    """
    small_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)  # BUCKETS x MOST_LANGUAGES numbers at most

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = shared.value.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return keyed_text(documents, id_col, text_col).mapInArrow(work, "doc_id long, lang_pred string, score double")
