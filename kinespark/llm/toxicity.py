"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a text: densities of a fixed lexicon and of one learned from the labelled sample, second-person words and
how near lexicon words stand to them, capitals, punctuation, obfuscation. The trees are fitted on the driver to the
features of at most `sample_rows` labelled documents (a few numbers each); scoring is one pass over the documents.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinespark.llm.common import filter_rows, fold, keyed_text, small_batches

#: Bound of the labelled sample that the classifier is fitted to.
SAMPLE_ROWS = 20_000

# Insults and second-person words of the languages at hand.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb loser losers scum trash garbage worthless pathetic disgusting clown clowns fool jerk "
    "imbecile hate ugly vermin idiota estúpido estúpida imbécil basura asqueroso payaso inútil connard idiote stupide imbécile "
    "ordure minable dégoûtant nul dummkopf blödmann dumm abschaum müll wertlos erbärmlich widerlich versager".split()
)
SECOND_PERSON = frozenset("you your yours yourself u ur tu te ti tú usted vos vous toi ton ta tes votre du dich dir dein deine sie ihr ihnen".split())
_LEET = str.maketrans("013457@$!€", "oieastasie")

_WORD = re.compile(r"[^\W\d_]+")
_MASKED = re.compile(r"[^\W\d_]+(?:[0-9@$!*._-]+[^\W\d_]+)+")
_TABLE = 0x250  # code points of the Latin blocks; later ones count as letters


def _marks(chars: str) -> np.ndarray:
    out = np.zeros(_TABLE + 1, dtype=bool)
    out[[ord(c) for c in chars]] = True
    return out


_LETTER = np.array([chr(i).isalpha() for i in range(_TABLE)] + [True])
_CAPITAL = np.array([chr(i).isupper() for i in range(_TABLE)] + [False])
_DIGIT = _marks("0123456789")
_STRIKE = _marks("!?")
_MASK = _marks("0123456789@$!*._-")
_SPACE = np.array([chr(i).isspace() for i in range(_TABLE)] + [False])
_SHORT = 4

NAMES = [
    "log_words", "fixed_hits", "fixed_density", "fixed_kinds", "learned_hits", "learned_density", "learned_kinds", "learned_weight", "learned_top",
    "second_person_density", "near_second_person", "capitals", "capital_words", "punctuation", "shouts", "repeats", "masked", "masked_hits", "digits",
]


def terms(word: str) -> tuple[str, ...]:
    """What the learned lexicon holds of a word: the word, and its beginnings, as languages inflect."""
    n = len(word)
    if n < _SHORT:
        return (word,)
    return (word, word[:4] + "*") if n == _SHORT else (word, word[:4] + "*", word[:5] + "*")


def _weight(word: str, learned: dict[str, float]) -> float | None:
    weight = learned.get(word)
    if weight is None and len(word) >= _SHORT:
        weight = learned.get(word[:4] + "*") or learned.get(word[:5] + "*")
    return weight


def features(text: str | None, learned: dict[str, float]) -> list[float]:
    text = text or ""
    words = _WORD.findall(text.lower())
    n, chars = len(words), max(1, len(text))
    per = 100.0 / max(1, n)
    kinds = set(words)
    fixed = kinds & INSULTS
    weights = {w: v for w in kinds if (v := _weight(w, learned)) is not None}
    addressed = kinds & SECOND_PERSON
    seconds = [k for k, w in enumerate(words) if w in addressed] if addressed else []
    hits = [k for k, w in enumerate(words) if w in fixed or w in weights] if fixed or weights else []
    near = 0
    if hits and seconds:
        where = np.array(seconds)
        at = np.searchsorted(where, hits)
        gap = np.minimum(np.abs(where[np.minimum(at, len(where) - 1)] - hits), np.abs(where[np.maximum(at - 1, 0)] - hits))
        near = int((gap <= 5).sum())
    n_fixed = sum(words[k] in fixed for k in hits)
    found = [weights[words[k]] for k in hits if words[k] in weights]
    code = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), _TABLE)
    letter, capital, strike, mask = _LETTER[code], _CAPITAL[code], _STRIKE[code], _MASK[code]
    masked = int((letter[:-2] & mask[1:-1] & letter[2:]).sum())
    unmasked = 0
    if masked:
        plain = (re.sub(r"[^\w]|_", "", m.lower().translate(_LEET)) for m in _MASKED.findall(text))
        unmasked = sum(m in INSULTS or _weight(m, learned) is not None for m in plain)
    same = (code[:-2] == code[1:-1]) & (code[1:-1] == code[2:]) & letter[2:]
    shouted = int((capital[:-1] & capital[1:]).sum())
    n_letters = int(letter.sum())
    n_digits = int(_DIGIT[code].sum())
    return [
        math.log1p(n), n_fixed, n_fixed * per, len(fixed), len(found), len(found) * per, len({w[:5] for w in weights}), sum(found) * per, max(found, default=0.0),
        len(seconds) * per, near, int(capital.sum()) / chars, shouted / chars, (len(text) - n_letters - n_digits - int(_SPACE[code].sum())) / chars,
        int((strike[:-1] & strike[1:]).sum()) * per, int(same.sum()) * per, masked * per, unmasked, n_digits / chars,
    ]


# --- trees -----------------------------------------------------------------------------------------------------------


@dataclass
class Booster:
    """Boosted trees for the logistic loss: histogram splits, second-order gains, leaf shrinkage."""

    rounds: int = 80
    depth: int = 3
    rate: float = 0.15
    bins: int = 64
    ridge: float = 1.0
    least_rows: int = 8
    start: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Booster:
        n, m = x.shape
        p = (y.sum() + 0.5) / (n + 1.0)
        self.start = float(np.log(p / (1 - p)))
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) if n else np.zeros(0) for j in range(m)]
        code = np.stack([np.searchsorted(cuts[j], x[:, j], "left") for j in range(m)], axis=1) if n else np.zeros((0, m), dtype=int)
        width = self.bins + 1
        flat = code + np.arange(m) * width
        raw = np.full(n, self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            g, h = p - y, np.maximum(p * (1 - p), 1e-9)
            feature, cut = np.full(2**self.depth, -1), np.zeros(2**self.depth)
            leaf = np.zeros(2 ** (self.depth + 1))
            node = np.ones(n, dtype=np.int64)
            for at in range(1, 2**self.depth):
                rows = np.flatnonzero(node == at)
                if len(rows) < 2 * self.least_rows:
                    continue
                cells = flat[rows].ravel()
                size = m * width
                hist = [np.bincount(cells, np.repeat(v, m), size).reshape(m, width).cumsum(axis=1) for v in (g[rows], h[rows], np.ones(len(rows)))]
                gl, hl, nl = (v[:, :-1] for v in hist)
                gt, ht, nt = (v[:, -1:] for v in hist)
                gain = gl**2 / (hl + self.ridge) + (gt - gl) ** 2 / (ht - hl + self.ridge) - gt**2 / (ht + self.ridge)
                gain[(nl < self.least_rows) | (nt - nl < self.least_rows)] = 0
                j, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
                if gain[j, b] <= 1e-9 or b >= len(cuts[j]):
                    continue
                feature[at], cut[at] = j, cuts[j][b]
                node[rows] = 2 * at + (code[rows, j] > b)
            for at in np.unique(node):
                rows = node == at
                leaf[at] = -self.rate * g[rows].sum() / (h[rows].sum() + self.ridge)
            self.trees.append((feature, cut, leaf))
            raw = raw + leaf[node]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, leaf in self.trees:
            node = np.ones(len(x), dtype=np.int64)
            for _ in range(self.depth):
                inner = node < len(feature)
                f = np.where(inner, feature[np.where(inner, node, 0)], -1)
                go = f >= 0
                node[go] = 2 * node[go] + (x[rows[go], f[go]] > cut[node[go]])
            out += leaf[node]
        return out


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: knots and non-decreasing values, each smoothed by half a row of either label."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # sum, rows, lowest, highest
    for r, v in zip(raw[order].tolist(), y[order].tolist(), strict=True):
        if blocks and blocks[-1][3] == r:
            blocks[-1][0] += v
            blocks[-1][1] += 1
        else:
            blocks.append([v, 1, r, r])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, _, top = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += n
            blocks[-1][3] = top
    knots = np.array([k for b in blocks for k in (b[2], b[3])])
    values = np.maximum.accumulate(np.array([(b[0] + 0.5) / (b[1] + 1.0) for b in blocks for _ in (0, 1)])) if blocks else np.zeros(0)
    return knots, np.clip(values, 0.0, 1.0)


@dataclass
class Model:
    learned: dict[str, float]
    booster: Booster
    knots: np.ndarray
    values: np.ndarray

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        raw = self.booster.raw(np.array([features(t, self.learned) for t in texts], dtype=np.float64))
        smooth = 1 / (1 + np.exp(-np.clip(raw, -40, 40)))
        if not len(self.knots):
            return smooth
        # a thousandth of the uncalibrated score keeps the order inside the calibration's steps
        return 0.999 * np.interp(raw, self.knots, self.values) + 0.001 * smooth


def _sample(documents: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, holdout: tuple[int, int] | None, sample_rows: int) -> DataFrame:
    """Texts and labels of the sample: of the labelled ids that have a document those with the least hashes, sample_rows at
    most, one row each. An id with both labels counts as toxic; of several texts of an id the one with the least hash counts."""
    known = labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    if holdout:
        known = known.where(fold("doc_id", holdout[0]) != holdout[1])
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    known = known.join(documents.select(F.col(f"`{id_col}`").alias("doc_id")), "doc_id", "left_semi")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    # 16 bytes a row and sample_rows rows at most: small enough to send whole
    rows = documents.sparkSession.createDataFrame([(r["doc_id"], r["y"]) for r in chosen.collect()], "doc_id long, y int")
    sample = keyed_text(documents, id_col, text_col).join(F.broadcast(rows), "doc_id")
    return sample.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("y").alias("y"))


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Terms of three toxic texts or more that tell these from other texts, with their log odds. The sample bounds them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count: dict[str, list[int]] = {}
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for t in {t for w in set(_WORD.findall((text or "").lower())) for t in terms(w)}:
                    count.setdefault(t, [0, 0])[y] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array([v[0] for v in count.values()], pa.int64()), pa.array([v[1] for v in count.values()], pa.int64())], names=["term", "n0", "n1"])

    totals = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    clean, toxic = totals.get(0, 0), totals.get(1, 0)
    if not toxic or not clean:
        return {}
    odds = F.log((F.col("n1") + 0.5) / F.lit(toxic + 1.0)) - F.log((F.col("n0") + 0.5) / F.lit(clean + 1.0))
    best = sample.select("text", "y").mapInArrow(work, "term string, n0 long, n1 long").groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where(F.col("n1") >= 3).withColumn("odds", odds)
    return {r["term"]: float(r["odds"]) for r in best.where(F.col("odds") >= 2.5).orderBy("term").collect()}


def train(documents: DataFrame, labels: DataFrame, *, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", holdout: tuple[int, int] | None = (5, 0), sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit lexicon, trees and calibration to at most sample_rows labelled documents.

    Rows whose crc32(id as text) mod holdout[0] is holdout[1] are left out. The lexicon is learned from two fifths of the
    sample, the trees from two others, as the lexicon's own rows flatter its features, and the calibration from a fifth
    that neither has seen. With fewer than five rows of a label for the trees, they see the lexicon's rows as well. Without
    both labels, or without any, every score is the share of toxic rows (a half if there are none).
    """
    small_batches(documents.sparkSession)
    sample = _sample(documents, labels, label, id_col, text_col, holdout, sample_rows)
    part = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(5))
    learned = learn_lexicon(sample.where(part < 2))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t, learned) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(rows, pa.list_(pa.float64()))], names=["y", "part", "x"])

    rows = sample.select("text", "y", part.cast("int").alias("part")).mapInArrow(work, "y int, part int, x array<double>").collect()
    rows.sort(key=lambda r: (r["part"], r["y"], r["x"]))
    x = np.array([r["x"] for r in rows], dtype=np.float64).reshape(len(rows), len(NAMES))
    y = np.array([r["y"] for r in rows], dtype=np.float64)
    at = np.array([r["part"] for r in rows], dtype=np.int64)
    booster = Booster()
    # the lexicon's own rows flatter its features, so the trees see the others only
    fit, tune = (at == 2) | (at == 3), at == 4
    if min(y[fit].sum(), (1 - y[fit]).sum()) < 5:
        fit = at < 4
    if 0 < y[fit].sum() < fit.sum():
        booster.fit(x[fit], y[fit])
    else:
        booster.start = 0.0 if not len(y) else float(np.log((y.sum() + 0.5) / ((1 - y).sum() + 0.5)))
    knots, values = isotonic(booster.raw(x[tune]), y[tune]) if 0 < y[tune].sum() < tune.sum() else (np.zeros(0), np.zeros(0))
    return Model(learned, booster, knots, values)


def score(documents: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 from 0.5 on), a row for each row of documents.

    Null and empty texts are scored as a text without words; equal texts get equal scores.
    """
    small_batches(documents.sparkSession)
    shared = documents.sparkSession.sparkContext.broadcast(model)  # a bounded lexicon and a fixed number of trees

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = shared.value.scores(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())], names=["doc_id", "score", "predicted"])

    return keyed_text(documents, id_col, text_col).mapInArrow(work, "doc_id long, score double, predicted int")


def keep_clean(documents: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """Rows of documents, with all their columns, whose score is below 0.5."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    return filter_rows(documents, text_col, lambda texts: shared.value.scores(texts) < 0.5)
