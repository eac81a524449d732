"""Ordinal quality classifier: cumulative-link regression on hashed text.

Ratings are 0 (poor), 1 (good but toxic), 2 (good). One weight vector over hashed features is shared by all thresholds:
P(grade <= k) = sigmoid(t_k - w.x) with t_0 < t_1, which gives the expected grade and the tail probability P(grade = 2)
by which documents are selected. Features are read from the whole text: its distinct words, and a few shares of its
words and lines, binned. Every slot seen takes part. Weights have a normal prior, narrow where a slot's presence differs
between grades by no more than chance and wide where it differs by more; its strength is chosen by cross-validation.

The model is fitted on at most SAMPLE labelled rows, those whose ids have the smallest hashes; the bound is a parameter.
"""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, own_prefix, with_results

SAMPLE = 10_000
#: Least probability of the best grade for a document to be selected: ratings hold some noise, so that clean documents lie
#: well above and those between the grades below. Where fewer labelled rows have the best grade, their share is the limit,
#: less SLACK of it for the fit's rounding: a text as good as the average labelled one is never dropped for few labels.
LEAST_TAIL = 0.8
SLACK = 0.01
SLOTS = 1 << 18
GRADES = 3
#: Strengths of the prior to choose from by FOLDS-fold cross-validation, strongest first, and the prior variance of a slot
#: that says nothing, as a share of one with z^2 = 2 (chance alone gives 1).
STRENGTHS, FOLDS, FLOOR = (300.0, 30.0, 3.0), 3, 0.01
#: A fit ends with a step that lowers the loss by less than this share.
TOLERANCE = 1e-4
TOKEN, LETTERS = re.compile(WORD), re.compile(r"[^\W\d_]+")
SYMBOL = re.compile(r"[#*$%&|<>]")


def _bin(x: float) -> int:
    """Bins of a share: 0, and then by powers of two of a percent."""
    return 0 if x <= 0 else 1 + int(np.clip(np.log2(max(x, 1e-9) * 100) + 1, 0, 9))


def features(text: str | None) -> np.ndarray:
    """Distinct hashed slots of a whole text."""
    text = text or ""
    tokens = TOKEN.findall(text)
    n = max(len(tokens), 1)
    found = [f"w:{w}" for w in set(LETTERS.findall(text.lower()))]
    lines = [x for x in text.split("\n") if x.strip()]
    shares = {
        "symbol": sum(SYMBOL.search(w) is not None for w in tokens) / n,
        "upper": sum(len(w) > 1 and w.isupper() for w in tokens) / n,
        "digit": sum(any(map(str.isdigit, w)) for w in tokens) / n,
        "mark": (text.count("!") + text.count("?")) / n,
        "repeat": 1 - len(set(tokens)) / n,
        "again": sum(a == b for a, b in zip(tokens, tokens[1:], strict=False)) / n,
        "line": 1 - len(set(lines)) / max(len(lines), 1),
    }
    found += [f"s:{k}:{_bin(v)}" for k, v in shares.items()]
    found.append(f"n:{int(np.log2(len(tokens) + 1))}")
    return np.unique(np.fromiter((zlib.crc32(f.encode("utf-8", "replace")) & (SLOTS - 1) for f in found), np.int32, len(found)))


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray
    base: float = 1.0  # share of the best grade among the rows of the fit

    def predict(self, rows: Iterable[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade and probability of the best grade of each row of slots."""
        score = np.array([self.weights[x].sum() for x in rows], float)
        above = 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -50, 50)))
        return above.sum(axis=1), above[:, -1]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def _dot(a: np.ndarray, b: np.ndarray) -> float:
    """The same as a @ b, in one thread: the driver's other cores belong to others."""
    return float((a * b).sum())


def _minimum(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int = 100, memory: int = 8, tol: float = TOLERANCE) -> np.ndarray:
    """L-BFGS with step halving; f gives value and gradient."""
    (v, g), pairs = f(x), []
    for _ in range(steps):
        d, back = -g, []
        for s, y, r in reversed(pairs):
            back.append(_dot(s, d) * r)
            d = d - back[-1] * y
        d = d * (1 / (pairs[-1][2] * _dot(pairs[-1][1], pairs[-1][1])) if pairs else 1 / max(math.sqrt(_dot(g, g)), 1))
        for (s, y, r), a in zip(pairs, reversed(back), strict=True):
            d = d + s * (a - _dot(y, d) * r)
        t, slope = 1.0, _dot(g, d)
        while slope < 0 and t > 1e-8:
            new = x + t * d
            nv, ng = f(new)
            if nv <= v + 1e-4 * t * slope:
                break
            t /= 2
        else:
            return x
        s, y = new - x, ng - g
        if (sy := _dot(s, y)) > 1e-12 * _dot(y, y):
            pairs = [*pairs, (s, y, 1 / sy)][-memory:]
        done = v - nv < tol * abs(v)
        x, v, g = new, nv, ng
        if done:
            break
    return x


def _models(rows: list[np.ndarray], grades: np.ndarray, strengths: Sequence[float] = STRENGTHS) -> Iterator[OrdinalModel]:
    """Fits under the strengths in turn, each begun at the one before; the order of thresholds is kept by fitting the logs
    of their gaps."""
    sizes = np.array([len(x) for x in rows])
    n, of_row, starts = len(rows), np.repeat(np.arange(len(rows)), sizes), np.cumsum(sizes) - sizes
    slots, cols = np.unique(np.concatenate(rows), return_inverse=True)
    k, seen, z2 = len(slots), np.bincount(cols), np.zeros(len(slots))
    often = np.argsort(-seen, kind="stable")  # slots of many rows lie together in memory
    slots, seen, cols = slots[often], seen[often], np.argsort(often)[cols]
    for g in range(GRADES):
        share = (grades == g).mean()
        if 0 < share < 1:
            hit = np.bincount(cols[grades[of_row] == g], minlength=k)
            z2 = np.maximum(z2, (hit - seen * share) ** 2 / (seen * share * (1 - share) + 1))  # 1: rare slots don't stand out by luck
    each = np.empty(len(cols))  # one number for each slot of each row, written over at every step
    share = np.clip(np.cumsum(np.bincount(grades, minlength=GRADES))[:-1] / n, 1e-3, 1 - 1e-3)
    start = np.log(share / (1 - share))
    p = first = np.concatenate([np.zeros(k), [start[0]], np.log(np.maximum(np.diff(start), 1e-2))])
    wide = np.sqrt(FLOOR + np.maximum(z2 - 1, 0))  # p[:k] are weights by their prior's widths, which takes fewer steps
    for strength in strengths:
        narrow = np.concatenate([np.full(k, strength), np.full(GRADES - 1, 0.01)])

        def loss(p: np.ndarray, narrow: np.ndarray = narrow) -> tuple[float, np.ndarray]:
            gaps = np.exp(np.minimum(p[k + 1 :], 50))
            t = np.concatenate([[-np.inf], p[k] + np.concatenate([[0], np.cumsum(gaps)]), [np.inf]])
            s = np.add.reduceat(np.take(p[:k] * wide, cols, out=each, mode="clip"), starts)  # every row has slots
            up, lo = _sigmoid(t[grades + 1] - s), _sigmoid(t[grades] - s)
            prob = np.maximum(up - lo, 1e-12)
            du, dl = up * (1 - up) / prob, lo * (1 - lo) / prob
            dt = np.array([dl[grades == g + 1].sum() - du[grades == g].sum() for g in range(GRADES - 1)])
            grad = np.concatenate([np.bincount(cols, np.take(du - dl, of_row, out=each, mode="clip"), minlength=k) * wide, [dt.sum()], [dt[j + 1 :].sum() * gaps[j] for j in range(len(gaps))]])
            return 0.5 * (narrow * (p - first) ** 2).sum() - np.log(prob).sum(), grad + narrow * (p - first)

        p = _minimum(loss, p)
        weights = np.zeros(SLOTS, np.float32)
        weights[slots] = p[:k] * wide
        yield OrdinalModel(weights, p[k] + np.concatenate([[0], np.cumsum(np.exp(p[k + 1 :]))]), float((grades == GRADES - 1).mean()))


def _surprise(model: OrdinalModel, rows: list[np.ndarray], grades: np.ndarray) -> float:
    """Minus the log-likelihood of rows."""
    s, t = np.array([model.weights[x].sum() for x in rows], float), np.concatenate([[-np.inf], model.thresholds, [np.inf]])
    return -float(np.log(np.maximum(_sigmoid(t[grades + 1] - s) - _sigmoid(t[grades] - s), 1e-12)).sum())


def fit(rows: list[np.ndarray], grades: np.ndarray) -> OrdinalModel:
    """Largest posterior under the prior whose strength predicts rows left out best (the strongest for a single row)."""
    fold, found = np.random.default_rng(0).permutation(len(rows)) % FOLDS, np.zeros(len(STRENGTHS))
    for f in range(FOLDS):
        own, out = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
        if len(own) and len(out):
            left = [rows[i] for i in out]
            found += [_surprise(model, left, grades[out]) for model in _models([rows[i] for i in own], grades[own])]
    return next(itertools.islice(_models(rows, grades), int(np.argmin(found)), None))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _features(text: pd.Series) -> pd.Series:
    return pd.Series([features(t) for t in text])


def graded(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, grade): the lowest rating of each id; rows without an id or quality don't count, and a null toxic is 0."""
    grade = F.when(F.col("quality") == 0, 0).when(F.coalesce("toxic", F.lit(0)) == 1, 1).otherwise(2)
    return labels.filter(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(id_col).agg(F.min(grade).alias("grade"))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> OrdinalModel | None:
    """The model fitted on at most `sample` labelled rows; None if no row is labelled. Of several texts of one id, the first in
    order counts."""
    chosen = graded(labels, id_col).orderBy(F.xxhash64(id_col), id_col).limit(sample)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen.select(F.col(id_col).alias("id"), "grade")), "id")
    rows = rows.groupBy("id", "grade").agg(F.min("text").alias("text"))
    got = rows.select("id", "grade", _features(F.col("text")).alias("x")).toPandas().sort_values("id")
    return fit([np.asarray(x, np.int32) for x in got["x"]], got["grade"].to_numpy(int)) if len(got) else None


def rating(docs: DataFrame, model: OrdinalModel | None, text: Column) -> Column:
    """struct(expected_grade, tail_probability) of a text column; nulls without a model."""
    if model is None:
        return F.struct(F.lit(None).cast("double").alias("expected_grade"), F.lit(None).cast("double").alias("tail_probability"))
    held = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS weights, 1 MB

    @F.pandas_udf("expected_grade double, tail_probability double")
    def rate(texts: pd.Series) -> pd.DataFrame:
        expected, tail = held.value.predict(features(t) for t in texts)
        return pd.DataFrame({"expected_grade": expected, "tail_probability": tail})

    return rate(text)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_tail: float = LEAST_TAIL, sample: int = SAMPLE) -> DataFrame:
    """docs with expected_grade, tail_probability and kept (tail_probability of at least least_tail, or of the share of
    the best grade among the labelled rows where that is less).

    Texts without words (null, empty) are not kept. Equal texts get equal ratings, however often they come; features of very
    long texts are those of the whole text. Without any labelled row the ratings are null and every text with words is
    kept. An empty table gives an empty result; columns of the three names, in whatever case, are replaced, and all others
    stay, whatever their names.
    """
    model = train(docs, labels, id_col, text_col, sample)
    limit = min(least_tail, (1 - SLACK) * model.base) if model else least_tail
    own = own_prefix(docs)
    rated = docs.withColumn(own, rating(docs, model, F.col(text_col)))
    tail = F.col(f"{own}.tail_probability")
    has_words = F.coalesce(F.col(text_col).rlike(WORD), F.lit(False))
    return with_results(rated, own, {"expected_grade": F.col(f"{own}.expected_grade"), "tail_probability": tail, "kept": has_words & F.coalesce(tail >= limit, F.lit(True))})
