"""Toxicity by a classifier chain.

The categories are predicted one after the other.  Each has a logistic regression over the words of a
text, and a later one also sees the probabilities that the earlier ones give.  When the later model is
trained, those inputs are out-of-fold predictions: each labelled text is judged by models that were
fitted without its fold, as every new text will be.  The labels at hand have two categories, so the chain
is ``low_quality`` (quality 0), then ``toxic``.

A text's features are its distinct lower-case words and their prefixes of 3 to 8 letters, hashed by
CRC-32, each present or absent, so one insult counts as much in a long text as in a short one.  The
models keep the features whose presence differs most significantly between the two classes.

The models are fitted in the driver on at most ``SAMPLE`` labelled texts, the ones whose ids hash
lowest; scoring runs over all whole texts.  The threshold is the one with the best F1 of the out-of-fold
predictions among those of at least ``PRECISION``.

Defined cases: null and wordless texts have no features and get the probability of the intercept; null
labels are left out; a category without both classes gets a constant probability and rejects nothing;
repeated rows are judged alike; empty tables give empty results; other columns pass through untouched.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from rowloom.llm.common import table, tidy

CATEGORIES = ("low_quality", "toxic")
SAMPLE, FOLDS, KEPT = 4000, 5, 4096
#: Least out-of-fold precision of the threshold; if none has it, nothing is rejected.
PRECISION = 0.8
#: Distinct words whose features a worker remembers; the table is emptied when full.
REMEMBERED = 200_000
#: Rows that are scored at once.
_ROWS = 512
_WORD = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> set[int]:
    return {zlib.crc32(word[:n].encode()) for n in range(3, min(8, len(word)) + 1)} | {zlib.crc32(b"=" + word.encode())}


def _features(text: str | None) -> bytes:
    words = set(_WORD.findall((text or "").lower()))
    return np.array(sorted(set().union(*map(word_features, words))), np.uint32).tobytes()


def _probability(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-logit))


class LinearModel:
    """L2-regularised logistic regression on selected binary features and some dense inputs.

    ``sets`` holds, for each text, indexes into ``names``, the features' hashes.
    """

    def __init__(self, sets: list[np.ndarray], names: np.ndarray, dense: np.ndarray, y: np.ndarray, kept: int = KEPT, steps: int = 80):
        self.bias, self.weight, self.dense_weight = 0.0, {}, np.zeros(dense.shape[1])
        n, pos = len(y), int(y.sum())
        if not 0 < pos < n:
            self.bias = 12.0 if pos and pos == n else -12.0
            return
        flat, row = np.concatenate([*sets, np.zeros(0, np.int64)]), np.repeat(np.arange(n), [len(s) for s in sets])
        seen = np.bincount(flat, minlength=len(names))
        inside = np.bincount(flat[y[row] > 0], minlength=len(names))
        rate = seen / n
        z = (inside / pos - (seen - inside) / (n - pos)) / np.sqrt(np.maximum(rate * (1 - rate), 1e-9) * (1 / pos + 1 / (n - pos)))
        z[(seen < 4) | (np.abs(z) < 3)] = 0
        best = np.argsort(-np.abs(z), kind="stable")[:kept]
        best = best[z[best] != 0]
        slot = np.full(len(names), -1)
        slot[best] = np.arange(len(best))
        col = slot[flat]
        row, col = row[col >= 0], col[col >= 0]
        w, dw, b = np.zeros(len(best)), np.zeros(dense.shape[1]), float(np.log(pos / (n - pos)))
        gw, gd, gb = np.full(len(best), 1e-8), np.full(len(dw), 1e-8), 1e-8
        for _ in range(steps):  # AdaGrad on the whole sample
            p = 1 / (1 + np.exp(-np.clip(b + np.bincount(row, weights=w[col], minlength=n) + dense @ dw, -30, 30)))
            e = p - y
            d = np.bincount(col, weights=e[row], minlength=len(w)) + 0.5 * w
            dd, db = dense.T @ e + 0.5 * dw, e.sum()
            gw, gd, gb = gw + d * d, gd + dd * dd, gb + db * db
            w, dw, b = w - 0.3 * d / np.sqrt(gw), dw - 0.3 * dd / np.sqrt(gd), b - 0.3 * db / np.sqrt(gb)
        self.bias, self.dense_weight = float(b), dw
        self.weight = dict(zip(names[best].tolist(), w.tolist(), strict=True))

    def predict(self, sets: list[np.ndarray], names: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """Log-odds of texts given as indexes into ``names``."""
        by_index = np.array([self.weight.get(f, 0.0) for f in names.tolist()])
        return np.clip(self.bias + np.array([by_index[s].sum() for s in sets]) + dense @ self.dense_weight, -30, 30)

    def logit(self, present, dense) -> float:
        weight = self.weight
        got = self.bias + sum(weight[f] for f in present if f in weight) + float(np.dot(self.dense_weight, dense))
        return min(30.0, max(-30.0, got))


class Chain:
    """One model for each category; ``threshold`` is for the last one."""

    def __init__(self, sets: list[np.ndarray], labels: np.ndarray, folds: int = FOLDS):
        n = len(sets)
        names, seen = np.unique(np.concatenate([*sets, np.zeros(0, np.uint32)]), return_counts=True)
        names = names[seen >= 4]  # rarer features are never kept
        sets = [np.searchsorted(names, s[np.isin(s, names, assume_unique=True)]).astype(np.int32) for s in sets]
        fold, self.models, odds, made = np.arange(n) % folds, [], np.zeros((n, 0)), np.zeros((n, 0))
        for c in range(labels.shape[1]):
            y, out = labels[:, c].astype(float), np.zeros(n)
            for f in range(folds):
                fit, rest = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
                model = LinearModel([sets[i] for i in fit], names, made[fit], y[fit])
                out[rest] = model.predict([sets[i] for i in rest], names, made[rest])
            self.models.append(LinearModel(sets, names, made, y))
            odds, made = np.column_stack([odds, out]), np.column_stack([made, _probability(out)])
        self.out_of_fold = odds
        self.threshold = self._threshold(odds[:, -1], labels[:, -1]) if n else 31.0

    @staticmethod
    def _threshold(logit: np.ndarray, y: np.ndarray) -> float:
        if not 0 < y.sum() < len(y):
            return 31.0
        order = np.argsort(-logit, kind="stable")
        hits, best = np.cumsum(y[order]), logit[order]
        f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
        f1[:-1][best[:-1] == best[1:]] = 0  # equal scores can't be parted
        f1[hits < PRECISION * np.arange(1, len(y) + 1)] = 0
        k = int(np.argmax(f1))
        if not f1[k]:
            return 31.0
        return float((best[k] + best[k + 1]) / 2 if k + 1 < len(best) else best[k])

    def logits(self, present) -> list[float]:
        made: list[float] = []
        for model in self.models:
            made.append(model.logit(present, _probability(np.array(made))))
        return made


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Chain:
    """Fit the chain on at most ``sample`` labelled texts."""
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
    known = known.groupBy("doc_id").agg(F.max((F.col("quality") == 0).cast("int")).alias("low_quality"), F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id"), F.col("text").alias("__text")).join(F.broadcast(chosen), "doc_id")

    def run(batches):
        for b in batches:
            made = pa.array([_features(t) for t in b.column("__text").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("doc_id", "low_quality", "toxic")] + [made], names=["doc_id", "low_quality", "toxic", "f"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, low_quality int, toxic int, f binary"
    found = rows.withColumn("toxic", F.col("toxic").cast("int")).select("doc_id", "__text", "low_quality", "toxic").mapInArrow(tidy(run), schema)
    # Repeated rows of an id count once, so the driver gets ``sample`` rows at most.
    once = found.groupBy("doc_id").agg(F.min("f").alias("f"), F.max("low_quality").alias("low_quality"), F.max("toxic").alias("toxic"))
    rows = sorted(once.collect(), key=lambda r: r.doc_id)
    sets = [np.frombuffer(bytes(r.f), np.uint32) for r in rows]
    return Chain(sets, np.array([(r.low_quality, int(r.toxic > 0)) for r in rows], np.int64).reshape(-1, len(CATEGORIES)))


class _Scorer:
    def __init__(self, chain: Chain):
        self.chain, self.names = chain, sorted(set().union(*(m.weight for m in chain.models)))
        self.slot = {name: i for i, name in enumerate(self.names)}
        self.of: dict[str, tuple] = {}  # of slots, whose numbers all words share

    def logits(self, text: str | None) -> list[float]:
        present: set[int] = set()
        of, slot, names = self.of, self.slot, self.names
        for word in set(_WORD.findall((text or "").lower())):
            got = of.get(word)
            if got is None:
                if len(of) >= REMEMBERED:
                    of.clear()
                got = of[word] = tuple([slot[f] for f in word_features(word) if f in slot])
            if got:
                present.update(got)
        return self.chain.logits([names[i] for i in sorted(present)])


def score(df: DataFrame, chain: Chain, text_col: str = "text", prefix: str = "") -> DataFrame:
    """``df`` with a probability for each category (``p_...``) and ``rejected``; ``prefix`` goes before these
    names, and columns of ``df`` that have them are replaced."""
    shared = df.sparkSession.sparkContext.broadcast(chain)  # KEPT weights for each category
    added = [f"{prefix}{c}" for c in (*(f"p_{c}" for c in CATEGORIES), "rejected")]
    df = df.drop(*added)
    at = df.columns.index(text_col)
    names = [*df.columns, *added]

    def run(batches):
        scorer = _Scorer(shared.value)
        limit = shared.value.threshold
        for b in (b.slice(i, _ROWS) for b in batches for i in range(0, b.num_rows, _ROWS)):
            made = np.array([scorer.logits(t) for t in b.column(at).to_pylist()]).reshape(-1, len(CATEGORIES))
            odds = [pa.array(_probability(made[:, c])) for c in range(len(CATEGORIES))]
            yield pa.RecordBatch.from_arrays([*b.columns, *odds, pa.array(made[:, -1] >= limit)], names=names)

    fields = [StructField(c, BooleanType() if c == added[-1] else DoubleType()) for c in added]
    return df.mapInArrow(tidy(run), StructType([*df.schema.fields, *fields]))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels), prefix="__").filter("NOT __rejected").select(*[f"`{c}`" for c in docs.columns])


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    """doc_id, the probabilities of both categories and the decision for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", "p_low_quality", F.col("p_toxic").alias("toxic_score"), F.col("rejected").alias("toxic"))
