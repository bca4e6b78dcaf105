"""Toxic passages as maximum-scoring segments of token log-odds."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from itertools import pairwise
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.llm.common import crc_mod, documents, labelled_sample, labels, map_batches, platt

TOKEN = re.compile(r"[^\W_]+")
#: Lengths of the word beginnings that stand in for a word too rare to have odds of its own, longest first.
STEMS = (7, 6, 5, 4, 3)
#: Words whose odds a task remembers before it forgets them all: a bound on memory, without effect on results.
MEMO = 200_000


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


def units(word: str) -> list[str]:
    """The word and its beginnings, from the most specific; a beginning is marked by a star."""
    return [word, *(f"{word[:k]}*" for k in STEMS if k < len(word))]


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence, by the linear scan of Ruzzo and Tompa (1999).

    Only tokens above zero can begin or end a segment, so runs between them are taken by their sum.
    """
    up = np.flatnonzero(scores > 0)
    if not len(up):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    stack: list[tuple[int, int, float, float, int]] = []  # start, end, sum left of it, sum up to its end, nearest with less to its left
    for i in up.tolist():
        start, end, left, right, j = i, i + 1, float(total[i]), float(total[i + 1]), len(stack) - 1
        while True:
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= right:
                break
            start, _, left, _, before = stack[j]
            del stack[j:]
            j = before
        stack.append((start, end, left, right, j))
    return [(a, b, r - x) for a, b, x, r, _ in stack]


@dataclass
class ToxicModel:
    """``odds``: log-odds, less ``drift``, of every word and word beginning met in enough documents. A word takes those of
    its most specific known unit, ``-drift`` if none is. ``rate`` is the extreme-value rate of clean text's segments."""

    odds: dict[str, float]
    drift: float
    rate: float
    evidence: float
    slope: float = 1.0
    offset: float = 0.0

    def __post_init__(self):
        self.memo: dict[str, float] = {}

    def odd(self, word: str) -> float:
        found = self.memo.get(word)
        if found is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            found = self.memo[word] = next((self.odds[u] for u in units(word) if u in self.odds), -self.drift)
        return found

    def passages(self, words: list[str]) -> list[tuple[int, int, float]]:
        """Every significant passage (start, end, log of how unlikely its score is among as many clean words, with the
        constant K of Karlin and Altschul taken as one: the logistic curve behind it takes up a constant factor)."""
        if not words:
            return []
        scores = np.fromiter(map(self.odd, words), np.float64, len(words))
        floor = np.log(len(words))
        found = ((a, b, self.rate * s - floor) for a, b, s in maximal_segments(scores))
        return [(a, b, e) for a, b, e in found if e > self.evidence]

    def x(self, words: list[str]) -> float:
        return float(np.log1p(sum(e - self.evidence for _, _, e in self.passages(words))))

    def score(self, words: list[str]) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.x(words) + self.offset, -30, 30))))


def fit(texts: list[str], y: list[int], prior_share: float = 0.05, least_docs: int = 3, drift: float = 0.05, evidence: float = 0.0, positive_share: float = 0.1, seed: int = 5) -> ToxicModel:
    """Log-odds with an informative Dirichlet prior (Monroe et al. 2008), the extreme-value rate of clean text, and a
    logistic curve on a held fifth. The prior is ``prior_share`` of both classes' counts together. Words are counted once a document, so that one text's repeats weigh as one."""
    rng, y = np.random.default_rng(seed), np.asarray(y)
    order = rng.permutation(len(texts))
    held, train = order[: len(order) // 5], order[len(order) // 5 :]
    count: dict[int, Counter] = {0: Counter(), 1: Counter()}
    # Copies with small changes share their least word pair, and weigh as one document together.
    family = [min((crc32(f"{a} {b}".encode()) for a, b in pairwise(tokens(texts[i]))), default=-1 - int(i)) for i in train]
    copies = Counter(family)
    for i, f in zip(train, family, strict=True):
        found = {u for w in set(tokens(texts[i])) for u in units(w)}
        if copies[f] == 1:
            count[int(y[i])].update(found)
        else:
            for u in found:
                count[int(y[i])][u] += 1 / copies[f]
    n = {c: max(1, sum(count[c].values())) for c in (0, 1)}
    both = count[0] + count[1]
    share = float(np.clip((y[train] == 1).mean() if len(train) else 0.5, 1e-3, 1 - 1e-3))
    # A unit counts if its documents' split between the classes would be a surprise among a tenth of the units.
    surprise = np.log(max(20, sum(seen >= least_docs for seen in both.values())) / 10)
    prior = {c: prior_share * (n[0] + n[1]) for c in (0, 1)}
    odds = {}
    for w, seen in both.items():
        if seen < least_docs:
            continue
        a = prior_share * seen
        t, c = count[1][w] + a, count[0][w] + a
        delta = np.log(t / (n[1] + prior[1] - t)) - np.log(c / (n[0] + prior[0] - c))
        q = count[1][w] / seen
        bits = sum(x * np.log(x / z) for x, z in ((q, share), (1 - q, 1 - share)) if x > 0)
        odds[w] = (float(np.clip(delta, -4, 8)) if seen * bits >= surprise else 0.0) - drift
    clean, blank = Counter(), ToxicModel(odds, drift, 0.0, evidence)
    for i in train:
        if y[i] == 0:
            clean.update(map(blank.odd, tokens(texts[i])))
    for s in set(odds.values()):  # a score never met in clean text still has a chance there
        clean[s] += 0.01
    s, p = np.array(list(clean) or [-drift]), np.array(list(clean.values()) or [1.0])
    p = p / p.sum()
    low, high = 1e-6, 50.0
    if s.max() > 0:
        for _ in range(100):
            mid = (low + high) / 2
            low, high = (mid, high) if (p * np.exp(np.clip(mid * s, -700, 700))).sum() < 1 else (low, mid)
    model = ToxicModel(odds, drift, low, evidence)
    rows = held if len(set(y[held].tolist())) == 2 else order
    if len(set(y[rows].tolist())) == 2:
        share = np.where(y[rows] == 1, positive_share / max(1, (y[rows] == 1).sum()), (1 - positive_share) / max(1, (y[rows] == 0).sum()))
        model.slope, model.offset = platt(np.array([model.x(tokens(texts[i])) for i in rows]), y[rows], share * len(rows))
    return model


def fit_on(docs: DataFrame, labels_df: DataFrame, per_class: int = 2500, id_col: str = "doc_id", **options) -> ToxicModel:
    """A model fitted on the driver on a bounded sample, about ``per_class`` labelled documents of each class."""
    allowed = crc_mod(id_col, 5) != 0
    rows = labelled_sample(docs, labels_df, "toxic", per_class, allowed, id_col)
    share = labels_df.where(allowed).agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    return fit([r["text"] for r in rows], [r["label"] for r in rows], positive_share=min(0.95, max(0.05, share or 0.5)), **options)


def score_toxicity(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``id_col``, ``score`` (0 to 1), ``predicted`` (1 from ``threshold`` on), and ``passages``: every significant passage
    as (first word, word behind the last, evidence).

    Null, empty and wordless texts have no passage and get the score of no evidence. Whole texts count; equal texts
    get equal rows; other columns are not read; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    passage = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("evidence", pa.float64())])

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        m, found, score = shared.value, [], []
        for text in batch.column(1).to_pylist():
            spans = m.passages(tokens(text))
            x = np.log1p(sum(e - m.evidence for _, _, e in spans))
            score.append(float(1 / (1 + np.exp(-np.clip(m.slope * x + m.offset, -30, 30)))))
            found.append([{"start": a, "stop": b, "evidence": e} for a, b, e in spans])
        each = np.array(score)
        return pa.record_batch([batch.column(0), pa.array(each), pa.array((each >= threshold).astype(np.int32)), pa.array(found, pa.list_(passage))], names=[id_col, "score", "predicted", "passages"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, text_col), step, f"{id_col} {kind}, score double, predicted int, passages array<struct<start:int,stop:int,evidence:double>>")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit_on(docs, labels(spark, sf_dir))
    scored = score_toxicity(docs, model).withColumn("held_out", crc_mod("doc_id", 5) == 0)
    return scored.select("doc_id", "held_out", "score", "predicted")
