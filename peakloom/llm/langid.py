"""Language identification: averaged hashed subword embeddings, a linear softmax, and calibrated rejection."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peakloom.llm.common import crc_mod, documents, map_batches, one_of_each, sample_by

#: Letters, and some numbers that are none (fractions, Roman numerals): each match is asked.
MAYBE_LETTER = re.compile(r"[^\W\d_]")
#: Primes that spread n-grams over the buckets.
SPREAD = (2654435761, 2246822519, 3266489917, 668265263)


def has_letter(text: str) -> bool:
    return any(m.group().isalpha() for m in MAYBE_LETTER.finditer(text))


def subwords(text: str, buckets: int, orders: tuple[int, ...] = (2, 3, 4)) -> np.ndarray:
    """Bucket of every byte n-gram of the lower-cased text, each white space taken as one space on either end too."""
    b = np.frombuffer(b" " + " ".join(text.lower().split()).encode("utf-8", "replace") + b" ", np.uint8).astype(np.uint32)
    found, h = [], b * np.uint32(SPREAD[0])
    for n in range(2, max(orders) + 1):
        h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(SPREAD[1]) + b[n - 1 :] * np.uint32(SPREAD[2])
        if n in orders and len(h):
            found.append((h >> np.uint32(7)) & np.uint32(buckets - 1))
    return np.concatenate(found) if found else np.zeros(0, np.uint32)


@dataclass
class LanguageModel:
    """``table``: for each bucket its embedding times the output layer, so that a document's logits are the mean of its rows."""

    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float

    def logits(self, text: str) -> np.ndarray:
        at = subwords(text, len(self.table))
        if not len(at):
            return self.bias
        return self.table.take(at, axis=0).mean(axis=0, dtype=np.float64) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        """A language and its calibrated probability; ``und`` and 0 for a text that is null or has no letter,
        and for any text where the model has no languages."""
        if not self.langs or not text or not has_letter(text):
            return "und", 0.0
        x = self.logits(text) / self.temperature
        p = np.exp(x - x.max())
        p /= p.sum()
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def fit(texts: list[str], langs: list[str], buckets: int = 1 << 16, dim: int = 16, epochs: int = 6, rate: float = 0.5, seed: int = 7, quantile: float = 0.002) -> LanguageModel:
    """Stochastic gradient descent over documents; a fifth of them calibrates the temperature and the rejection.

    ``reject_below`` is calibrated on the held documents from both sides: at most ``quantile`` of the rightly predicted ones
    fall below it, so that clean documents of a known language stay, and it is no higher than needed to have a quarter of
    the same documents with their characters shuffled below it.
    """
    names = sorted(set(langs))
    y = np.array([names.index(x) for x in langs], int)
    grams = [np.unique(subwords(t, buckets), return_counts=True) for t in texts]
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(texts))
    held, train = order[: len(order) // 5], order[len(order) // 5 :]
    emb = rng.normal(0, 0.1, (buckets, dim)).astype(np.float32)
    out, bias = np.zeros((dim, len(names)), np.float32), np.zeros(len(names), np.float32)
    prior = np.bincount(y[train], minlength=len(names)) / max(1, len(train))
    steps, total = 0, max(1, epochs * len(train))
    for _ in range(epochs):
        for i in rng.permutation(train):
            at, count = grams[i]
            if not len(at):
                continue
            lr = rate * (1 - steps / total)
            steps += 1
            share = (count / count.sum()).astype(np.float32)
            h = share @ emb[at]
            z = h @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            p *= min(3.0, 1 / (len(names) * max(prior[y[i]], 1e-3)))
            dh = out @ p
            out -= lr * np.outer(h, p)
            bias -= lr * 0.1 * p
            emb[at] -= lr * 50 * np.outer(share, dh)
    model = LanguageModel(names, (emb @ out).astype(np.float32), bias.astype(np.float64), 1.0, 0.0)
    usable = [i for i in held if len(grams[i][0])] or list(train)
    z = np.array([model.logits(texts[i]) for i in usable]) if usable else np.zeros((0, len(names)))
    if len(z):
        def loss(t: float) -> float:
            s = z / t
            return float((np.log(np.exp(s - s.max(1, keepdims=True)).sum(1)) + s.max(1) - s[np.arange(len(s)), y[usable]]).mean())

        model.temperature = min((2.0 ** (k / 2) for k in range(-6, 7)), key=loss)
        right = [p for i in usable for lang, p in [model.predict(texts[i])] if lang == names[y[i]]]
        garbled = [model.predict("".join(rng.permutation(list(texts[i]))))[1] for i in usable]
        model.reject_below = float(min(np.quantile(right, quantile), np.quantile(garbled, 0.25))) if right else 0.0
    return model


def fit_on(docs: DataFrame, per_lang: int = 400, most_langs: int = 256, id_col: str = "doc_id", **options) -> LanguageModel:
    """A model fitted on the driver on a bounded sample: about ``per_lang`` documents of each language, one of each id,
    and the ``most_langs`` most frequent languages."""
    known = docs.where((crc_mod(id_col, 3) != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(id_col, "lang", "text")
    rows = one_of_each(sample_by(known, "lang", per_lang, id_col, most_langs), id_col).orderBy(id_col).collect()
    return fit([r["text"] for r in rows], [r["lang"] for r in rows], **options)


def _step(shared: Broadcast, at: int, names: list[str], carried: list[int] | None = None) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    """Column ``at`` of a batch judged by the broadcast model, beside the ``carried`` columns (all, if None)."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shared.value.predict(t) for t in batch.column(at).to_pylist()]
        score = np.array([s for _, s in found], float)
        rejected = (score < shared.value.reject_below) | np.array([lang == "und" for lang, _ in found], bool)
        own = batch.columns if carried is None else [batch.column(i) for i in carried]
        return pa.RecordBatch.from_arrays([*own, pa.array([x for x, _ in found], pa.string()), pa.array(score), pa.array(rejected)], names=names)

    return step


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``lang_pred``, ``score`` and ``rejected`` for every document.

    Null texts and texts without a letter get ``und`` with score 0 and are rejected; so is a text whose probability
    is under the model's calibrated bound. Whole texts count; other columns are not read; an empty table gives an
    empty result.
    """
    step = _step(docs.sparkSession.sparkContext.broadcast(model), 1, [id_col, "lang_pred", "score", "rejected"], [0])
    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, text_col), step, f"{id_col} {kind}, lang_pred string, score double, rejected boolean")


def annotate(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``rejected`` beside each row's own columns, without a join: the columns
    pass through the task. Columns of ``docs`` with these names are replaced."""
    docs = docs.drop("lang_pred", "score", "rejected")
    step = _step(docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col), [*docs.columns, "lang_pred", "score", "rejected"])

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return map_batches(docs, step, schema)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = identify(docs, fit_on(docs)).withColumn("held_out", crc_mod("doc_id", 3) == 1)
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")
