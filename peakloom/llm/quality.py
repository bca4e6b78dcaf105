"""Document quality by a byte-level convolutional network in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.llm.common import crc_mod, documents, labelled_sample, labels, map_batches, platt, utf8

#: Bytes a filter sees, bytes it moves by; filter positions of a block, blocks of a chunk, blocks a chunk moves by.
WIDTH, STRIDE, BLOCK, CHUNK, HOP = 8, 4, 64, 4, 3
DIM, FILTERS = 8, 24
#: Bytes since the same four bytes last stood, up to each of these; further back or never is class 0.
RECENT = np.array([8, 16, 32, 64, 256])


def recency(b: np.ndarray) -> np.ndarray:
    """Class of each byte by how far back its four bytes last stood: shows words and lines that are said over and over,
    which no filter of a few bytes can see."""
    out = np.zeros(len(b), np.int64)
    if len(b) > 4:
        w = b.astype(np.uint32)
        four = w[:-3] | w[1:-2] << np.uint32(8) | w[2:-1] << np.uint32(16) | w[3:] << np.uint32(24)
        order = np.argsort(four, kind="stable")
        same = four[order[1:]] == four[order[:-1]]
        back = (order[1:] - order[:-1])[same]
        out[order[1:][same]] = (len(RECENT) - np.searchsorted(RECENT, back)) % (len(RECENT) + 1)
    return out


@dataclass
class ByteNet:
    """Embedding of a byte and of its recency, filters over overlapping chunks, max-pooling within each chunk, and a logistic layer on the mean
    and the maximum of the chunks' pooled activations."""

    emb: np.ndarray  # 256 bytes, then the recency classes, x DIM
    kernel: np.ndarray  # WIDTH * DIM x FILTERS
    kernel_bias: np.ndarray
    out: np.ndarray  # 2 * FILTERS
    out_bias: float
    slope: float = 1.0
    offset: float = 0.0

    @staticmethod
    def fresh(seed: int) -> ByteNet:
        rng = np.random.default_rng(seed)
        return ByteNet(
            rng.normal(0, 0.5, (257 + len(RECENT), DIM)).astype(np.float32), rng.normal(0, 0.25, (WIDTH * DIM, FILTERS)).astype(np.float32),
            np.zeros(FILTERS, np.float32), rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32), 0.0,
        )

    def params(self) -> list[np.ndarray]:
        return [self.emb, self.kernel, self.kernel_bias, self.out]

    def convolve(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The padded bytes, their recency, and every filter's activation at every position of the whole text."""
        b = np.frombuffer(text, np.uint8)
        n = max(WIDTH, -(-(len(b) - WIDTH) // STRIDE) * STRIDE + WIDTH)
        pad = np.zeros(n - len(b), np.uint8)
        recent = np.concatenate([recency(b), pad]).astype(np.int64) + 256
        b = np.concatenate([b, pad])
        x = self.emb.take(b, axis=0) + self.emb.take(recent, axis=0)
        rows = (n - WIDTH) // STRIDE + 1
        seen = np.lib.stride_tricks.as_strided(x, (rows, WIDTH * DIM), (STRIDE * DIM * 4, 4))
        return b, recent, seen @ self.kernel

    def chunks(self, act: np.ndarray) -> np.ndarray:
        """Pooled activations of each chunk. Chunks overlap by ``CHUNK - HOP`` blocks and cover every position."""
        blocks = np.maximum.reduceat(act, np.arange(0, len(act), BLOCK), axis=0)
        first = range(0, max(1, len(blocks) - CHUNK + HOP), HOP)
        return np.array([blocks[i : i + CHUNK].max(axis=0) for i in first]) if len(blocks) > CHUNK else blocks.max(axis=0)[None]

    def logit(self, text: bytes) -> float:
        z = np.maximum(self.chunks(self.convolve(text)[2]) + self.kernel_bias, 0)
        return float(np.concatenate([z.mean(axis=0), z.max(axis=0)]) @ self.out + self.out_bias)

    def score(self, text: bytes) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.logit(text) + self.offset, -30, 30))))

    def gradients(self, text: bytes, label: int) -> tuple[list[np.ndarray], float]:
        """Of the logistic loss; through a maximum only the position that attains it is moved."""
        b, recent, act = self.convolve(text)
        starts = list(range(0, max(1, -(-len(act) // BLOCK) - CHUNK + HOP), HOP)) if len(act) > CHUNK * BLOCK else [0]
        spans = [(i * BLOCK, min(len(act), (i + CHUNK) * BLOCK)) for i in starts]
        at = np.array([a + act[a:e].argmax(axis=0) for a, e in spans])
        f = np.arange(FILTERS)
        pre = act[at, f] + self.kernel_bias
        z = np.maximum(pre, 0)
        top = z.argmax(axis=0)
        h = np.concatenate([z.mean(axis=0), z[top, f]])
        p = 1 / (1 + np.exp(-np.clip(h @ self.out + self.out_bias, -30, 30)))
        d = float(p - label)
        dz = np.repeat((d * self.out[:FILTERS] / len(z))[None], len(z), axis=0)
        dz[top, f] += d * self.out[FILTERS:]
        dz *= pre > 0
        places = (at.ravel() * STRIDE)[:, None] + np.arange(WIDTH)
        seen, since = b[places], recent[places]
        x = (self.emb[seen] + self.emb[since]).reshape(len(spans), FILTERS, WIDTH * DIM)
        dk = np.einsum("cf,cfk->kf", dz, x)
        dx = (dz[:, :, None] * self.kernel.T[None]).reshape(-1, DIM)
        de = np.zeros_like(self.emb)
        np.add.at(de, seen.ravel(), dx)
        np.add.at(de, since.ravel(), dx)
        return [de, dk, dz.sum(axis=0), d * h], d


def fit(texts: list[bytes], y: list[int], epochs: int = 8, batch: int = 8, rate: float = 4e-3, positive_share: float = 0.5, seed: int = 11) -> ByteNet:
    """Adam over whole documents; a fifth of them is held to set the probability's slope and offset, each class weighed
    to ``positive_share``, its share among all labelled rows."""
    net, rng, y = ByteNet.fresh(seed), np.random.default_rng(seed), np.asarray(y)
    order = rng.permutation(len(texts))
    held, train = order[: len(order) // 5], order[len(order) // 5 :]
    weight = {c: len(train) / (2 * max(1, int((y[train] == c).sum()))) for c in (0, 1)}
    mean, square, bias_mean, bias_square, t = [np.zeros_like(p) for p in net.params()], [np.zeros_like(p) for p in net.params()], 0.0, 0.0, 0
    total = max(1, epochs * -(-len(train) // batch))
    for _ in range(epochs):
        shuffled = rng.permutation(train)
        for i in range(0, len(shuffled), batch):
            rows = shuffled[i : i + batch]
            sums, db = [np.zeros_like(p) for p in net.params()], 0.0
            for r in rows:
                found, d = net.gradients(texts[r], int(y[r]))
                db += d * weight[int(y[r])]
                for s, g in zip(sums, found, strict=True):
                    s += weight[int(y[r])] * g
            t += 1
            lr = rate * (1 - t / (total + 1)) * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
            for p, g, m, v in zip(net.params(), sums, mean, square, strict=True):
                g = g / len(rows)
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= lr * m / (np.sqrt(v) + 1e-8)
            db /= len(rows)
            bias_mean += 0.1 * (db - bias_mean)
            bias_square += 0.001 * (db * db - bias_square)
            net.out_bias -= lr * bias_mean / (np.sqrt(bias_square) + 1e-8)
    if len(held) and len(set(y[held].tolist())) == 2:
        share = np.where(y[held] == 1, positive_share / max(1, (y[held] == 1).sum()), (1 - positive_share) / max(1, (y[held] == 0).sum()))
        net.slope, net.offset = platt(np.array([net.logit(texts[i]) for i in held]), y[held], share * len(held))
    return net


def fit_on(docs: DataFrame, labels_df: DataFrame, per_class: int = 1000, id_col: str = "doc_id") -> ByteNet:
    """A network fitted on the driver on a bounded sample, about ``per_class`` labelled documents of each class."""
    allowed = crc_mod(id_col, 4) != 2
    rows = labelled_sample(docs, labels_df, "quality", per_class, allowed, id_col)
    share = labels_df.where(allowed).agg(F.avg(F.col("quality").cast("double"))).first()[0]
    return fit([(r["text"] or "").encode() for r in rows], [r["label"] for r in rows], positive_share=min(0.95, max(0.05, share or 0.5)))


def score_quality(docs: DataFrame, net: ByteNet, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """``id_col``, ``score`` (0 to 1) and ``predicted`` (1 if the score reaches ``threshold``) for every whole text.

    Null and empty texts are one chunk of padding and get its score. Equal texts get equal scores; other columns are
    not read; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = np.fromiter(map(shared.value.score, utf8(batch.column(1))), np.float64, batch.num_rows)
        return pa.record_batch([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[id_col, "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs.select(id_col, text_col), step, f"{id_col} {kind}, score double, predicted int")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    net = fit_on(docs, labels(spark, sf_dir))
    scored = score_quality(docs, net).withColumn("held_out", crc_mod("doc_id", 4) == 2)
    return scored.select("doc_id", "held_out", "score", "predicted")
