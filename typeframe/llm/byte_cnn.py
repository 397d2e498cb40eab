"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are covered by overlapping chunks.  Inside a chunk,
learned filters over short windows of embedded bytes are rectified and
max-pooled; the pooled vectors of all chunks, as their mean and as their
maximum, are combined into one probability by a logistic layer.  The model is
fitted on a bounded sample of labelled documents and scores every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Chunk length and step in bytes; filter width and step; embedding and filter counts.
CHUNK, STEP = 256, 224
WIDTH, STRIDE = 8, 2
EMBED, FILTERS = 8, 24
#: Chunks convolved at once, which bounds memory whatever a text's length.
BLOCK = 512
POSITIONS = (CHUNK - WIDTH) // STRIDE + 1


def chunks_of(text: str | None) -> np.ndarray:
    """The overlapping chunks of a text as rows of byte values, zero-padded at the end."""
    raw = np.frombuffer((text or "").encode(), "u1")
    n = max(1, -(-max(0, len(raw) - CHUNK) // STEP) + 1)
    padded = np.zeros((n - 1) * STEP + CHUNK, "u1")
    padded[: len(raw)] = raw
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::STEP]


@dataclass
class Model:
    embed: np.ndarray
    conv: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: float

    @classmethod
    def fresh(cls, seed: int) -> Model:
        r = np.random.default_rng(seed)
        return cls(
            r.normal(0, 0.5, (256, EMBED)).astype("f4"), r.normal(0, (WIDTH * EMBED) ** -0.5, (WIDTH, EMBED, FILTERS)).astype("f4"),
            np.zeros(FILTERS, "f4"), r.normal(0, 0.1, 2 * FILTERS).astype("f4"), 0.0,
        )

    def tables(self) -> np.ndarray:
        """What each pair of bytes at each even place of a window adds to the filters."""
        one = np.einsum("be,wef->wbf", self.embed, self.conv)
        return (one[0::2, :, None, :] + one[1::2, None, :, :]).reshape(WIDTH // 2, 65536, FILTERS).astype("f4")

    def peak(self, chunks: np.ndarray, tables: np.ndarray) -> np.ndarray:
        return np.concatenate([self._peak(chunks[i : i + BLOCK], tables) for i in range(0, len(chunks), BLOCK)])

    def _peak(self, chunks: np.ndarray, tables: np.ndarray) -> np.ndarray:
        pairs = np.ascontiguousarray(chunks).astype("i4")
        pairs = pairs[:, 0::2] * 256 + pairs[:, 1::2]
        total = tables[0][pairs[:, :POSITIONS]]
        for k in range(1, WIDTH // 2):
            total += tables[k][pairs[:, k : k + POSITIONS]]
        return np.maximum(total.max(1) + self.bias, 0)

    def score(self, texts: list[str | None], tables: np.ndarray | None = None) -> np.ndarray:
        """Probabilities of whole texts; texts are grouped so that a call convolves many chunks."""
        tables = self.tables() if tables is None else tables
        scores, held, size = [], [], 0
        for i, t in enumerate(texts):
            held.append(chunks_of(t))
            size += len(held[-1])
            if size >= BLOCK or i == len(texts) - 1:
                starts = np.cumsum([0, *map(len, held)])[:-1]
                h = self.peak(np.concatenate(held), tables)
                scores.append(self._combine(h, starts, np.asarray([len(x) for x in held])))
                held, size = [], 0
        return np.concatenate(scores) if scores else np.zeros(0)

    def _features(self, h: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.concatenate((np.add.reduceat(h, starts) / n[:, None], np.maximum.reduceat(h, starts)), 1)

    def _combine(self, h: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
        z = self._features(h, starts, n).astype("f8") @ self.out + self.out_bias
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit(texts: list[str], labels: np.ndarray, *, epochs: int = 8, batch: int = 32, rate: float = 0.01, seed: int = 7) -> Model:
    """Train by Adam on the balanced log loss; the same sample gives the same model."""
    m = Model.fresh(seed)
    labels = np.asarray(labels, "f4")
    if not len(texts) or labels.min() == labels.max():
        m.out[:] = 0
        m.out_bias = 0.0 if not len(texts) else (4.0 if labels[0] else -4.0)
        return m
    weight = np.where(labels > 0, 0.5 / labels.mean(), 0.5 / (1 - labels.mean())).astype("f4")
    parts = [chunks_of(t) for t in texts]
    names = ["embed", "conv", "bias", "out", "out_bias"]
    first, second, turn = {k: 0.0 for k in names}, {k: 0.0 for k in names}, 0
    order = np.random.default_rng(seed)
    steps = max(1, epochs * (-(-len(texts) // batch)))
    for _ in range(epochs):
        shuffled = order.permutation(len(texts))
        for lo in range(0, len(texts), batch):
            pick = shuffled[lo : lo + batch]
            own = [parts[i] for i in pick]
            n = np.asarray([len(x) for x in own])
            starts = np.cumsum(n) - n
            grad = _gradient(m, np.concatenate(own), starts, n, labels[pick], weight[pick])
            turn += 1
            pace = rate * (1 - 0.9 * turn / steps)
            for k in names:
                g = grad[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                step = pace * (first[k] / (1 - 0.9**turn)) / (np.sqrt(second[k] / (1 - 0.99**turn)) + 1e-7)
                setattr(m, k, (getattr(m, k) - step).astype("f4") if k != "out_bias" else float(m.out_bias - step))
    return m


def _gradient(m: Model, chunks: np.ndarray, starts: np.ndarray, n: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
    # With few chunks a dense product is cheaper than rebuilding the pair tables.
    emb = m.embed[chunks]
    windows = np.lib.stride_tricks.sliding_window_view(emb, WIDTH, axis=1)[:, ::STRIDE].transpose(0, 1, 3, 2)
    flat = np.ascontiguousarray(windows).reshape(-1, WIDTH * EMBED)
    total = (flat @ m.conv.reshape(-1, FILTERS)).reshape(len(chunks), POSITIONS, FILTERS)
    best = total.argmax(1)
    h = np.maximum(np.take_along_axis(total, best[:, None], 1)[:, 0] + m.bias, 0)
    f = m._features(h, starts, n)
    p = 1 / (1 + np.exp(-np.clip(f @ m.out + m.out_bias, -30, 30)))
    dz = ((p - y) * weight / len(y)).astype("f4")
    doc = np.repeat(np.arange(len(n)), n)
    peak = h == f[doc, FILTERS:]
    share = peak / np.maximum(1, np.add.reduceat(peak.astype("f4"), starts))[doc]
    dh = dz[doc, None] * (m.out[:FILTERS] / n[doc, None] + m.out[FILTERS:] * share) * (h > 0)
    windows_hit = flat.reshape(len(chunks), POSITIONS, -1)[np.arange(len(chunks))[:, None], best]  # chunk, filter, width * embed
    d_conv = np.einsum("cf,cfk->kf", dh, windows_hit).reshape(m.conv.shape)
    d_embed = np.zeros_like(m.embed)
    at = best * STRIDE
    for w in range(WIDTH):
        hit = np.take_along_axis(chunks, at + w, 1)
        add = dh[:, :, None] * m.conv[w].T[None]
        for e in range(EMBED):
            d_embed[:, e] += np.bincount(hit.ravel(), add[:, :, e].ravel(), 256).astype("f4")
    return {"embed": d_embed + 1e-5 * m.embed, "conv": d_conv + 1e-5 * m.conv, "bias": dh.sum(0), "out": dz @ f + 1e-4 * m.out, "out_bias": float(dz.sum())}


def held_out(id_col: Column, folds: int, fold: int, *, is_fold: bool = True) -> Column:
    """Whether a row's CRC-32 of its id as text falls in the fold that is never trained on."""
    remainder = F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds
    return remainder == fold if is_fold else remainder != fold


def sample_labelled(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str, usable: Column, limit: int) -> tuple[list[str], np.ndarray]:
    """At most ``limit`` labelled texts for the driver, chosen by a hash of the id.

    Each label class gives up to half, so a rare class is not crowded out.
    Repeated labels of an id count if they agree.
    """
    one = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_lo"), F.max(label_col).alias("_hi")).filter("_lo = _hi")
    ids = [r for y in (0, 1) for r in one.filter((F.col("_lo") == y) & usable).orderBy(F.xxhash64("_id"), "_id").limit(limit // 2).collect()]
    if not ids:
        return [], np.zeros(0)
    of = {r["_id"]: r["_lo"] for r in ids}
    # At most ``limit`` ids, so the broadcast is bounded.
    small = docs.sparkSession.createDataFrame([(i,) for i in of], f"_id {dict(docs.dtypes)[id_col]}")
    rows = docs.join(F.broadcast(small), docs[id_col] == small["_id"], "left_semi").select(id_col, text_col).dropDuplicates([id_col]).collect()
    rows.sort(key=lambda r: r[0])
    return [r[1] or "" for r in rows], np.asarray([of[r[0]] for r in rows], "f4")


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    folds: int = 3,
    fold: int = 1,
    limit: int = 3000,
) -> DataFrame:
    """Score every whole text for quality, 0 to 1.

    The model is fitted on at most ``limit`` labelled documents (``limit`` / 2
    of each class) outside the held-out fold.  Returns ``docs`` with
    ``held_out``, ``score`` and ``predicted``; columns of these names are
    replaced, others carried.

    Null and empty texts are one padded chunk and get its score; without
    labels every score is 0.5; a null label is ignored; repeated rows are
    scored alike; a null id counts as the empty string for the fold; an empty
    table gives no rows.
    """
    texts, y = sample_labelled(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, usable=~held_out(F.col("_id"), folds, fold), limit=limit)
    model = fit(texts, y)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tables = model.tables()
        for texts in batches:
            yield pd.Series(model.score(texts.tolist(), tables), dtype="f8")

    out = docs.drop("held_out", "score", "predicted").withColumn("held_out", held_out(F.col(id_col), folds, fold))
    return out.withColumn("score", score(F.col(text_col).cast("string"))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
