"""Toxicity by multiple-instance learning.

A document is a bag of sentences and only its label is known.  Each sentence
has a logistic score over its words and their beginnings; the document's probability is the
noisy-or of its sentences, one minus the product of their complements.  The
gradient of the document's log loss reaches the sentences through that
product, so training finds the sentences, and the words, that make documents
toxic.  Scoring gives every whole text its probability and the spans of the
offending sentences.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_cnn import held_out, sample_labelled

SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
WORD = re.compile(r"[^\W\d_]+")
BATCH_DOCS = 256


#: A word's features: itself, and its beginnings of these lengths, which stand for inflected forms.
PREFIXES = (3, 4, 5, 6, 7)
#: Words whose weights a worker remembers.
REMEMBERED = 500_000


def features_of(word: str) -> list[str]:
    return [word, *("^" + word[:k] for k in PREFIXES if len(word) > k)]


@dataclass
class Model:
    #: Features with a weight; the rest weigh nothing.
    weights: dict[str, float]
    bias: float
    known: dict[str, float] = field(default_factory=dict)

    def word(self, word: str) -> float:
        got = sum(self.weights.get(f, 0.0) for f in features_of(word))
        if len(self.known) < REMEMBERED:
            self.known[word] = got
        return got

    def logits(self, sentences: list[str]) -> np.ndarray:
        get, z = self.known.get, []
        for s in sentences:
            words = set(WORD.findall(s))
            got = list(map(get, words))
            z.append(self.bias + sum(self.word(x) if w is None else w for x, w in zip(words, got, strict=True)) if None in got else self.bias + sum(got))
        return np.asarray(z)

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """The text's probability and its offending sentences as (begin, end, score)."""
        text = text or ""
        spans = [m.span() for m in SENTENCE.finditer(text)]
        low = text.lower()
        if len(low) != len(text):  # a letter whose lower case is longer would shift the spans
            z = self.logits([text[a:b].lower() for a, b in spans])
        else:
            z = self.logits([low[a:b] for a, b in spans])
        p = 1 / (1 + np.exp(-z))
        total = float(-np.expm1(-np.logaddexp(0, z).sum()))
        return min(1.0, max(0.0, total)), [(a, b, float(p[i])) for i, (a, b) in enumerate(spans) if p[i] >= 0.5]


def fit(texts: list[str], labels: np.ndarray, *, epochs: int = 120, rate: float = 0.1, sparsity: float = 2e-4, min_docs: int = 2) -> Model:
    """Train word weights by Adam on whole documents; weights near zero are dropped."""
    labels = np.asarray(labels, "f8")
    if not len(texts) or labels.min() == labels.max():
        return Model({}, -8.0)
    ids: dict[str, int] = {}
    sentence, word, doc = array("i"), array("i"), array("i")
    for d, text in enumerate(texts):
        for a in SENTENCE.findall(text.lower()):
            found = sorted(set(WORD.findall(a)))
            word.extend([ids.setdefault(x, len(ids)) for x in found])
            sentence.extend([len(doc)] * len(found))
            doc.append(d)
    sentence, word, doc = (np.frombuffer(x, "i4") if len(x) else np.zeros(0, "i4") for x in (sentence, word, doc))
    # Words expand into features once each, however often they occur.
    names: dict[str, int] = {}
    of_word, feature = array("i"), array("i")
    for x, i in ids.items():
        found = features_of(x)
        feature.extend([names.setdefault(f, len(names)) for f in found])
        of_word.extend([i] * len(found))
    of_word, feature = (np.frombuffer(x, "i4") if len(x) else np.zeros(0, "i4") for x in (of_word, feature))
    # A feature of one document only cannot tell toxic words from chance.
    seen = np.unique(word.astype("i8") * len(texts) + doc[sentence]) // len(texts)
    docs_with = np.bincount(feature, np.bincount(seen, minlength=len(ids))[of_word], len(names))
    of_word, feature = of_word[docs_with[feature] >= min_docs], feature[docs_with[feature] >= min_docs]
    # Half-way to balance: toxic documents are rare, and clean ones must stay.
    weight = np.sqrt(np.where(labels > 0, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))) / len(labels)
    w, b = np.zeros(len(names)), -6.0
    state = [np.zeros(len(names) + 1) for _ in range(2)]
    for turn in range(1, epochs + 1):
        by_word = np.bincount(of_word, w[feature], len(ids))
        z = b + np.bincount(sentence, by_word[word], len(doc))
        s = np.bincount(doc, np.logaddexp(0, z), len(labels))
        d_s = weight * np.where(labels > 0, -1 / np.expm1(np.clip(s, 1e-9, 700)), 1.0)
        d_z = d_s[doc] / (1 + np.exp(-np.clip(z, -60, 60)))
        d_word = np.bincount(word, d_z[sentence], len(ids))
        g = np.concatenate((np.bincount(feature, d_word[of_word], len(names)) + sparsity * np.sign(w), [d_z.sum()]))
        state[0] = 0.9 * state[0] + 0.1 * g
        state[1] = 0.99 * state[1] + 0.01 * g * g
        step = rate * (1 - 0.8 * turn / epochs) * (state[0] / (1 - 0.9**turn)) / (np.sqrt(state[1] / (1 - 0.99**turn)) + 1e-6)
        w, b = w - step[:-1], float(b - step[-1])
    return Model({x: float(w[i]) for x, i in names.items() if abs(w[i]) >= 0.05}, b)


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    folds: int = 5,
    fold: int = 0,
    limit: int = 6000,
) -> DataFrame:
    """Score every whole text for toxicity, 0 to 1, and locate its sentences.

    The model is fitted on at most ``limit`` labelled documents (``limit`` / 2
    of each class) outside the held-out fold.  Returns ``docs`` with
    ``held_out``, ``score``, ``predicted`` and ``offending``, the sentences
    with a score of at least 0.5 as (begin, end, score) in code points;
    columns of these names are replaced, others carried.

    Null and empty texts have no sentences and score 0; without labels, or
    with one class only, no sentence is toxic; null labels are ignored;
    repeated rows score alike; an empty table gives no rows.
    """
    texts, y = sample_labelled(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, usable=~held_out(F.col("_id"), folds, fold), limit=limit)
    model = fit(texts, y)
    kept = docs.drop("held_out", "score", "predicted", "offending")
    spans = "array<struct<begin:int,end:int,score:double>>"
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH_DOCS):
                part = batch.slice(lo, BATCH_DOCS)
                scored = [model.score(t) for t in part.column("_text").to_pylist()]
                bad = pa.array([[{"begin": a, "end": b, "score": p} for a, b, p in s[1]] for s in scored], kind)
                at = part.schema.get_field_index("_text")
                columns = [c for i, c in enumerate(part.columns) if i != at]
                names = [n for i, n in enumerate(part.schema.names) if i != at]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([s[0] for s in scored], pa.float64()), bad], [*names, "score", "offending"])

    # Equal names under another case would clash in Arrow, so columns travel by place.
    renamed = kept.toDF(*(f"c{i}" for i in range(len(kept.columns))))
    at = renamed.columns[kept.columns.index(text_col)]
    schema = ", ".join(f"`{n}` {t}" for n, t in renamed.dtypes) + f", score double, offending {spans}"
    out = renamed.withColumn("_text", F.col(at).cast("string")).mapInArrow(run, schema).toDF(*kept.columns, "score", "offending")
    return out.select(*kept.columns, held_out(F.col(id_col), folds, fold).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "offending")
