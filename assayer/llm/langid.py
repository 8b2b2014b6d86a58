"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is the average of the embeddings of its hashed byte n-grams; a linear layer and
a softmax give the probabilities. The model is trained by stochastic gradient descent
in numpy on a bounded sample of labelled rows. As the layer is linear, embedding times
weight is one table with a row per hash bucket, and a prediction is the average of the
table's rows for a text's n-grams.

A temperature fitted on rows kept out of training calibrates the scores, and the score
below which a text is rejected is a low quantile of the same rows' scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNDETERMINED = "und"
#: Bounds of the training sample: documents a language, and bytes of a document that may be in it.
DOCS_PER_LANG = 400
TRAIN_BYTES = 100_000
BUCKETS, WIDTH, WINDOW = 1 << 16, 16, 256
#: Passes over the windows and least steps, windows a step, first learning rate.
EPOCHS, STEPS, BATCH, RATE = 2, 800, 16, 20.0
#: The rejection threshold is this quantile of the calibration rows' scores, times a slack
#: for rows that differ from them, and at most SURE.
REJECTED, SLACK, SURE = 0.002, 0.8, 0.5
#: Bytes of a text whose n-grams are hashed at once.
CHUNK = 1 << 20

#: ASCII bytes that aren't letters become spaces.
_LETTERS = np.array([b if b > 127 or chr(b).isalpha() else 32 for b in range(256)], np.uint8)


def _ngrams(raw: np.ndarray) -> np.ndarray:
    """Hash buckets of all byte n-grams of length 2 to 4."""
    x = raw.astype(np.uint32)
    two = x[:-1] << 8 | x[1:]
    three = two[:-1] << 8 | x[2:]
    four = three[:-1] << 8 | x[3:]
    salted = (two * np.uint32(2654435761), (three + np.uint32(0x9E3779B9)) * np.uint32(2246822519), (four ^ np.uint32(0x85EBCA6B)) * np.uint32(3266489917))
    return np.concatenate([h >> np.uint32(16) for h in salted])


def _letters(text: str) -> np.ndarray:
    raw = np.frombuffer(f" {text} ".lower().encode("utf-8", "surrogatepass"), np.uint8)
    return _LETTERS[raw]


@dataclass
class LanguageModel:
    labels: list[str]
    table: np.ndarray  # buckets x labels
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def logits(self, text: str) -> np.ndarray:
        raw, total, n = _letters(text), np.zeros(len(self.labels)), 0
        for at in range(0, len(raw), CHUNK):
            ids = _ngrams(raw[at : at + CHUNK + 3])
            total += self.table.take(ids, axis=0).sum(0, dtype=np.float64)
            n += len(ids)
        return total / max(1, n) + self.bias

    def predict(self, text: str) -> tuple[str, float]:
        z = self.logits(text) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        return self.labels[best], float(p[best])


def fit(texts: list[str], langs: list[str], seed: int = 7) -> LanguageModel | None:
    """Train on labelled texts, a fifth of which calibrate. None without texts."""
    if not texts:
        return None
    labels = sorted(set(langs))
    truth = np.array([labels.index(x) for x in langs])
    rng = np.random.default_rng(seed)
    held = rng.permutation(len(texts)) < len(texts) // 5
    windows, y = [], []
    for text, lang, out in zip(texts, truth, held):
        if not out:
            raw = _letters(text)
            for at in range(0, max(1, len(raw) - 3), WINDOW):
                ids = _ngrams(raw[at : at + WINDOW])
                if len(ids) > 3:
                    windows.append(ids)
                    y.append(lang)
    y = np.array(y, np.int64)
    weight = len(y) / (len(labels) * np.maximum(1, np.bincount(y, minlength=len(labels))))
    emb = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    out = np.zeros((WIDTH, len(labels)), np.float32)
    bias = np.zeros(len(labels), np.float32)
    per_epoch = max(1, -(-len(windows) // BATCH))
    epochs, step = max(EPOCHS, -(-STEPS // per_epoch)), 0
    steps = epochs * per_epoch
    for _ in range(epochs if windows else 0):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            ids = np.concatenate([windows[i] for i in some])
            lens = np.array([len(windows[i]) for i in some])
            starts = np.concatenate(([0], np.cumsum(lens)[:-1]))
            h = np.add.reduceat(emb[ids], starts, axis=0) / lens[:, None]
            z = h @ out + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(some)), y[some]] -= 1
            p = (p * weight[y[some], None] / len(some)).astype(np.float32)
            rate = np.float32(RATE * (1 - step / steps))
            grad = np.repeat((p @ out.T) / lens[:, None], lens, axis=0).astype(np.float32)
            out -= rate * 0.05 * (h.T @ p)
            bias -= rate * 0.05 * p.sum(0)
            np.add.at(emb, ids, -rate * grad)
            step += 1
    model = LanguageModel(labels, emb @ out, bias)
    kept = [(model.logits(t), lang) for t, lang, out in zip(texts, truth, held) if out]
    if kept:
        z, lang = np.array([k[0] for k in kept]), np.array([k[1] for k in kept])

        def scores(t: float) -> np.ndarray:
            p = np.exp((z - z.max(1, keepdims=True)) / t)
            return p / p.sum(1, keepdims=True)

        tried = np.geomspace(0.1, 20, 60)
        # Smoothed targets: rows without an error don't prove that there are none.
        wrong = (np.count_nonzero(z.argmax(1) != lang) + 1) / (len(lang) + 2)
        goal = np.full(z.shape, wrong / max(1, len(labels) - 1))
        goal[np.arange(len(lang)), lang] = 1 - wrong
        loss = [-(goal * np.log(np.maximum(scores(t), 1e-12))).sum(1).mean() for t in tried]
        model.temperature = float(tried[int(np.argmin(loss))])
        model.reject_below = float(min(SURE, SLACK * np.quantile(scores(model.temperature).max(1), REJECTED)))
    return model


def train(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG, seed: int = 7) -> LanguageModel | None:
    """Fit on a sample of the rows of ``docs`` (doc_id, text, lang) with a lang and a letter.

    The sample is bounded by ``docs_per_lang`` documents a language of at most
    TRAIN_BYTES bytes each, taken by the hash of doc_id: first a share of each language
    that gives a little more than the bound, then the bound itself.
    """
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("lang is not null and text is not null and doc_id is not null")
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    counts = labelled.groupBy("lang").count().collect()
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, (1.3 * docs_per_lang + 30) / r["count"]))])
    some = labelled.where(draw < share[F.col("lang")]).where(F.octet_length("text") <= TRAIN_BYTES).where(has_letter(F.col("text"))).withColumn("draw", draw).toPandas()
    some = some.sort_values(["lang", "draw", "doc_id", "text"]).groupby("lang").head(docs_per_lang)
    return fit(some["text"].tolist(), some["lang"].tolist(), seed)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike("\\p{L}"), F.lit(False))


def identify(docs: DataFrame, model: LanguageModel | None, name: str = "language") -> DataFrame:
    """All rows and columns of ``docs`` plus ``name``: struct<lang, score, accepted>.

    ``docs`` may not have a column of that name. Repeated rows are rows of their own; an
    empty table gives an empty result. A null text or one without a letter is ``und`` with score 0 and not accepted, as is
    every text if there is no model. Any other text gets a learned language; it is
    accepted if its calibrated score reaches the model's threshold.
    """
    if name.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"docs has a column {name}")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, accepted boolean")
    def predicted(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        own = sent.value
        for texts, lettered in batches:
            found = [own.predict(t) if ok and own else (UNDETERMINED, 0.0) for t, ok in zip(texts, lettered)]
            yield pd.DataFrame({"lang": [f[0] for f in found], "score": [f[1] for f in found], "accepted": [f[0] != UNDETERMINED and f[1] >= own.reject_below for f in found]})

    text = F.col("text").cast("string")
    return docs.withColumn(name, predicted(text, has_letter(text)))


def held_out(doc_id: Column) -> Column:
    """True for rows that take no part in training: crc32 of the id's text mod 4 is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))
