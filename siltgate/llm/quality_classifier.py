"""Document quality by supervised subword embeddings.

Every word, pair of neighbouring words and character n-gram of a text is hashed to a learned
vector. A document is the average of its vectors; a softmax layer turns it into class
probabilities. Training is stochastic gradient descent in numpy on a bounded sample of
labelled rows (``Settings.sample_rows``). Scoring folds the output layer into the vectors,
which leaves one number per hash bucket, so a text of any length is read once.

Defined cases: a null or empty text has no features and gets the score of the bias alone.
Repeated label rows for an id count once; contradicting ones are not learned from. With labels
of one class only, or none, the score is constant. Rows are scored one by one, so repeated rows
and repeated ids are fine. Columns named ``score`` or ``predicted`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from siltgate.llm.text import BLANKS, Hasher, column, mix, runs, text_slices

_SAME = np.uint64(0x51ED270B153A4D2F)
_ORDER = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    """``sample_rows`` bounds the labelled rows that are fetched and learned from."""

    sample_rows: int = 3000
    buckets_log2: int = 17
    dimensions: int = 8
    ngrams: tuple[int, ...] = (2, 4)
    epochs: int = 8
    rate: float = 4.0
    seed: int = 7


@dataclass(frozen=True)
class Model:
    """``weights``: what a feature of each bucket adds to the log odds; ``bias``: the log odds without features."""

    settings: Settings
    weights: np.ndarray
    bias: float


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Rows never learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def features(data: np.ndarray, offsets: np.ndarray, settings: Settings, hasher: Hasher) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, where each row's begin), once for each kind of feature."""
    shift = np.uint64(64 - settings.buckets_log2)
    blank = BLANKS[data]
    data = np.where(blank, np.uint8(32), data)
    starts, ends, first = runs(~blank, offsets)
    prefix = hasher.prefix(data)
    words = hasher.between(prefix, starts, ends)
    yield (words >> shift).astype(np.int64), first
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    if len(words) > 1:
        inside = row[:-1] == row[1:]
        # a word followed by itself is one feature, whatever the word
        pairs = np.where(words[:-1] == words[1:], _SAME, mix(words[:-1] * _ORDER + words[1:]))[inside]
        yield (pairs >> shift).astype(np.int64), np.searchsorted(row[:-1][inside], np.arange(len(offsets)))
    for n in settings.ngrams:
        if len(data) < n:
            continue
        places = np.arange(len(data) - n + 1)
        row_end = np.repeat(offsets[1:], np.diff(offsets))[: len(places)]
        places = places[places + n <= row_end]
        grams = hasher.between(prefix, places, places + n)
        yield (grams >> shift).astype(np.int64), np.searchsorted(places, offsets)


def train(texts: list[str], labels: list[int], settings: Settings) -> Model:
    size = 1 << settings.buckets_log2
    y = np.asarray(labels, dtype=np.int64)
    if len(set(labels)) < 2:
        rate = (y.sum() + 1) / (len(y) + 2)
        return Model(settings, np.zeros(size, dtype=np.float32), float(np.log(rate / (1 - rate))))
    random, hasher, bags = np.random.default_rng(settings.seed), Hasher(), []
    for _, count, data, offsets in text_slices(pa.array(texts, pa.large_string()), 1 << 17):
        parts = list(features(data, offsets, settings, hasher))
        for k in range(count):
            ids, times = np.unique(np.concatenate([b[f[k] : f[k + 1]] for b, f in parts]), return_counts=True)
            bags.append((ids.astype(np.int32), (times / max(1, times.sum())).astype(np.float32)))
    vectors = random.uniform(-1, 1, (size, settings.dimensions)).astype(np.float32) / settings.dimensions
    output, bias = np.zeros((settings.dimensions, 2), dtype=np.float32), np.zeros(2, dtype=np.float32)
    step, steps = 0, settings.epochs * len(bags)
    for _ in range(settings.epochs):
        for k in random.permutation(len(bags)):
            rate = settings.rate * (1 - step / steps)
            step += 1
            ids, share = bags[k]
            mean = share @ vectors[ids]
            logits = mean @ output + bias
            wrong = np.exp(logits - logits.max())
            wrong /= wrong.sum()
            wrong[y[k]] -= 1
            back = output @ wrong
            output -= rate * 0.2 * np.outer(mean, wrong)
            bias -= rate * 0.02 * wrong
            # a feature's share of a document is tiny; the root keeps rare features learning
            vectors[ids] -= rate * np.sqrt(share)[:, None] * back
    return Model(settings, vectors @ (output[:, 1] - output[:, 0]), float(bias[1] - bias[0]))


def fit(documents: DataFrame, labels: DataFrame, settings: Settings = Settings(), label: str = "quality") -> Model:
    """Learn from labelled documents outside the held-out third: a bounded sample by a hash of the id."""
    known = labels.where(F.col(label).isin(0, 1)).where(~held_out()).groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("z")).where("y = z AND doc_id IS NOT NULL")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.sample_rows).select("doc_id", F.col("y").cast("int").alias("y"))
    # at most sample_rows rows of two numbers
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(settings.sample_rows).collect()
    return train([r["text"] or "" for r in rows], [r["y"] for r in rows], settings)


def score(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``score`` (probability of label 1) and ``predicted``; columns named in ``keep``, or all, are carried."""
    fields = [f for f in df.schema.fields if f.name not in ("score", "predicted") and (keep is None or f.name in keep)]
    names = [f.name for f in fields]
    schema = StructType(fields + [StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    shared = df.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    settings = model.settings
    carried = names if text in names else [*names, text]

    def run(batches):
        (weights, bias), hasher = shared.value, Hasher()
        for batch in batches:
            for start, count, data, offsets in text_slices(column(batch, text)):
                total, number = np.zeros(count), np.zeros(count)
                for buckets, first in features(data, offsets, settings, hasher):
                    sums = np.zeros(len(buckets) + 1)
                    np.cumsum(weights[buckets], out=sums[1:])
                    total += sums[first[1:]] - sums[first[:-1]]
                    number += np.diff(first)
                scores = 1 / (1 + np.exp(-(total / np.maximum(number, 1) + bias)))
                own = [column(batch, name).slice(start, count) for name in names]
                yield pa.RecordBatch.from_arrays(own + [pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], [*names, "score", "predicted"])

    return df.select(*[F.col(f"`{x}`") for x in carried]).mapInArrow(run, schema)
