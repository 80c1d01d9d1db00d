"""Language of documents from a linear-chain conditional random field over their words.

Words of code-switched text get one label each: hashed affixes, character n-grams and lexicon
words add up to emission scores, a learned matrix scores neighbouring labels, and
forward-backward gives each word's label probabilities. A document's language is the label
with the largest mean probability, which is also its score; its certainty is the mean over words of
each word's largest probability, which a text in several languages does not lower.

Training labels come from documents: segments of differently labelled documents are joined to
sequences, so that the transitions see switches. Every language is learned, from a sample bounded by
``Settings.sample_rows`` per language, and by fewer, yet ``least_rows`` or more, if the languages
together exceed ``sample_total``. Few words are repeated to fill sequences.

Long documents are cut into chunks only for computing: the transfer matrix of each chunk is
formed for all chunks at once, the chunks of a document are linked through them, and the
probabilities are those of the whole sequence. With very many languages, whose transfer matrices
are large, sequences are not cut.

Defined cases: a null text or one without a letter is ``und`` with score and certainty 0, as is every text
when nothing could be learned. Rows are labelled one by one, so repeated rows and ids are fine.
Columns named ``lang_pred``, ``score`` or ``certainty`` are replaced; others may be carried along.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from siltgate.llm.text import Hasher, column, runs, text_slices

UNKNOWN = "und"
MANY = 32  # languages from which sequences are not cut, to bound memory
CELLS = 1 << 22  # bytes of text times languages, and a few more for features, that are labelled at once
_LETTERS = np.zeros(256, dtype=bool)
_LETTERS[65:91] = _LETTERS[97:123] = _LETTERS[128:] = True
_KINDS = [np.uint64(x) for x in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25, 0xC6A4A7935BD1E995, 0x87C37B91114253D5)]


@dataclass(frozen=True)
class Settings:
    """``sample_rows`` bounds the documents per language that are learned from; see above."""

    sample_rows: int = 200
    sample_total: int = 40_000
    least_rows: int = 20
    buckets_log2: int = 16
    affixes: tuple[int, ...] = (2, 4)
    ngrams: tuple[int, ...] = (2, 3)
    lexicon: int = 4
    sequence: int = 48
    batch: int = 48
    steps: int = 300
    rate: float = 0.3
    seed: int = 11
    chunk: int = 128


@dataclass(frozen=True)
class Model:
    settings: Settings
    languages: tuple[str, ...]
    weights: np.ndarray  # buckets x languages
    transitions: np.ndarray
    lexicon: np.ndarray  # hashes of frequent words, ascending


def _words(data: np.ndarray, offsets: np.ndarray):
    return runs(_LETTERS[data], offsets)


def _bucket(hashes: np.ndarray, kind: int, settings: Settings) -> np.ndarray:
    return ((hashes * _KINDS[kind]) >> np.uint64(64 - settings.buckets_log2)).astype(np.int64)


def _features(prefix, starts, ends, lexicon: np.ndarray, settings: Settings, hasher: Hasher):
    """(buckets, word) for each kind of feature; words ascend within a kind."""
    every = np.arange(len(starts))
    own = hasher.between(prefix, starts, ends)
    if len(lexicon):
        known = lexicon[np.minimum(np.searchsorted(lexicon, own), len(lexicon) - 1)] == own
        yield _bucket(own[known], 0, settings), every[known]
    for n in settings.affixes:
        long = ends - starts >= n
        yield _bucket(hasher.between(prefix, starts[long], starts[long] + n), 1, settings), every[long]
        yield _bucket(hasher.between(prefix, ends[long] - n, ends[long]), 2, settings), every[long]
    lengths = ends - starts
    for n in settings.ngrams:
        counts = np.maximum(0, lengths - n + 1)
        word = np.repeat(every, counts)
        places = np.arange(len(word)) - np.repeat(np.cumsum(counts) - counts, counts) + starts[word]
        yield _bucket(hasher.between(prefix, places, places + n), 3, settings), word


def _emissions(data, starts, ends, model: Model, hasher: Hasher) -> np.ndarray:
    scores = np.zeros((len(starts), len(model.languages)), dtype=np.float32)
    for buckets, word in _features(hasher.prefix(data), starts, ends, model.lexicon, model.settings, hasher):
        if len(word):
            at = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            scores[word[at]] += np.add.reduceat(model.weights[buckets], at, axis=0)
    return scores


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=-1, keepdims=True)


def label_probabilities(scores: np.ndarray, first: np.ndarray, transitions: np.ndarray, chunk: int) -> np.ndarray:
    """Forward-backward over sequences laid end to end: each word's label probabilities.

    ``first`` tells where each sequence begins. The label before a sequence is uniform.
    """
    n_labels = scores.shape[1]
    e = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float64)
    a = np.exp(transitions.astype(np.float64) - transitions.max())
    lengths = np.diff(first)
    pieces = -(-lengths // chunk)
    sequence = np.repeat(np.arange(len(lengths)), pieces)
    turn = np.arange(len(sequence)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = first[sequence] + turn * chunk
    size = np.minimum(chunk, first[sequence + 1] - begin)
    order = np.argsort(-size, kind="stable")
    begin, size, sequence, turn = begin[order], size[order], sequence[order], turn[order]
    steps = int(size[0]) if len(size) else 0
    active = [int(np.searchsorted(-size, -t, "left")) for t in range(steps)]  # chunks longer than t

    entry = np.full((len(size), n_labels), 1.0 / n_labels)
    leave = np.ones((len(size), n_labels))
    if pieces.max(initial=0) > 1:
        across = np.tile(np.eye(n_labels), (len(size), 1, 1))
        for t in range(steps):
            k = active[t]
            m = (across[:k] @ a) * e[begin[:k] + t][:, None, :]
            across[:k] = m / m.sum(axis=(1, 2), keepdims=True)
        place = np.empty((len(lengths), int(pieces.max())), dtype=np.int64)
        place[sequence, turn] = np.arange(len(size))
        for t in range(1, place.shape[1]):
            more = np.flatnonzero(pieces > t)
            before, here = place[more, t - 1], place[more, t]
            entry[here] = _scaled((entry[before][:, None, :] @ across[before])[:, 0])
        for t in range(place.shape[1] - 2, -1, -1):
            more = np.flatnonzero(pieces > t + 1)
            here, after = place[more, t], place[more, t + 1]
            leave[here] = _scaled((across[after] @ leave[after][:, :, None])[:, :, 0])

    result = np.empty_like(e)
    state = entry
    for t in range(steps):
        k = active[t]
        state = _scaled((state[:k] @ a) * e[begin[:k] + t])
        result[begin[:k] + t] = state
    state = leave.copy()
    for t in range(steps - 1, -1, -1):
        k = active[t]
        result[begin[:k] + t] *= state[:k]
        state[:k] = _scaled((e[begin[:k] + t] * state[:k]) @ a.T)
    return _scaled(result)


def _gradient(scores, transitions, labels, n_sequences, length):
    """Of the log likelihood of equally long sequences, with respect to scores and transitions."""
    n_labels = scores.shape[1]
    e = np.exp(scores - scores.max(axis=1, keepdims=True)).reshape(n_sequences, length, n_labels)
    a = np.exp(transitions - transitions.max())
    y = labels.reshape(n_sequences, length)
    forward, backward = np.empty_like(e), np.ones_like(e)
    state = np.full((n_sequences, n_labels), 1.0 / n_labels)
    for t in range(length):
        state = forward[:, t] = _scaled((state @ a) * e[:, t])
    for t in range(length - 2, -1, -1):
        backward[:, t] = _scaled((e[:, t + 1] * backward[:, t + 1]) @ a.T)
    single = _scaled(forward * backward)
    before, after = forward[:, :-1].reshape(-1, n_labels), (e[:, 1:] * backward[:, 1:]).reshape(-1, n_labels)
    pairs = a * (before.T @ (after / ((before @ a) * after).sum(axis=1, keepdims=True)))
    seen = np.zeros_like(transitions)
    np.add.at(seen, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
    d_scores = -single.reshape(-1, n_labels)
    d_scores[np.arange(len(labels)), labels] += 1
    return d_scores, seen - pairs


def train(texts: list[str], langs: list[str], settings: Settings) -> Model:
    languages, size = tuple(sorted(set(langs))), 1 << settings.buckets_log2
    weights = np.zeros((size, len(languages)), dtype=np.float32)
    transitions = np.zeros((len(languages), len(languages)))
    none = np.zeros(0, dtype=np.uint64)
    model = Model(settings, languages, weights, transitions, none)
    hasher, random = Hasher(), np.random.default_rng(settings.seed)
    lowered = pc.utf8_lower(pa.array(texts, pa.large_string()))
    joined = np.frombuffer("\n".join(lowered.to_pylist()).encode(), dtype=np.uint8)
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(pc.add(pc.binary_length(lowered), 1).to_numpy(zero_copy_only=False), out=offsets[1:])
    if len(texts):
        offsets[-1] -= 1
    starts, ends, first = _words(joined, offsets)
    if len(languages) < 2 or not len(starts):
        return model
    prefix = hasher.prefix(joined)
    own, times = np.unique(hasher.between(prefix, starts, ends), return_counts=True)
    lexicon = own[times >= settings.lexicon]
    model = Model(settings, languages, weights, transitions, lexicon)

    label = np.repeat([languages.index(x) for x in langs], np.diff(first))
    by_label = [np.flatnonzero(label == k) for k in range(len(languages))]
    by_label = [x for x in by_label if len(x)]
    squares_w, squares_t = np.full(weights.shape, 1e-6, dtype=np.float32), np.full(transitions.shape, 1e-6)
    segment = settings.sequence // 3
    for _ in range(settings.steps):
        chosen = []
        for _ in range(settings.batch * 3):
            own = by_label[random.integers(len(by_label))]
            start = random.integers(max(1, len(own) - segment))
            chosen.append(np.resize(own[start : start + segment], segment))
        chosen = np.concatenate(chosen)
        parts = list(_features(prefix, starts[chosen], ends[chosen], lexicon, settings, hasher))
        ids, place = np.concatenate([b for b, _ in parts]), np.concatenate([w for _, w in parts])
        scores = np.stack([np.bincount(place, weights[ids, k], len(chosen)) for k in range(len(languages))], axis=1)
        d_scores, d_transitions = _gradient(scores, transitions, label[chosen], settings.batch, 3 * segment)
        for k in range(len(languages)):
            g = np.bincount(ids, d_scores[place, k], size).astype(np.float32) / settings.batch
            squares_w[:, k] += g * g
            weights[:, k] += settings.rate * g / np.sqrt(squares_w[:, k])
        g = d_transitions / settings.batch
        squares_t += g * g
        transitions += settings.rate * g / np.sqrt(squares_t)
    return model


def fit(documents: DataFrame, held_out, settings: Settings = Settings()) -> Model:
    """Learn from texts and non-null ``lang`` of rows that are not held out.

    One pass counts languages, a second fetches about ``sample_rows`` documents of each, chosen
    by a hash of the text and id.
    """
    usable = documents.where("lang IS NOT NULL AND text IS NOT NULL").where(~held_out)
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not counts:
        return train([], [], settings)
    wanted = max(settings.least_rows, min(settings.sample_rows, settings.sample_total // len(counts)))
    shares = [x for lang, n in sorted(counts.items()) for x in (F.lit(lang), F.lit(min(1.0, wanted / n)))]
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rows = usable.where(draw < F.create_map(*shares)[F.col("lang")]).select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    rows = rows.orderBy("h", "lang", "text").limit(2 * wanted * len(counts)).collect()
    return train([r["text"] for r in rows], [r["lang"] for r in rows], settings)


def _no_letter(raw: bytes) -> bool:
    return not any(c.isalpha() for c in raw.decode("utf-8", "replace"))


def predict(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``lang_pred``, ``score`` and ``certainty``; columns named in ``keep``, or all, are carried."""
    fields = [f for f in df.schema.fields if f.name not in ("lang_pred", "score", "certainty") and (keep is None or f.name in keep)]
    names = [f.name for f in fields]
    schema = StructType(fields + [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("certainty", DoubleType())])
    # plain arrays, which need no module to be read back
    settings, languages = model.settings, model.languages
    shared = df.sparkSession.sparkContext.broadcast((model.weights, model.transitions, model.lexicon))
    carried = names if text in names else [*names, text]

    def run(batches):
        model, hasher = Model(settings, languages, *shared.value), Hasher()
        labels = np.array([*model.languages, UNKNOWN], dtype=object)
        many = len(model.languages) > MANY
        limit = max(1, CELLS // (len(model.languages) + 4))
        for batch in batches:
            lowered = pc.utf8_lower(column(batch, text).cast(pa.large_string()).fill_null(""))
            for start, count, data, offsets in text_slices(lowered, limit):
                starts, ends, first = _words(data, offsets)
                best, sure, certain = np.full(count, len(model.languages)), np.zeros(count), np.zeros(count)
                full = np.flatnonzero(np.diff(first) > 0)
                if len(full) and len(model.languages):
                    scores = _emissions(data, starts, ends, model, hasher)
                    found = label_probabilities(scores, first, model.transitions, len(starts) if many else model.settings.chunk)
                    mean = np.add.reduceat(found, first[full], axis=0) / np.diff(first)[full][:, None]
                    best[full], sure[full] = mean.argmax(axis=1), mean.max(axis=1)
                    certain[full] = np.add.reduceat(found.max(axis=1), first[full]) / np.diff(first)[full]
                    plain = np.zeros(len(data) + 1, dtype=np.int64)
                    np.cumsum(_LETTERS[data] & (data < 128), out=plain[1:])
                    for r in full[plain[offsets[full + 1]] == plain[offsets[full]]]:
                        if _no_letter(data[offsets[r] : offsets[r + 1]].tobytes()):
                            best[r], sure[r], certain[r] = len(model.languages), 0.0, 0.0
                own = [column(batch, name).slice(start, count) for name in names]
                yield pa.RecordBatch.from_arrays(own + [pa.array(labels[best], pa.string()), pa.array(np.minimum(sure, 1.0)), pa.array(np.minimum(certain, 1.0))], [*names, "lang_pred", "score", "certainty"])

    return df.select(*[F.col(f"`{x}`") for x in carried]).mapInArrow(run, schema)
