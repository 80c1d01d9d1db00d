"""Ranked lexical search over bit-sliced Bloom signatures.

The index has one signature per document, in blocks of documents: row p of a block's bit matrix
is a bitmap of the documents whose signature has bit p. A document's signature holds its terms
and, under other hashes, those that occur at least 2, 4, 8, ... times. Its width follows its
number of terms, so long texts take more bits and no signature fills up. The bitmaps of a term's
bits, taken together, never miss a document with the term, so they bound a term's occurrences
from above. Weighted sums of these bounds over an item's terms are upper bounds of scores.

1. One pass over the texts writes the index and counts, exactly, the documents per query term.
2. A pass over the index finds each item's ``k`` documents with the largest bounds. Their exact
   scores give each item a threshold that its k-th best document reaches.
3. A second pass over the index keeps the documents whose bound reaches the threshold of some
   item. All others are provably not among the best. The kept ones are scored exactly.

Items are taken in blocks of ``BLOCK_ITEMS`` and ``BLOCK_BYTES``, which bound what is broadcast
and what the driver holds, whatever the number of items. Hashes only propose terms; every
occurrence that counts is compared byte by byte.

Defined cases: a text that is null or has no term is never found, an item without a term finds
nothing, and nothing is found in an empty table. Items are rows: repeated item ids are ranked
one by one. Repeated documents are found as often as they stand in the table, ties in order of
the document key, null keys last. No other columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from siltgate.llm.terms import Vocabulary, terms, text_bytes
from siltgate.llm.text import Hasher, mix
from siltgate.session import scratch_path, scratch_table

#: Bounds of one block of items.
BLOCK_ITEMS, BLOCK_BYTES = 1024, 1 << 22
#: Signatures have this many bits a key at least, and a quarter more at most: about one false term in a thousand.
BITS = 14
PROBES = 6
#: Keys, and cells of a bit matrix, that a block of documents holds at most, unless one document has more.
BLOCK_KEYS, BLOCK_CELLS = 1 << 20, 1 << 24
#: Documents whose bounds are formed at once.
STRIP = 256

_LEVEL = 0xA0761D6478BD642F
_DOCUMENTS, _TERMS = -1, -2  # count rows that hold the number of documents and of terms


def factor(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The part of a term's score that depends on the document."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def probes(hashes: np.ndarray, level: int, width: int) -> np.ndarray:
    """Bits of each term in signatures of a width below 2 ** 32."""
    h = mix(hashes + np.uint64(level * _LEVEL % (1 << 64)))
    step, low = (h >> np.uint64(32)) | np.uint64(1), np.uint64(0xFFFFFFFF)
    places = (h[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) & low
    return ((places * np.uint64(width)) >> np.uint64(32)).astype(np.int64)


def signature_width(keys: int) -> int:
    """The least width of a geometric row that has ``BITS`` bits for each key."""
    return math.ceil(64 * 1.25 ** max(0, math.ceil(math.log(BITS * keys / 64, 1.25))))


def _rows(batch: pa.RecordBatch, place: int, hasher: Hasher, vocabulary: Vocabulary):
    """Per text of a batch: (row, distinct term hashes, their counts); at last the found (row, term) codes."""
    data, offsets = text_bytes(batch.column(place))
    codes, held, row = [], [], -1

    def done():
        values = np.sort(np.concatenate(held))
        first = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
        return row, values[first], np.diff(np.append(first, len(values)))

    for rows, hashes, starts, ends in terms(data, offsets, hasher):
        if not len(rows):
            continue
        which, term = vocabulary.find(data, hashes, starts, ends)
        codes.append(np.unique(rows[which] * len(vocabulary) + term))
        cuts = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        for begin, end in zip(cuts.tolist(), [*cuts[1:].tolist(), len(rows)]):
            if rows[begin] != row:
                if held:
                    yield done()
                row, held = int(rows[begin]), []
            held.append(hashes[begin:end])
    if held:
        yield done()
    yield None, np.unique(np.concatenate(codes)) if codes else np.zeros(0, np.int64), None


def _blocks(pending: list) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, int, bytes]]:
    """(rows, terms, highest count, width, bits) of blocks of documents with signatures of one width."""
    keyed = []
    for row, hashes, counts in pending:
        levels = int(counts.max()).bit_length()
        keys = sum(int(np.count_nonzero(counts >= 1 << level)) for level in range(levels))
        keyed.append((signature_width(keys), row, hashes, counts, levels))
    keyed.sort(key=lambda x: x[:2])
    at = 0
    while at < len(keyed):
        width, end = keyed[at][0], at + 1
        while end < len(keyed) and keyed[end][0] == width and (end - at + 1) * width <= BLOCK_CELLS:
            end += 1
        cells = np.zeros((width, end - at), dtype=bool)
        for place, (_, _, hashes, counts, levels) in enumerate(keyed[at:end]):
            for level in range(levels):
                cells[probes(hashes[counts >= 1 << level], level, width), place] = True
        chosen = keyed[at:end]
        n = np.array([int(x[3].sum()) for x in chosen], dtype=np.int64)
        top = np.array([int(x[3].max()) for x in chosen], dtype=np.int64)
        yield [x[1] for x in chosen], n, top, width, np.packbits(cells, axis=1).tobytes()
        at = end


def scan(documents: DataFrame, vocabulary: Vocabulary, index: bool) -> DataFrame:
    """One pass over (id, hash, text): index blocks, if asked for, and rows with counts of query terms."""
    key = documents.schema["id"].dataType
    long_list = ArrayType(LongType())
    schema = StructType(
        [StructField("ids", ArrayType(key)), StructField("hashes", long_list), StructField("n", long_list), StructField("top", long_list)]
        + [StructField("width", IntegerType()), StructField("bits", BinaryType()), StructField("term", IntegerType()), StructField("found", LongType())]
    )
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary.words)

    def one_list(values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, hasher = Vocabulary(shared.value), Hasher()
        found = np.zeros(len(vocabulary) + 2, dtype=np.int64)
        id_list, long = pa.list_(pa.null()), pa.list_(pa.int64())

        def flush(batch, pending):
            for rows, n, top, width, bits in _blocks(pending):
                place = pa.array(rows, pa.int64())
                lists = [one_list(batch.column(0).take(place)), one_list(batch.column(1).take(place)), one_list(pa.array(n)), one_list(pa.array(top))]
                rest = [pa.array([width], pa.int32()), pa.array([bits], pa.binary()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64())]
                yield pa.RecordBatch.from_arrays(lists + rest, names)

        for batch in batches:
            id_list = pa.list_(batch.schema.field(0).type)
            pending, keys = [], 0
            for row, hashes, counts in _rows(batch, 2, hasher, vocabulary):
                if row is None:
                    found[:-2] += np.bincount(hashes % len(vocabulary), minlength=len(vocabulary)) if len(hashes) else 0
                    continue
                found[_DOCUMENTS] += 1
                found[_TERMS] += counts.sum()
                if index:
                    pending.append((row, hashes, counts))
                    keys += len(hashes)
                    if keys >= BLOCK_KEYS:
                        yield from flush(batch, pending)
                        pending, keys = [], 0
            yield from flush(batch, pending)
        seen = np.flatnonzero(found)
        own = [pa.nulls(len(seen), id_list)] + [pa.nulls(len(seen), long)] * 3 + [pa.nulls(len(seen), pa.int32()), pa.nulls(len(seen), pa.binary())]
        place = np.where(seen < len(vocabulary), seen, seen - len(found))
        yield pa.RecordBatch.from_arrays(own + [pa.array(place, pa.int32()), pa.array(found[seen])], names)

    names = schema.fieldNames()
    return documents.select("id", "hash", "text").mapInArrow(run, schema)


@dataclass(frozen=True)
class Query:
    """A block of items with the weights of their terms, as plain arrays."""

    hashes: np.ndarray
    weights: np.ndarray
    flat: np.ndarray  # terms of all items, one after another
    first: np.ndarray  # where each item's begin
    documents: int
    terms: int

    def parts(self) -> tuple:
        return self.hashes, self.weights, self.flat, self.first, self.documents, self.terms


def _length_norm(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    return 50 + (50 * n * documents) // max(total, 1)


def _bounds(ids: int, n: np.ndarray, top: np.ndarray, width: int, bits: bytes, query: Query) -> Iterator[tuple[int, np.ndarray]]:
    """(first document, upper bounds of items x documents) for strips of a block."""
    slices = np.frombuffer(bits, dtype=np.uint8).reshape(width, -1)
    m = _length_norm(n, query.documents, query.terms)
    levels = int(top.max()).bit_length()
    reach = np.stack([factor(np.minimum((1 << level) - 1, top), m) for level in range(levels + 1)])
    for begin in range(0, ids, STRIP):
        end = min(begin + STRIP, ids)
        part = slices[:, begin // 8 : -(-end // 8)]
        level_of = np.zeros((len(query.hashes), end - begin), dtype=np.uint8)
        alive, before = np.arange(len(query.hashes)), None
        for level in range(levels):
            maps = np.bitwise_and.reduce(part[probes(query.hashes[alive], level, width)], axis=1)
            if before is not None:
                maps &= before
            some = maps.any(axis=1)
            alive, before = alive[some], maps[some]
            if not len(alive):
                break
            level_of[alive] += np.unpackbits(before, axis=1, count=end - begin)
        value = reach[:, begin:end][level_of, np.arange(end - begin)] * query.weights[:, None]
        yield begin, np.add.reduceat(value[query.flat], query.first, axis=0)


def _index_rows(batches: Iterator[pa.RecordBatch]):
    """(ids, text hashes, terms, highest counts, width, bits) of every block."""
    for batch in batches:
        for k in range(batch.num_rows):
            ids, hashes, n, top = (batch.column(c)[k].values for c in range(4))
            yield ids, hashes, n.to_numpy(), top.to_numpy(), batch.column(4)[k].as_py(), batch.column(5)[k].as_buffer()


_INDEX = ["ids", "hashes", "n", "top", "width", "bits"]


def leading(index: DataFrame, query: Query, k: int) -> DataFrame:
    """(item, id, hash, bound): of each task, the ``k`` documents with the largest bounds of each item."""
    key = index.schema["ids"].dataType.elementType
    schema = StructType([StructField("item", IntegerType()), StructField("id", key), StructField("hash", LongType()), StructField("bound", LongType())])
    shared = index.sparkSession.sparkContext.broadcast(query.parts())
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query = Query(*shared.value)
        count = len(query.first)
        best = np.zeros((count, k), dtype=np.int64)
        owner = np.full((count, k), -1, dtype=np.int64)  # places in the documents held
        held_ids, held_hashes, held = [], [], 0
        for ids, hashes, n, top, width, bits in _index_rows(batches):
            used = []
            for begin, bound in _bounds(len(ids), n, top, width, bits, query):
                better = np.flatnonzero((bound > best.min(axis=1)[:, None]).any(axis=1))
                if not len(better):
                    continue
                both = np.concatenate([best[better], bound[better]], axis=1)
                places = np.concatenate([owner[better], np.tile(held + begin + np.arange(bound.shape[1]), (len(better), 1))], axis=1)
                chosen = np.argpartition(-both, k - 1, axis=1)[:, :k]
                best[better] = np.take_along_axis(both, chosen, axis=1)
                owner[better] = np.take_along_axis(places, chosen, axis=1)
                used.append(begin)
            if used:
                held_ids.append(ids)
                held_hashes.append(hashes)
                held += len(ids)
            if held > 8 * count * k + (1 << 16):  # let go of documents that are no longer among the best
                places, owner[best > 0] = np.unique(owner[best > 0], return_inverse=True)
                held_ids = [pa.concat_arrays(held_ids).take(pa.array(places))]
                held_hashes = [pa.concat_arrays(held_hashes).take(pa.array(places))]
                held = len(places)
        item, place = np.nonzero(best > 0)
        if len(item):
            at = pa.array(owner[item, place])
            values = [pa.concat_arrays(held_ids).take(at), pa.concat_arrays(held_hashes).take(at)]
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), *values, pa.array(best[item, place])], names)

    return index.select(*_INDEX).mapInArrow(run, schema)


def reaching(index: DataFrame, query: Query, thresholds: np.ndarray) -> DataFrame:
    """(id, hash, items): documents whose bound reaches the threshold of these items."""
    key = index.schema["ids"].dataType.elementType
    schema = StructType([StructField("id", key), StructField("hash", LongType()), StructField("items", ArrayType(IntegerType()))])
    shared = index.sparkSession.sparkContext.broadcast((query.parts(), thresholds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, thresholds = shared.value
        query = Query(*parts)
        for ids, hashes, n, top, width, bits in _index_rows(batches):
            for begin, bound in _bounds(len(ids), n, top, width, bits, query):
                document, item = np.nonzero((bound >= thresholds[:, None]).T)
                if not len(document):
                    continue
                which, first = np.unique(document, return_index=True)
                items = pa.ListArray.from_arrays(pa.array([*first, len(item)], pa.int32()), pa.array(item, pa.int32()))
                at = pa.array(which + begin)
                yield pa.RecordBatch.from_arrays([ids.take(at), hashes.take(at), items], schema.fieldNames())

    return index.select(*_INDEX).mapInArrow(run, schema)


def exact_scores(documents: DataFrame, vocabulary: Vocabulary, query: Query, thresholds: np.ndarray) -> DataFrame:
    """(item, id, score) for (id, text, items) rows, from the whole texts; only scores that reach the item's threshold."""
    schema = StructType([StructField("item", IntegerType()), StructField("id", documents.schema["id"].dataType), StructField("score", LongType())])
    shared = documents.sparkSession.sparkContext.broadcast((vocabulary.words, query.parts(), thresholds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, parts, thresholds = shared.value
        vocabulary, query, hasher = Vocabulary(words), Query(*parts), Hasher()
        size = len(vocabulary)
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            codes, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            length = np.zeros(batch.num_rows, dtype=np.int64)
            for rows, hashes, starts, ends in terms(data, offsets, hasher):
                length += np.bincount(rows, minlength=len(length))
                which, term = vocabulary.find(data, hashes, starts, ends)
                code, count = np.unique(rows[which] * size + term, return_counts=True)
                codes.append(code)
                times.append(count)
            code, inverse = np.unique(np.concatenate(codes), return_inverse=True)
            tf = np.zeros(len(code), dtype=np.int64)
            np.add.at(tf, inverse, np.concatenate(times))
            row, term = code // size, code % size
            part = query.weights[term] * factor(tf, _length_norm(length, query.documents, query.terms)[row])
            first = np.searchsorted(row, np.arange(batch.num_rows + 1))
            own, value = [], np.zeros(size, dtype=np.int64)
            for r in range(batch.num_rows):
                value[term[first[r] : first[r + 1]]] = part[first[r] : first[r + 1]]
                items = np.asarray(batch.column(2)[r].values)
                score = np.add.reduceat(value[query.flat], query.first)[items]
                value[term[first[r] : first[r + 1]]] = 0
                reached = score >= thresholds[items]
                own.append((items[reached], score[reached]))
            place = np.repeat(np.arange(batch.num_rows), [len(i) for i, _ in own])
            if len(place):
                item, score = (np.concatenate(x) for x in zip(*own))
                yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), batch.column(0).take(pa.array(place)), pa.array(score)], schema.fieldNames())

    return documents.select("id", "text", "items").mapInArrow(run, schema)


def _item_blocks(items: DataFrame) -> Iterator[list[tuple]]:
    """Items as (id, text) in blocks of a bounded number and size."""
    block, size = [], 0
    for row in items.toLocalIterator():
        if block and (len(block) >= BLOCK_ITEMS or size + len(row[1] or "") > BLOCK_BYTES):
            yield block
            block, size = [], 0
        block.append((row[0], row[1] or ""))
        size += len(block[-1][1])
    if block:
        yield block


def _item_terms(block: list[tuple]) -> list[set[bytes]]:
    """The terms of each item of a block."""
    data, offsets = text_bytes(pa.array([text for _, text in block], pa.large_string()))
    found: list[set[bytes]] = [set() for _ in block]
    for rows, _, starts, ends in terms(data, offsets, Hasher()):
        for row, start, end in zip(rows.tolist(), starts.tolist(), ends.tolist()):
            found[row].add(data[start:end].tobytes().lower())  # lower() of bytes changes A-Z alone
    return found


def _weighted(found: list[set[bytes]], vocabulary: Vocabulary, counts: dict[int, int]) -> tuple[Query, list[int]]:
    """The query of a block, and which of its items have a term that some document holds."""
    documents, total = counts.get(_DOCUMENTS, 0), counts.get(_TERMS, 0)
    weights = np.zeros(len(vocabulary), dtype=np.int64)
    for term, n in counts.items():
        if term >= 0:
            weights[term] = math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1)))
    used = [[k for k in sorted(vocabulary.place[w] for w in own) if weights[k] > 0] for own in found]
    live = [item for item, own in enumerate(used) if own]
    sizes = [len(used[item]) for item in live]
    flat = np.array([k for item in live for k in used[item]], dtype=np.int64)
    first = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
    return Query(vocabulary.hashes, weights, flat, first, documents, total), live


def _best(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(documents: DataFrame, items: DataFrame, k: int = 50, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item key, rank, document key, score): each item's ``k`` best documents with a score above 0."""
    spark: SparkSession = documents.sparkSession
    texts = documents.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text")).withColumn("hash", F.xxhash64("text"))
    wanted = items.select(F.col(f"`{item_key}`").alias("item_id"), F.col(f"`{item_text}`").alias("text"))
    names = StructType([StructField("item", IntegerType()), StructField("item_id", wanted.schema["item_id"].dataType)])
    folder, index, parts = scratch_path(spark, "bloom"), None, []
    for block in _item_blocks(wanted):
        found = _item_terms(block)
        vocabulary = Vocabulary(word for own in found for word in own)
        scanned = scan(texts, vocabulary, index is None)
        table = scratch_table(scanned, "bloom-counts") if index is not None else _written(scanned, folder)
        counts = {r["term"]: r["found"] for r in table.where("term IS NOT NULL").groupBy("term").agg(F.sum("found").alias("found")).collect()}
        index = table.where("term IS NULL") if index is None else index
        query, live = _weighted(found, vocabulary, counts)
        if not live:
            continue
        parts.append((_searched(texts, index, vocabulary, query, k), spark.createDataFrame([(n, block[item][0]) for n, item in enumerate(live)], names)))
    result = None
    for scores, named in parts:
        ranked = _best(scores, k).join(F.broadcast(named), "item")  # at most BLOCK_ITEMS rows
        own = ranked.select(F.col("item_id").alias(item_key), "rank", F.col("id").alias(key), "score")
        result = own if result is None else result.unionByName(own)
    if result is None:
        nothing = StructType([StructField(item_key, names["item_id"].dataType), StructField("rank", IntegerType()), StructField(key, texts.schema["id"].dataType), StructField("score", LongType())])
        return spark.createDataFrame([], nothing)
    return result


def _written(df: DataFrame, folder: str) -> DataFrame:
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _searched(texts: DataFrame, index: DataFrame, vocabulary: Vocabulary, query: Query, k: int) -> DataFrame:
    """Exact scores of every document that may be among the best ``k`` of an item."""
    bounds = leading(index, query, k).withColumnRenamed("bound", "score")
    seeds = _best(bounds, k).groupBy("id", "hash").agg(F.array_sort(F.collect_set("item")).alias("items"))
    # at most BLOCK_ITEMS * k rows, and as many items in all of them
    thresholds = np.ones(len(query.first), dtype=np.int64)
    seeded = exact_scores(_with_texts(texts, F.broadcast(seeds)), vocabulary, query, thresholds)
    reached = _best(seeded, k).groupBy("item").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n"))
    for row in reached.where(F.col("n") >= k).collect():
        thresholds[row["item"]] = row["least"]
    candidates = scratch_table(reaching(index, query, thresholds).dropDuplicates(["id", "hash"]), "bloom-candidates")
    return scratch_table(exact_scores(_with_texts(texts, candidates), vocabulary, query, thresholds), "bloom-scores")


def _with_texts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    own = wanted.withColumnsRenamed({"id": "wanted_id", "hash": "wanted_hash"})
    return texts.join(own, F.col("id").eqNullSafe(F.col("wanted_id")) & (F.col("hash") == F.col("wanted_hash"))).select("id", "text", "items")
