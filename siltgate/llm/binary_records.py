"""Token ids as length-delimited binary records, with an offset index.

A record file is a run of frames, written by Spark's own committers on any file system that
Spark reaches, so lost executors leave neither torn nor doubled frames:

    length   8 bytes, little-endian: bytes of the payload
    check    4 bytes: masked crc32 of the length bytes
    payload  doc_id (8 bytes, signed; the least value stands for null), bytes per id (1 byte: 2 or
             4, for vocabularies of up to 65536 ids and larger ones), then the ids, unsigned
    check    4 bytes: masked crc32 of the payload
    end      1 byte, 0x0A

A crc is masked by rotating it right by 15 bits and adding 0xA282EAD8 modulo 2**32, so that
records that hold records keep safe checks. Files follow each other by name, and documents by
ascending id within and across files. The index is a Parquet table with a row per record (where
it lies, its ids before it in the file, its count and checksum), made by reading the committed
files back; ``read_by_index`` fetches any of its records in any order.

Defined cases: a null text counts as empty; every document has its end id, so no record is
empty. Null ids come first, equal ids side by side in order of their texts. An empty table gives
no records. Extra columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F
from tokenizers import Tokenizer

from siltgate.llm.bpe import byte_letters
from siltgate.llm.text import column, text_slices

NO_ID = -(1 << 63)
HEAD, TAIL = 12, 5  # bytes of a frame around its payload
#: Pieces of words that are remembered.
CACHE_WORDS = 400_000
#: Bytes of text encoded together. A longer text is encoded alone.
SLICE = 4 << 20
BREAK = "\n"


def masked(crc: int) -> int:
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """All of a frame but its end byte, which the writer adds."""
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(zlib.crc32(head))), payload, struct.pack("<I", masked(zlib.crc32(payload)))))


def frames(content: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, payload) of each frame; fails on a wrong length or check."""
    at, view = 0, memoryview(content)
    while at < len(view):
        if at + HEAD > len(view):
            raise ValueError(f"The frame at byte {at} has no whole head.")
        size, check = struct.unpack_from("<QI", view, at)
        end = at + HEAD + size
        if masked(zlib.crc32(view[at : at + 8])) != check or end + TAIL > len(view):
            raise ValueError(f"The frame at byte {at} has a damaged length.")
        payload = bytes(view[at + HEAD : end])
        if masked(zlib.crc32(payload)) != struct.unpack_from("<I", view, end)[0] or view[end + 4] != 10:
            raise ValueError(f"The frame at byte {at} has damaged content.")
        yield at, payload
        at = end + TAIL


def packing(tokenizer: Tokenizer) -> str:
    return "<u2" if tokenizer.get_vocab_size() <= 1 << 16 else "<u4"


class _Pieces(dict):
    """The ids of each piece, packed."""

    def __init__(self, tokenizer: Tokenizer):
        super().__init__({BREAK: b""})
        self.tokenize = tokenizer.model.tokenize
        self.letters = byte_letters()
        kind = packing(tokenizer)
        self.of_id = [np.array(i, dtype=kind).tobytes() for i in range(tokenizer.get_vocab_size())]

    def __missing__(self, piece: str) -> bytes:
        letters = piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode()))
        of_id = self.of_id
        ids = b"".join([of_id[token.id] for token in self.tokenize(letters)])
        if len(piece) < 64:
            self[piece] = ids
        return ids


def _strings(array: pa.Array) -> list[str]:
    return array.to_numpy(zero_copy_only=False).tolist()


def _ends(array: pa.LargeBinaryArray) -> np.ndarray:
    """Where each value of a new array starts in its data, and where the last one ends."""
    return np.frombuffer(array.buffers()[1], dtype=np.int64, count=len(array) + 1) if len(array) else np.zeros(1, dtype=np.int64)


def _data(array: pa.LargeBinaryArray) -> pa.Buffer:
    return array.buffers()[2] or pa.py_buffer(b"")


class WordwiseTokenizer:
    """A library tokenizer whose word pattern drops white space; remembers pieces of words.

    Normalizer, word pattern and model are those of the file, and the model encodes each piece.
    Arrow cuts many texts into words at once and puts their ids together; each different word is
    normalized and cut into pieces once for these texts. For patterns that do not look across white
    space. Texts with an added token, or with a control character on whose blankness libraries
    differ, are encoded in one go.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        with open(path, encoding="utf-8") as file:
            split, letters = json.load(file)["pre_tokenizer"]["pretokenizers"]
        if (split["type"], split["behavior"], split["invert"], letters["type"]) != ("Split", "Removed", True, "ByteLevel"):
            raise ValueError(f"{path} does not split texts into words without white space")
        self.pattern = regex.compile(f"{BREAK}|{split['pattern']['Regex']}")
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = "|".join([*added, r"[\x00-\x08\x0e-\x1f]"])
        self.kind = packing(self.tokenizer)
        self.pieces = _Pieces(self.tokenizer)

    def _normal(self, words: pa.Array) -> list[str]:
        plain = pc.string_is_ascii(words).to_numpy(zero_copy_only=False)
        # NFC and lower case do nothing else to ASCII words
        normal = np.array(_strings(pc.ascii_lower(words)), dtype=object)
        other = _strings(words.filter(pa.array(~plain)))
        if other:
            found = self.tokenizer.normalizer.normalize_str(" ".join(other)).split(" ")
            normal[~plain] = found if len(found) == len(other) else [self.tokenizer.normalizer.normalize_str(x) for x in other]
        return normal.tolist()

    def _words(self, words: pa.Array) -> pa.LargeBinaryArray:
        """The packed ids of each word. No normalized word holds a line break, so one parts them."""
        parts = pa.array(self.pattern.findall(BREAK.join(self._normal(words))), pa.large_string()).dictionary_encode()
        different = _strings(parts.dictionary)
        ids = pa.array(list(map(self.pieces.__getitem__, different)), pa.large_binary()).take(parts.indices)
        breaks = parts.indices.to_numpy() == (different.index(BREAK) if len(words) > 1 else -1)
        ends = _ends(ids)
        ends = np.concatenate((ends[:1], ends[:-1][breaks], ends[-1:]))
        if len(ends) != len(words) + 1:
            raise ValueError("The word pattern looks across white space.")
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(ends), _data(ids)])

    def encode_many(self, texts: list[str] | pa.Array) -> list[memoryview | bytes]:
        """The packed ids of each text; a null text is empty."""
        if len(self.pieces) > CACHE_WORDS:
            self.pieces = _Pieces(self.tokenizer)
        texts = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())).cast(pa.large_string()).fill_null("")
        whole = pc.match_substring_regex(texts, self.whole)
        split = pc.utf8_split_whitespace(pc.if_else(whole, "", texts))
        words = split.flatten().dictionary_encode()
        ids = self._words(words.dictionary).take(words.indices) if len(words) else pa.array([], pa.large_binary())
        ends, data = _ends(ids)[split.offsets.to_numpy()].tolist(), memoryview(_data(ids))
        out: list[memoryview | bytes] = [data[a:b] for a, b in zip(ends, ends[1:])]
        for k in np.flatnonzero(whole.to_numpy(zero_copy_only=False)).tolist():
            out[k] = np.array(self.tokenizer.encode(texts[k].as_py(), add_special_tokens=False).ids, dtype=self.kind).tobytes()
        return out


@lru_cache(1)
def _loaded(path: str, changed: int, size: int) -> WordwiseTokenizer:
    return WordwiseTokenizer(path)


def tokenizer_of(path: str) -> WordwiseTokenizer:
    """The tokenizer of a file, once for all tasks of a Python worker, which follow each other."""
    file = os.stat(path)
    return _loaded(path, file.st_mtime_ns, file.st_size)


def unpacked(payload: bytes) -> tuple[int | None, np.ndarray]:
    """The document's id, and its ids as unsigned 32-bit integers."""
    key, width = struct.unpack_from("<qB", payload)
    return None if key == NO_ID else key, np.frombuffer(payload, dtype=f"<u{width}", offset=9).astype("<u4")


def write_records(df: DataFrame, folder: str, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> None:
    """Write ``folder``/records and ``folder``/index; ``tokenizer`` must be readable on the executors."""

    def run(batches):
        encoder = tokenizer_of(tokenizer)
        end, width = np.array([end_id], dtype=encoder.kind).tobytes(), np.dtype(encoder.kind).itemsize
        for batch in batches:
            ids, texts = column(batch, "doc_id"), column(batch, "text")
            for start, rows, _, _ in text_slices(texts, SLICE):
                keys = [NO_ID if x is None else x for x in ids.slice(start, rows).to_pylist()]
                found = encoder.encode_many(texts.slice(start, rows))
                yield pa.RecordBatch.from_arrays([pa.array([frame(b"".join((struct.pack("<qB", k, width), x, end))) for k, x in zip(keys, found)], pa.binary())], ["frame"])

    narrow = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    ordered = narrow.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.coalesce("text", F.lit("")))
    records = ordered.mapInArrow(run, "frame binary")
    # the text writer puts out each row's bytes as they are, and then its line end: the end byte
    records.select(F.col("frame").cast("string").alias("value")).write.text(f"{folder}/records", lineSep="\n")
    scan_records(df.sparkSession, folder).write.parquet(f"{folder}/index")


def _files(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(f"{folder}/records").where("length > 0")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")


def scan_records(spark: SparkSession, folder: str) -> DataFrame:
    """(file, doc_id, offset, length, before, n_tokens, ids_crc32) of every record, checks verified.

    ``before`` counts the ids of the earlier records of the same file.
    """

    def run(batches):
        for batch in batches:
            for file, content in zip(column(batch, "file").to_pylist(), column(batch, "content")):
                rows, before = [], 0
                for at, payload in frames(content.as_buffer().to_pybytes()):
                    key, ids = unpacked(payload)
                    rows.append((file, key, at, len(payload) + HEAD + TAIL, before, len(ids), zlib.crc32(ids)))
                    before += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), [pa.string()] + [pa.int64()] * 6)], ["file", "doc_id", "offset", "length", "before", "n_tokens", "ids_crc32"])

    return _files(spark, folder).mapInArrow(run, "file string, doc_id long, offset long, length long, before long, n_tokens long, ids_crc32 long")


def read_by_index(spark: SparkSession, folder: str, index: DataFrame) -> DataFrame:
    """(doc_id, ids) for rows of the index, in whatever order they are taken."""

    def run(batches):
        for batch in batches:
            found = [unpacked(next(frames(x.as_py()))[1]) for x in column(batch, "frame")]
            ids = pa.array([x.astype(np.int32) for _, x in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), ids], ["doc_id", "ids"])

    cut = F.substring("content", (F.col("offset") + 1).cast("int"), F.col("length").cast("int"))
    return index.select("file", "offset", "length").join(_files(spark, folder), "file").select(cut.alias("frame")).mapInArrow(run, "doc_id long, ids array<int>")


def sequence_starts(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), as read back from the files: ``start`` counts all ids before a record.

    Places within a file come with the scan; only one total per file is summed up in order.
    """
    records = spark.read.parquet(f"{folder}/index")
    totals = records.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    starts = totals.selectExpr("file", "sum(total) OVER (ORDER BY file) - total AS file_start")
    return records.join(starts, "file").select("doc_id", (F.col("file_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
