"""Byte-level BPE: encoding with a segment tree over adjacent pair ranks, and decoding.

The leaves of the tree are the ranks of neighbouring symbol pairs, its root the leftmost pair
of lowest rank. A merge changes three leaves, each in logarithmic time, until the root holds no
mergeable pair; a piece of n bytes costs O(n log n), however long it is.

Pieces come from the tokenizer file's word pattern and never cross an added token. Encoded words
are remembered up to ``CACHE_WORDS``, which changes speed only.

Defined cases: a null text counts as empty and has no tokens. Rows are encoded one by one, so
repeated rows and ids are fine. Columns named like an added column are replaced.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from siltgate.llm.text import column

CACHE_WORDS = 600_000
#: Rows encoded together.
ROWS = 512

# Fixed value: the word pattern that byte-level tokenizer files with "use_regex" imply.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"

#: A blank with white space before and none but white space after it: words cannot be split there.
_LOOSE_BLANK = re.compile(r"\s (?!\S)")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies.

    Printable Latin-1 characters stand for themselves, the other bytes for those from U+0100 on.
    """
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Vocabulary:
    """A byte-level BPE tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model, letters = content["model"], byte_letters()
        if model["type"] != "BPE" or (content["pre_tokenizer"] or {}).get("type") != "ByteLevel" or content["normalizer"] or content["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{path} is not a plain byte-level BPE tokenizer")
        ids, values = model["vocab"], {x: b for b, x in enumerate(letters)}
        self.byte_ids = np.array([ids[x] for x in letters])
        merges = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        pairs = np.array([ids[a] << 32 | ids[b] for a, b in merges], dtype=np.int64)
        self.merged_ids = np.array([ids[a + b] for a, b in merges])
        self._pairs, self._ranks = np.unique(pairs, return_index=True)
        self.added = {x["content"]: x["id"] for x in content["added_tokens"]}
        self.bytes_of = {i: bytes(map(values.__getitem__, token)) for token, i in ids.items()}
        self.bytes_of |= {i: token.encode() for token, i in self.added.items()}

    def pair_ranks(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        """A pair's rank and then its place in one number, ``_NONE`` where the pair never merges."""
        wanted = left << 32 | right
        at = np.minimum(np.searchsorted(self._pairs, wanted), len(self._pairs) - 1)
        return np.where(self._pairs[at] == wanted, self._ranks[at] << 32 | place, _NONE)

    @cached_property
    def merges(self) -> dict[tuple[int, int], int]:
        return dict(zip(zip((self._pairs >> 32).tolist(), (self._pairs & 0xFFFFFFFF).tolist()), self._ranks.tolist()))

    @cached_property
    def lengths(self) -> np.ndarray:
        table = np.zeros(max(self.bytes_of) + 1, dtype=np.int64)
        for i, value in self.bytes_of.items():
            table[i] = len(value)
        return table

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


_NONE = np.int64(1 << 62)
#: Pieces of more bytes are merged one by one.
SHORT = 64


def merge_piece(piece: bytes, vocabulary: Vocabulary) -> bytes:
    """One long piece."""
    n, none, merges = len(piece), int(_NONE), vocabulary.merges
    symbols = vocabulary.byte_ids[np.frombuffer(piece, dtype=np.uint8)].tolist()
    width = 1 << (n - 1).bit_length()
    tree = [none] * (2 * width)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def key(left: int, right: int) -> int:
        if left < 0 or right >= n:
            return none
        rank = merges.get((symbols[left], symbols[right]))
        return none if rank is None else rank << 32 | left

    def put(place: int, low: int) -> None:
        node = width + place
        tree[node] = low
        while node > 1:
            low = min(low, tree[node ^ 1])
            node >>= 1
            if tree[node] == low:
                break
            tree[node] = low

    tree[width : width + n] = [key(i, i + 1) for i in range(n)]
    for node in range(width - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])
    while (root := tree[1]) != none:
        i, j = root & 0xFFFFFFFF, after[root & 0xFFFFFFFF]
        k, h = after[j], before[i]
        symbols[i], symbols[j], after[i] = int(vocabulary.merged_ids[root >> 32]), -1, k
        if k < n:
            before[k] = i
        put(j, none)
        put(i, key(i, k))
        if h >= 0:
            put(h, key(h, i))
    return np.array([x for x in symbols if x >= 0], dtype="<u4").tobytes()


def merge_pieces(pieces: list[bytes], vocabulary: Vocabulary) -> list[bytes]:
    """The ids of each piece, as little-endian 32-bit integers.

    Short pieces of about one length are merged side by side, each with a segment tree of its own.
    """
    out = [merge_piece(x, vocabulary) if len(x) > SHORT else b"" for x in pieces]
    lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
    widths = 1 << np.maximum(1, np.ceil(np.log2(np.maximum(lengths, 1)))).astype(np.int64)
    for width in np.unique(widths[lengths <= SHORT]):
        same = np.flatnonzero((widths == width) & (lengths <= SHORT))
        rows = max(1, (1 << 19) // int(width))
        for start in range(0, len(same), rows):
            chosen = same[start : start + rows]
            for k, ids in zip(chosen.tolist(), _merged([pieces[k] for k in chosen], int(width), vocabulary)):
                out[k] = ids
    return out


def _merged(pieces: list[bytes], width: int, vocabulary: Vocabulary) -> list[bytes]:
    n = len(pieces)
    lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=n)
    inside = np.arange(width) < lengths[:, None]
    symbols = np.full((n, width), -1, dtype=np.int64)
    symbols[inside] = vocabulary.byte_ids[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
    after = np.tile(np.arange(1, width + 1), (n, 1))
    before = np.tile(np.arange(-1, width - 1), (n, 1))

    # node 1 is the root, leaf width + i the pair that starts at i: its rank, then i
    tree = np.full((n, 2 * width), _NONE)
    row, place = np.nonzero(inside[:, 1:])
    tree[row, width + place] = vocabulary.pair_ranks(symbols[row, place], symbols[row, place + 1], place)
    level = width
    while level > 1:
        tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
        level //= 2

    row = np.flatnonzero(tree[:, 1] < _NONE)
    while len(row):
        root = tree[row, 1]
        i = root & 0xFFFFFFFF
        j = after[row, i]
        k, h = after[row, j], before[row, i]
        merged = vocabulary.merged_ids[root >> 32]
        symbols[row, i], symbols[row, j], after[row, i] = merged, -1, k
        has_k, has_h = k < lengths[row], h >= 0
        before[row[has_k], k[has_k]] = i[has_k]
        leaf_i, leaf_h = np.full(len(row), _NONE), np.full(len(row), _NONE)
        leaf_i[has_k] = vocabulary.pair_ranks(merged[has_k], symbols[row[has_k], k[has_k]], i[has_k])
        leaf_h[has_h] = vocabulary.pair_ranks(symbols[row[has_h], h[has_h]], merged[has_h], h[has_h])
        tree[row, width + j] = _NONE
        tree[row, width + i] = leaf_i
        tree[row[has_h], width + h[has_h]] = leaf_h[has_h]
        for leaf in (j, i, np.where(has_h, h, i)):
            node = (width + leaf) >> 1
            while node[0]:  # all leaves are equally deep
                tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])
                node >>= 1
        row = row[tree[row, 1] < _NONE]
    left = symbols >= 0
    ends = (np.cumsum(left.sum(axis=1)) * 4).tolist()
    ids = symbols[left].astype("<u4").tobytes()
    return [ids[a:b] for a, b in zip([0, *ends], ends)]


class Encoder:
    """Encodes whole texts; keeps what it learned about words, as little-endian 32-bit ids."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.pattern = regex.compile(PATTERN)
        self.pieces: dict[str, bytes] = {}
        self.after_blank: dict[str, bytes] = {}
        contents = sorted(vocabulary.added, key=len, reverse=True)
        self.added = re.compile("(" + "|".join(map(re.escape, contents)) + ")") if contents else None

    def _learn_pieces(self, pieces: set[str]) -> None:
        new = list(pieces.difference(self.pieces))
        self.pieces.update(zip(new, merge_pieces([x.encode() for x in new], self.vocabulary)))

    def _learn_words(self, words: set[str]) -> None:
        new = list(words.difference(self.after_blank))
        parts = [[" " + word] if word.isalpha() else self.pattern.findall(" " + word) for word in new]
        self._learn_pieces({x for part in parts for x in part})
        known = self.pieces
        self.after_blank.update((word, b"".join([known[x] for x in part])) for word, part in zip(new, parts))

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.pieces) + len(self.after_blank) > CACHE_WORDS:
            self.pieces, self.after_blank = {}, {}
        # each text is a list of (added token | pieces of the pattern, words that follow blanks)
        split, pieces, words = [], set(), set()
        for text in texts:
            parts = []
            for k, part in enumerate(self.added.split(text) if self.added else [text]):
                if k % 2:
                    parts.append((part, None))
                    continue
                head, *rest = [part] if _LOOSE_BLANK.search(part) else part.split(" ")
                first = self.pattern.findall(head)
                parts.append((first, rest))
                pieces.update(first)
                words.update(rest)
            split.append(parts)
        self._learn_pieces(pieces)
        self._learn_words(words)
        out = []
        for parts in split:
            ids = []
            for first, rest in parts:
                if rest is None:
                    ids.append(np.array([self.vocabulary.added[first]], dtype="<u4").tobytes())
                else:
                    ids += map(self.pieces.__getitem__, first)
                    ids += map(self.after_blank.__getitem__, rest)
            out.append(np.frombuffer(b"".join(ids), dtype="<u4"))
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.encode_many([text])[0]


def encode_documents(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, outputs: tuple[str, ...] = ("ids",)) -> DataFrame:
    """Add the wanted ``outputs`` of each whole text; columns named in ``keep``, or all, are carried.

    Outputs are ``ids`` (array of int), ``decoded`` (text decoded from the ids), ``n_tokens``,
    ``ids_sha256`` (of the ids as little-endian unsigned 32-bit integers) and ``decoded_sha256``.
    ``path`` must be readable on the executors.
    """
    kinds = {"ids": ArrayType(IntegerType()), "decoded": StringType(), "n_tokens": LongType(), "ids_sha256": StringType(), "decoded_sha256": StringType()}
    fields = [f for f in df.schema.fields if f.name not in outputs and (keep is None or f.name in keep)]
    names = [f.name for f in fields]
    schema = StructType(fields + [StructField(x, kinds[x]) for x in outputs])
    carried = names if text in names else [*names, text]

    def row(encoder: Encoder, ids: np.ndarray) -> dict:
        out = {"n_tokens": len(ids)}
        if "ids" in outputs:
            out["ids"] = ids
        if "ids_sha256" in outputs:
            out["ids_sha256"] = hashlib.sha256(ids.tobytes()).hexdigest()
        if "decoded" in outputs or "decoded_sha256" in outputs:
            out["decoded"] = encoder.vocabulary.decode(ids)
            out["decoded_sha256"] = hashlib.sha256(out["decoded"].encode()).hexdigest()
        return out

    def run(batches):
        encoder = Encoder(Vocabulary(path))
        for batch in batches:
            texts = column(batch, text)
            for start in range(0, len(texts), ROWS):
                found = [row(encoder, ids) for ids in encoder.encode_many([x or "" for x in texts.slice(start, ROWS).to_pylist()])]
                own = [column(batch, name).slice(start, ROWS) for name in names]
                arrow = {"ids": pa.list_(pa.uint32()), "n_tokens": pa.int64()}
                new = [pa.array([x[name] for x in found], arrow.get(name, pa.string())) for name in outputs]
                new = [x.cast(pa.list_(pa.int32())) if name == "ids" else x for name, x in zip(outputs, new)]
                yield pa.RecordBatch.from_arrays(own + new, [*names, *outputs])

    return df.select(*[F.col(f"`{x}`") for x in carried]).mapInArrow(run, schema)
