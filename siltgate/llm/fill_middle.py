"""Fill-in-the-middle: a document cut in three at token ends, its parts set in another order.

A text is one or more windows that end at token ends; one full match of ``(unit)*`` on a window
keeps every repetition, whose ends give the number of tokens and any cut offset at once. A text
up to ``WINDOW`` code points is a single window; longer ones take several, so that the matcher's
memory (about 180 bytes a token) stays bounded. Only a single token longer than that makes a
longer window.

What is drawn for a document depends on the seed and its key alone, so reruns and other
partitionings agree. The output names its parts by markers; a text that holds a marker itself
stays as it is, so ``restored`` gets back the exact text from output and form.

Defined cases: a null text is empty; an empty text has no tokens and form ``plain``. A null key
draws like an empty one. Rows are cut one by one, so repeated rows and keys are fine. Input
columns named like an added column are replaced; others may be carried along.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: Code points of one match, at least; a window ends with the token that reaches this far.
WINDOW = 1 << 18
#: Bytes of text in one batch that leaves a task's Python, unless one text has more.
OUT_BYTES = 4 << 20

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
OUTPUTS = ("n", "form", "prefix_chars", "middle_chars", "output")

# Atomic, so that the matcher keeps no way back into a token.
_UNITS = regex.compile(r"(?>([\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++))*+")
_TOKEN_END = regex.compile(r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")


@dataclass(frozen=True)
class Settings:
    """``plain_percent`` of the documents stay as they are; of the others, ``spm_percent`` start with the suffix."""

    seed: int = 42
    plain_percent: int = 50
    spm_percent: int = 80


def token_ends(text: str, window: int = WINDOW) -> np.ndarray:
    """The offset after each token of a text, in code points."""
    found, start = [], 0
    while start < len(text):
        stop = _TOKEN_END.search(text, start + window) if start + window < len(text) else None
        end = stop.start() if stop else len(text)
        found.append(np.array(_UNITS.fullmatch(text, start, end).ends(1), dtype=np.int64))
        start = end
    return np.concatenate(found) if found else np.zeros(0, dtype=np.int64)


def draws(key: str, seed: int) -> list[int]:
    """Four numbers below 2 ** 32 for a document."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).digest()
    return [int.from_bytes(digest[4 * k : 4 * k + 4], "big") for k in range(4)]


def cut(text: str, key: str, settings: Settings) -> tuple[int, str, int | None, int | None, str]:
    """Token count, form, lengths of prefix and middle, and the output."""
    ends = token_ends(text)
    n = len(ends)
    a, b, plain, form = draws(key, settings.seed)
    if not text or plain % 100 >= 100 - settings.plain_percent or any(x in text for x in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    low, high = (0 if k == 0 else int(ends[k - 1]) for k in sorted((a % (n + 1), b % (n + 1))))
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    if form % 100 < settings.spm_percent:
        return n, "spm", low, high - low, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", low, high - low, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def transform(df: DataFrame, key: str, text: str = "text", settings: Settings = Settings(), keep: list[str] | None = None) -> DataFrame:
    """Add ``n``, ``form``, ``prefix_chars``, ``middle_chars`` and ``output``; columns named in ``keep``, or all, are carried."""
    fields = [f for f in df.schema.fields if f.name not in OUTPUTS and (keep is None or f.name in keep)]
    names = [f.name for f in fields]
    kinds = (LongType(), StringType(), LongType(), LongType(), StringType())
    schema = StructType(fields + [StructField(name, kind) for name, kind in zip(OUTPUTS, kinds)])
    place = len(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            keys, texts = batch.column(place), batch.column(place + 1)
            first, rows, size = 0, [], 0
            for row in range(batch.num_rows):
                rows.append(cut(texts[row].as_py() or "", keys[row].as_py() or "", settings))
                size += len(rows[-1][4])
                if size >= OUT_BYTES or row == batch.num_rows - 1:
                    own = [batch.column(k).slice(first, len(rows)) for k in range(place)]
                    yield pa.RecordBatch.from_arrays(own + [pa.array(v, t) for v, t in zip(zip(*rows), types)], [*names, *OUTPUTS])
                    first, rows, size = row + 1, [], 0

    # columns go by place, so that no name of the input can clash
    read = [*[F.col(f"`{name}`") for name in names], F.col(f"`{key}`").cast("string"), F.col(f"`{text}`")]
    return df.select(*[c.alias(f"c{k}") for k, c in enumerate(read)]).mapInArrow(run, schema)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output was made of, from the output and its form alone.

    No part holds a marker, and no marker overlaps another, so each marker occurs once.
    """
    out = F.col(output)
    part = lambda whole, marker, k: F.split_part(whole, F.lit(marker), F.lit(k))
    middle = part(out, MIDDLE, 2)
    ahead = part(out, MIDDLE, 1)
    psm = F.concat(part(part(ahead, SUFFIX, 1), PREFIX, 2), middle, part(ahead, SUFFIX, 2))
    spm = F.concat(part(ahead, PREFIX, 2), middle, part(part(ahead, PREFIX, 1), SUFFIX, 2))
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(out)
