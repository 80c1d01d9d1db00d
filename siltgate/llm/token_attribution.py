"""Token counts of fields and sections, from one encoding of each whole document.

A document is its fields joined by a separator; it is encoded once. Token lengths in bytes give
each token's character span, which is joined with the character spans of the sections, both in
order of place. A token that crosses a boundary goes by an explicit rule:

``start``     to the section that holds its first character;
``majority``  to the section that holds most of its characters, the earlier of equals;
``split``     to each section in proportion to its characters.

A character that two tokens share belongs to the first of them; a token that starts inside a
character and holds no whole one is placed at that character. What lies in no section (the
separators) counts for the row with a null section, so a document's counts add up to its tokens.

Defined cases: null fields are empty; they have a row with no tokens. Repeated rows and ids are
rows of their own. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from siltgate.llm.bpe import ROWS, Encoder, Vocabulary
from siltgate.llm.text import column

RULES = ("start", "majority", "split")


def character_spans(raw: np.ndarray, byte_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character and end of each token, from where tokens end in the text's bytes.

    Spans follow each other without overlap; a token that only goes on with a character is empty.
    """
    heads = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=heads[1:])
    ends = heads[byte_ends]
    starts = np.concatenate([ends[:0] if not len(ends) else [0], ends[:-1]]).astype(np.int64)
    return starts, ends


def allocate(starts: np.ndarray, ends: np.ndarray, lows: np.ndarray, highs: np.ndarray, rule: str) -> np.ndarray:
    """Tokens per section, and last those in none. Sections are ascending and do not overlap."""
    n = len(lows)
    out = np.zeros(n + 1)
    if not len(starts):
        return out
    # an empty token stands at the character it goes on with
    places = np.where(ends > starts, starts, np.maximum(starts - 1, 0))
    at = np.searchsorted(lows, places, "right") - 1
    inside = (at >= 0) & (places < highs[np.maximum(at, 0)]) if n else np.zeros(len(starts), dtype=bool)
    owner = np.where(inside, at, n)
    stop = np.where(ends > starts, ends, places + 1)
    crossing = np.where(inside, stop > (highs[np.maximum(at, 0)] if n else 0), np.searchsorted(lows, stop - 1, "right") - 1 > at)
    whole = ~crossing if rule != "start" else np.ones(len(starts), dtype=bool)
    out += np.bincount(owner[whole], minlength=n + 1)
    for t in np.flatnonzero(~whole):
        a, b = places[t], stop[t]
        k = np.arange(max(at[t], 0), np.searchsorted(lows, b, "left"))
        held = np.maximum(0, np.minimum(b, highs[k]) - np.maximum(a, lows[k]))
        rest = (b - a) - held.sum()
        if rule == "split":
            out[k] += held / (b - a)
            out[n] += rest / (b - a)
        else:
            best = int(k[held.argmax()]) if len(k) and held.max() >= rest else n
            out[best] += 1
    return out


def attribute(df: DataFrame, path: str, text: str, sections: str, rule: str = "majority", keep: list[str] | None = None) -> DataFrame:
    """A row per document and section: the kept columns, section, n_chars, tokens and n_tokens.

    ``sections`` is an array of (name, start, end), in characters of ``text``, ascending and
    disjoint. ``n_tokens`` counts the whole document.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    added = ("section", "n_chars", "tokens", "n_tokens")
    fields = [f for f in df.schema.fields if f.name not in added and (f.name in keep if keep is not None else f.name not in (text, sections))]
    names = [f.name for f in fields]
    counted = ArrayType(StructType([StructField("section", StringType()), StructField("n_chars", LongType()), StructField("tokens", DoubleType())]))
    schema = StructType(fields + [StructField("__found", counted), StructField("n_tokens", LongType())])
    carried = [*names, *(x for x in (text, sections) if x not in names)]
    kind = pa.list_(pa.struct([("section", pa.string()), ("n_chars", pa.int64()), ("tokens", pa.float64())]))

    def one(value: str, ids: np.ndarray, parts: list, lengths: np.ndarray) -> list[dict]:
        raw = np.frombuffer(value.encode(), dtype=np.uint8)
        starts, ends = character_spans(raw, np.cumsum(lengths[ids]))
        parts = [tuple(x.values()) for x in parts or []]
        lows, highs = np.array([x[1] for x in parts], dtype=np.int64), np.array([x[2] for x in parts], dtype=np.int64)
        held = np.flatnonzero(highs > lows)
        tokens = np.zeros(len(parts) + 1)
        found = allocate(starts, ends, lows[held], highs[held], rule)
        tokens[held], tokens[-1] = found[:-1], found[-1]
        rows = [{"section": x[0], "n_chars": x[2] - x[1], "tokens": float(t)} for x, t in zip(parts, tokens)]
        return [*rows, {"section": None, "n_chars": len(value) - int((highs - lows).sum()), "tokens": float(tokens[-1])}]

    def run(batches):
        vocabulary = Vocabulary(path)
        encoder, lengths = Encoder(vocabulary), vocabulary.lengths
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                values = [x or "" for x in column(batch, text).slice(start, ROWS).to_pylist()]
                parts, ids = column(batch, sections).slice(start, ROWS).to_pylist(), encoder.encode_many(values)
                found = [one(*x, lengths) for x in zip(values, ids, parts)]
                own = [column(batch, name).slice(start, ROWS) for name in names]
                yield pa.RecordBatch.from_arrays([*own, pa.array(found, kind), pa.array(list(map(len, ids)), pa.int64())], [*names, "__found", "n_tokens"])

    counts = df.select(*[F.col(f"`{x}`") for x in carried]).mapInArrow(run, schema)
    return counts.select(*[F.col(f"`{x}`") for x in names], F.explode("__found").alias("f"), "n_tokens").select(*[F.col(f"`{x}`") for x in names], "f.section", "f.n_chars", "f.tokens", "n_tokens")


def joined_fields(fields: dict[str, Column], separator: str = "\n") -> tuple[Column, Column]:
    """One text of several fields, and the sections it has: (text, sections)."""
    values = [F.coalesce(value, F.lit("")) for value in fields.values()]
    place, spans = F.lit(0).cast("long"), []
    for name, value in zip(fields, values):
        end = place + F.char_length(value)
        spans.append(F.struct(F.lit(name).alias("name"), place.alias("start"), end.alias("end")))
        place = end + len(separator)
    return F.concat_ws(separator, *values), F.array(*spans)
