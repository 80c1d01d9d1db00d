"""Quality rules as a ledger: measure once, keep failures as bits, decide and ablate later.

``measure`` reads each whole text once and adds the measurements; ``ledger`` evaluates every
rule on them and stores one bit per failed rule. A ``Policy`` is a named, versioned bit mask:
applying one, comparing two or leaving a rule out never reads a text again.

Defined cases: a null text counts as empty (no words, so ``few_words`` fails). Repeated rows
and repeated ids are rows of their own. Input columns named like an added column are replaced
by it; all others pass through. An empty table gives an empty ledger.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from siltgate.llm.text import BLANKS, Hasher, column, mix, runs, sequence_hashes, space_table, text_slices

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
WINDOW = 8
_SYMBOLS = space_table(b"#*$%&|<>")

#: Rule name and when it fails. A rule's bit is its place, so new rules go to the end.
RULES = (
    ("few_words", "n_words < 20"),
    ("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    ("many_symbols", "100 * n_symbols > 40 * n_words"),
    ("repeated_lines", "2 * n_dup_lines > n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 15 * n_words"),
)


@dataclass(frozen=True)
class Policy:
    """A versioned set of rules; a row is kept when none of them failed."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        places = {rule: bit for bit, (rule, _) in enumerate(RULES)}
        return sum(1 << places[rule] for rule in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_words"))
STANDARD = Policy("standard", 1, tuple(rule for rule, _ in RULES))


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: is it found twice or more, and was it found before."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    same = np.zeros(len(keys) + 1, dtype=bool)
    same[1:-1] = ordered[1:] == ordered[:-1]
    several, again = np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=bool)
    several[order] = same[:-1] | same[1:]
    again[order] = same[:-1]
    return several, again


def _measure(data: np.ndarray, offsets: np.ndarray, hasher: Hasher) -> list[np.ndarray]:
    n, blank = len(offsets) - 1, BLANKS[data]
    starts, ends, first = runs(~blank, offsets)
    prefix = hasher.prefix(data)
    row = np.repeat(np.arange(n), np.diff(first))

    windows = sequence_hashes(hasher.between(prefix, starts, ends), WINDOW)
    inside = row[: len(windows)] == row[WINDOW - 1 :] if len(windows) else np.zeros(0, dtype=bool)
    places = np.flatnonzero(inside)
    several, _ = _repeats(mix(windows[places] + row[places].astype(np.uint64) * np.uint64(0x9E3779B1)))
    cover = np.zeros(len(starts) + 1, dtype=np.int64)
    np.add.at(cover, places[several], 1)
    np.add.at(cover, places[several] + WINDOW, -1)
    repeated = np.cumsum(cover[:-1]) > 0

    breaks = np.append(np.flatnonzero(data == 10), len(data))
    line_starts = np.union1d(offsets[:-1], breaks[:-1] + 1)
    line_starts = line_starts[line_starts < len(data)]
    line_row = np.searchsorted(offsets, line_starts, "right") - 1
    line_ends = np.minimum(breaks[np.searchsorted(breaks, line_starts)], offsets[line_row + 1])
    inner = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(~blank, out=inner[1:])
    full = inner[line_ends] > inner[line_starts]
    line_starts, line_ends, line_row = line_starts[full], line_ends[full], line_row[full]
    _, again = _repeats(mix(hasher.between(prefix, line_starts, line_ends) + line_row.astype(np.uint64) * np.uint64(0x9E3779B1)))

    return [
        np.diff(first),
        _per_row(~blank & ((data & 0xC0) != 0x80), offsets),
        _per_row(_SYMBOLS[data], offsets),
        np.bincount(line_row, minlength=n),
        np.bincount(line_row[again], minlength=n),
        _per_row(repeated, first),
    ]


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the measurements of each whole text; the text itself is not carried along."""
    kept = [f for f in df.schema.fields if f.name != text and f.name not in MEASURES]
    schema = StructType(kept + [StructField(name, LongType()) for name in MEASURES])
    names = [f.name for f in kept]

    def run(batches):
        hasher = Hasher()
        for batch in batches:
            for start, count, data, offsets in text_slices(column(batch, text)):
                own = [column(batch, name).slice(start, count) for name in names]
                found = [pa.array(v.astype(np.int64)) for v in _measure(data, offsets, hasher)]
                yield pa.RecordBatch.from_arrays(own + found, names + list(MEASURES))

    return df.select(*[F.col(f"`{x}`") for x in [*names, text]]).mapInArrow(run, schema)


def ledger(df: DataFrame, text: str = "text") -> DataFrame:
    """Measurements and ``failed_bits``: bit k is set when rule k failed."""
    bits = [F.when(F.expr(condition), F.lit(1 << k)).otherwise(F.lit(0)) for k, (_, condition) in enumerate(RULES)]
    total = bits[0]
    for bit in bits[1:]:
        total = total + bit
    return measure(df.drop("failed_bits"), text).withColumn("failed_bits", total.cast("long"))


def passes(policy: Policy):
    return F.col("failed_bits").bitwiseAND(F.lit(policy.mask)) == 0


def ablations(found: DataFrame, policy: Policy) -> DataFrame:
    """Per rule of the policy: rows that fail it, fail nothing else, and are kept without it.

    Rows are counted by bit pattern first, at most 2 ** rules of them, so the ledger is read
    once however many rules are compared.
    """
    patterns = found.groupBy(F.col("failed_bits").bitwiseAND(F.lit(policy.mask)).alias("bits")).count()
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(Policy("", 0, (r,)).mask).alias("bit")) for r in policy.rules])
    bit, bits = F.col("r.bit"), F.col("bits")
    return (
        patterns.select("bits", "count", F.explode(rules).alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(bits.bitwiseAND(bit) != 0, F.col("count")).otherwise(0)).alias("fails"),
            F.sum(F.when(bits == bit, F.col("count")).otherwise(0)).alias("fails_alone"),
            F.sum(F.when(bits.bitwiseAND(F.lit(policy.mask) - bit) == 0, F.col("count")).otherwise(0)).alias("kept_without"),
        )
    )
