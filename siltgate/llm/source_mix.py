"""Mix sources to target weights in fixed-length blocks, with DataFrame operations only.

The words of each source form one stream, cut into blocks of ``block`` words. A source's target
decides how many block slots it gets; a source is passed over at most ``repeats`` times and the
last slot is cut to the target, so each source takes its rounded target exactly and no document is
taken more than ``repeats`` times.

Output shards have ``shard_slots`` slots. Each slot of a shard draws a ticket by a seeded hash, and
tickets are dealt to sources in proportion to their slots: a shard's source counts are a
multinomial draw. Draws are then settled against the slots that sources have. The draws of a source,
over all shards, are mapped by a permutation of the source to the indexes of its slots. Indexes
beyond its last slot are draws too many; one more permutation gives these to the slots of sources
that were drawn too rarely. So every slot of every source stands in one place of one shard, and only
the settled draws, about the root of a source's slots, differ from the multinomial counts. Slot k
of a pass over a source takes block perm(k) of its full blocks. All permutations are swap-or-not
networks over [0, n), so indexes are computed, never sorted or drawn again on a rerun.

Sources weigh ``weights``, repeating, in code point order, null last. Targets are the weighted
shares of ``share`` of all words, cut at ``repeats`` times the source; what is cut is shared
again. The level at which that ends is found in closed form by one pass over sources in order of
size per weight.

Places in a stream are prefix sums in two steps (inside hashed chunks, and over the chunks), with
the square root of the number of rows as the number of chunks, so a hot source is spread. Draws are
placed in the same way, by groups of shards. Tickets meet sources by bins of equal width: a bin has
as many tickets as any other, whatever the sources' sizes. Blocks join slots on (source, block): at
most ``repeats`` slots and a few documents meet there. Tables of one row a source go through one
task.

Defined cases: null, empty and blank texts have size 0 and are never taken. Null sources are one
source. Repeated and null ids are rows of their own; rows equal in id, source and text are
interchangeable. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from siltgate.session import scratch_table

WORD = r"[^\x20\x09-\x0D]+"
_P = 2147483647
_CELL = 1024  # bins or shards that are handled together
_BIN = 64  # tickets of a bin


@dataclass(frozen=True)
class Settings:
    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.5
    repeats: int = 2
    block: int = 512
    shard_slots: int = 1024
    rounds: int = 24
    seed: int = 20240117


def permuted(x: Column, n: Column, salt: Column, settings: Settings) -> Column:
    """Where a pseudorandom permutation of [0, n) puts x. Each round swaps x with key - x, or not."""
    rounds = F.sequence(F.lit(1).cast("long"), F.lit(settings.rounds).cast("long"))

    def swap(at: Column, r: Column) -> Column:
        key = (r * 1103515245 + salt * 69069 + settings.seed) % _P
        other = F.pmod(key * 40503 % n - at, n)
        high = F.greatest(at, other)
        bit = ((high % _P * ((key * 48271) % _P) + F.floor(high / _P) * 16807 + key) % _P / 65536).cast("long") % 2
        return F.when(bit == 1, other).otherwise(at)

    return F.aggregate(rounds, x.cast("long"), swap)


def targets(sized: DataFrame, settings: Settings) -> DataFrame:
    """(source, rank, source_size, target, quota, slots, first): a row per source; quota is the rounded target, in ``slots`` slots."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, settings.weights)), ((F.col("rank") - 1) % len(settings.weights) + 1).cast("int"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sums.withColumn("rank", F.row_number().over(order).cast("long")).withColumn("weight", weight)
    # sources that reach their cap first come first; the first that does not sets the level of all after it
    cap = F.lit(settings.repeats) * F.col("source_size")
    filling = Window.orderBy(cap / F.col("weight"), "rank")
    ranked = ranked.withColumn("capped", F.sum(cap).over(filling) - cap).withColumn("open", F.sum("weight").over(filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    wanted = F.sum("source_size").over(Window.partitionBy()) * F.lit(settings.share)
    ranked = ranked.withColumn("level", (wanted - F.col("capped")) / F.col("open"))
    fits = F.when(F.col("level") * F.col("weight") <= cap, F.col("level"))
    level = F.first(fits, ignorenulls=True).over(filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.least(cap.cast("double"), F.coalesce(level * F.col("weight"), cap.cast("double")))
    ranked = ranked.withColumn("target", target).withColumn("quota", F.round("target").cast("long"))
    rest = F.col("quota") % F.col("source_size")
    whole = F.floor(F.col("quota") / F.col("source_size")) * F.ceil(F.col("source_size") / settings.block)
    count = F.when(F.col("quota") > 0, whole + F.ceil(rest / settings.block)).otherwise(0).cast("long")
    ranked = ranked.withColumn("slots", count).withColumn("first", F.sum("slots").over(Window.orderBy("rank")) - F.col("slots"))
    return ranked.select("source", "rank", "source_size", "target", "quota", "slots", "first")


def streamed(sized: DataFrame, sources: DataFrame, settings: Settings) -> DataFrame:
    """``sized`` with its source's columns and ``start``, its place in the source's stream."""
    rows = sized.count()
    chunks = max(1, math.isqrt(rows))
    chunk = F.pmod(F.xxhash64("doc_id", "mark", "copy", F.lit(settings.seed)), F.lit(chunks))
    sources = sources.select("source", "rank", "source_size", "target")
    placed = sized.withColumn("chunk", chunk).join(sources, sized["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    sums = placed.groupBy("rank", "chunk").agg(F.sum("size").alias("chunk_size"))
    sums = sums.withColumn("chunk_start", F.sum("chunk_size").over(Window.partitionBy("rank").orderBy("chunk")) - F.col("chunk_size"))
    inner = Window.partitionBy("rank", "chunk").orderBy("doc_id", "size", "mark", "copy").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.join(sums.drop("chunk_size"), ["rank", "chunk"])
    return placed.withColumn("start", F.col("chunk_start") + F.sum("size").over(inner) - F.col("size")).drop("chunk", "chunk_start")


def _parts(df: DataFrame) -> int:
    """A fixed number of partitions, for small rows with much work behind them."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _binned(lots: DataFrame, first: str, count: str) -> DataFrame:
    """``lots`` with each bin that its tickets [first, first + count) touch, spread over tasks before it grows."""
    low, high = F.floor(F.col(first) / _BIN), F.floor((F.col(first) + F.col(count) - 1) / _BIN)
    cells = lots.withColumn("cell", F.explode(F.sequence(F.floor(low / _CELL), F.floor(high / _CELL))))
    cells = cells.repartition(_parts(lots), "rank", "cell")
    bins = F.sequence(F.greatest(low, F.col("cell") * _CELL), F.least(high, (F.col("cell") + 1) * _CELL - 1))
    return cells.withColumn("bin", F.explode(bins)).drop("cell")


def draws(sources: DataFrame, settings: Settings) -> DataFrame:
    """(rank, shard, drawn): how often each shard's slots draw each source; pairs never drawn have no row."""
    wanted = sources.where("slots > 0").select("rank", "first", "slots")
    total = wanted.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    shards = -(-total // settings.shard_slots)
    size = F.least(F.lit(settings.shard_slots).cast("long"), F.lit(total) - F.col("id") * settings.shard_slots)
    deck = sources.sparkSession.range(0, shards, 1, _parts(sources))
    deck = deck.select(F.col("id").alias("shard"), F.explode(F.sequence(F.lit(0).cast("long"), size - 1)).alias("place"))
    ticket = F.pmod(F.xxhash64(F.lit(settings.seed).cast("long"), "shard", "place"), F.lit(max(total, 1)).cast("long"))
    deck = deck.select("shard", ticket.alias("ticket")).withColumn("bin", F.floor(F.col("ticket") / _BIN))
    met = deck.join(_binned(wanted, "first", "slots"), "bin")
    met = met.where((F.col("ticket") >= F.col("first")) & (F.col("ticket") < F.col("first") + F.col("slots")))
    return met.groupBy("rank", "shard").agg(F.count(F.lit(1)).alias("drawn"))


def slots(sources: DataFrame, settings: Settings) -> DataFrame:
    """(rank, pass, block, take, shard, slot): each block slot of the mix, where the settled draws put it."""
    drawn = scratch_table(draws(sources, settings), "mix-draws").withColumn("group", F.floor(F.col("shard") / _CELL))
    groups = drawn.groupBy("rank", "group").agg(F.sum("drawn").alias("n"))
    # draws beyond a source's slots, and slots beyond its draws, are numbered over all sources
    sums = groups.groupBy("rank").agg(F.sum("n").alias("draws"))
    settled = sources.where("slots > 0").select("rank", "source_size", "quota", "slots").join(sums, "rank", "left").na.fill(0, ["draws"])
    settled = settled.withColumn("over", F.greatest(F.col("draws") - F.col("slots"), F.lit(0))).withColumn("under", F.greatest(F.col("slots") - F.col("draws"), F.lit(0)))
    order = Window.orderBy("rank")
    settled = settled.withColumn("over_first", F.sum("over").over(order) - F.col("over")).withColumn("under_first", F.sum("under").over(order) - F.col("under"))
    settled = scratch_table(settled, "mix-settled")
    moves = settled.agg(F.coalesce(F.sum("over"), F.lit(0))).first()[0]

    groups = groups.withColumn("start", F.sum("n").over(Window.partitionBy("rank").orderBy("group")) - F.col("n")).drop("n")
    inner = Window.partitionBy("rank", "group").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = drawn.join(groups, ["rank", "group"]).withColumn("before", F.col("start") + F.sum("drawn").over(inner) - F.col("drawn"))
    within = Window.partitionBy("shard")
    ahead = F.sum("drawn").over(within.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("drawn")
    placed = placed.withColumn("ahead", ahead).withColumn("all", F.sum("drawn").over(within))
    placed = placed.repartition(_parts(sources), "rank", "shard").join(settled.select("rank", "draws"), "rank")
    each = placed.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("drawn") - 1)))
    index = permuted(F.col("before") + F.col("i"), F.col("draws"), F.col("rank") + 1000003, settings)
    slot = permuted(F.col("ahead") + F.col("i"), F.col("all"), F.col("shard") * 7 + 3, settings)
    # written, because Spark would work a permutation out again wherever its result is used
    each = scratch_table(each.select("rank", "shard", index.alias("index"), slot.alias("slot")), "mix-draws-placed").join(settled, "rank")
    own = ["rank", "source_size", "quota"]
    kept = each.where("index < slots").select(*own, "index", "shard", "slot")
    spare = F.col("over_first") + F.col("index") - F.col("slots")
    extra = each.where("index >= slots").select(permuted(spare, F.lit(max(moves, 1)).cast("long"), F.lit(0), settings).alias("ticket"), "shard", "slot")
    units = _binned(settled.where("under > 0").select(*own, "draws", "under", "under_first"), "under_first", "under")
    moved = extra.withColumn("bin", F.floor(F.col("ticket") / _BIN)).join(units, "bin")
    moved = moved.where((F.col("ticket") >= F.col("under_first")) & (F.col("ticket") < F.col("under_first") + F.col("under")))
    moved = moved.select(*own, (F.col("draws") + F.col("ticket") - F.col("under_first")).alias("index"), "shard", "slot")

    block = F.lit(settings.block)
    found = kept.unionByName(moved).withColumn("n", F.ceil(F.col("source_size") / block))
    found = found.withColumn("pass", F.floor(F.col("index") / F.col("n")).cast("int")).withColumn("k", F.col("index") % F.col("n"))
    amount = F.least("source_size", F.col("quota") - F.col("pass") * F.col("source_size"))
    full = F.floor(F.col("source_size") / block)
    # the tail of a stream, shorter than a block, is the last slot of a pass
    at = F.when(F.col("k") < full, permuted(F.col("k"), full, F.col("rank") * settings.repeats + F.col("pass") + 1, settings)).otherwise(full)
    take = F.least(block.cast("long"), amount - F.col("k") * block)
    return found.select("rank", "pass", at.alias("block"), take.alias("take"), "shard", "slot")


def sizes(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, size, mark, copy): ``mark`` is a hash of the text, ``copy`` numbers equal rows."""
    text_ = F.col(f"`{text}`")
    sized = df.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
        F.col(f"`{source}`").alias("source"),
        F.coalesce(F.regexp_count(text_, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(text_).alias("mark"),
    )
    copy = F.row_number().over(Window.partitionBy("doc_id", "source", "size", "mark").orderBy(F.lit(0)))
    return sized.withColumn("copy", copy)


def mix(df: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, mark, copy, source, size, source_size, target, taken, spans), a row for each input row.

    ``spans`` lists what the mix takes: (shard, slot, pass, from_word, to_word), words from 0.
    """
    sized = scratch_table(sizes(df, doc_id, text, source), "mix-sizes")
    sources = scratch_table(targets(sized, settings), "mix-sources")
    placed = scratch_table(streamed(sized, sources, settings), "mix-streams")
    block = settings.block
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    pieces = placed.where("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    # Spark takes the slots for as small as the cells they come from, and must not broadcast them
    joined = pieces.join(slots(sources, settings).hint("merge"), ["rank", "block"], "left")
    low = F.greatest("start", F.col("block") * block)
    high = F.least(F.col("start") + F.col("size"), F.col("block") * block + F.col("take"))
    span = F.struct("shard", "slot", "pass", (low - F.col("start")).alias("from_word"), (high - F.col("start")).alias("to_word"))
    keys = ["rank", "start", "doc_id", "mark", "copy", "source", "size", "source_size", "target"]
    found = joined.withColumn("words", F.when(F.col("take").isNotNull(), F.greatest(high - low, F.lit(0))).otherwise(F.lit(0))).withColumn("span", F.when(F.col("words") > 0, span))
    taken = found.groupBy(keys).agg(F.sum("words").alias("taken"), F.collect_list("span").alias("spans"))
    none = placed.where("size = 0").select(*keys, F.lit(0).cast("long").alias("taken"), F.array().cast(taken.schema["spans"].dataType).alias("spans"))
    return taken.unionByName(none).select("doc_id", "mark", "copy", "source", "size", "source_size", "target", "taken", "spans")


def taken_texts(df: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The words that the mix takes, a row for each document and pass over its source.

    Rows are those of :func:`mix`, with ``doc_id``, ``text`` and ``source``; other columns are
    carried along. Words come with the blanks before them, so that neighbouring spans join to the
    original text; a document taken whole keeps its text as it is.
    """
    names = df.columns
    mixed = mix(df.select("doc_id", "text", "source"), settings).where("taken > 0")
    whole = df.select(F.struct(*names).alias("row"))
    own = {"own_id": F.col("row.doc_id"), "own_source": F.col("row.source"), "own_mark": F.xxhash64("row.text")}
    numbered = whole.select("row", *[value.alias(f"row_{name}") for name, value in own.items()])
    equal = Window.partitionBy(*[f"row_{name}" for name in own]).orderBy(F.lit(0))
    numbered = numbered.withColumn("row_own_copy", F.row_number().over(equal))
    passes = F.explode(F.sequence(F.lit(0), F.lit(settings.repeats - 1))).alias("turn")
    spans = mixed.select(*[F.col(a).alias(f"own_{b}") for a, b in (("doc_id", "id"), ("source", "source"), ("mark", "mark"), ("copy", "copy"), ("size", "size"))], "spans", passes)
    own_spans = F.array_sort(F.filter("spans", lambda s: s["pass"] == F.col("turn")), lambda a, b: (a["from_word"] - b["from_word"]).cast("int"))
    spans = spans.withColumn("spans", own_spans).where(F.size("spans") > 0)
    same = [F.col(f"row_{name}").eqNullSafe(F.col(name)) for name in (*own, "own_copy")]
    joined = numbered.join(spans, same)
    words = F.regexp_extract_all("row.text", F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1))
    pieces = joined.withColumn("words", words)
    cut = F.transform("spans", lambda s: F.array_join(F.slice("words", (s["from_word"] + 1).cast("int"), (s["to_word"] - s["from_word"]).cast("int")), ""))
    taken = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["to_word"] - s["from_word"])
    text = F.when(taken == F.col("own_size"), F.col("row.text")).otherwise(F.array_join(cut, ""))
    return pieces.select(*[text.alias("text") if name == "text" else F.col(f"row.`{name}`").alias(name) for name in names])
