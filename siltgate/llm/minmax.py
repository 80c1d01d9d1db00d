"""Near-duplicate documents by min-max hashing of word shingles.

Under each random permutation the smallest and the largest shingle are both kept, so a
signature of 2 P values takes P hash evaluations. Bands hold only minima or only maxima: the
values of one band come from different permutations and are independent. The number of bands
follows from the threshold and the wanted miss rate. Pairs that share a band are confirmed by
intersecting the full shingle sets.

Documents with equal sets are one class from the start, so copies never meet in a bucket. In
each bucket a few representatives (the same ones in every bucket, by a hash of the id) are
compared with all members; that is exhaustive for small buckets. In larger ones only members
still in different components are compared afterwards, in pairs of blocks that report a
spanning forest of their links, so no pair of a bucket is left out or listed. Sets are fetched for documents in candidate pairs only.

Defined cases: a null, empty or blank text has no shingles and links with nothing; a text with
fewer words than the shingle is one shingle. Rows that share an id count as one document of the
graph. A row without id links with nothing and is kept. Extra columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from siltgate.llm.components import components
from siltgate.llm.text import BLANKS, LOWER, Hasher, column, forest, group_bounds, mix, runs, sequence_hashes, text_slices, whole_groups
from siltgate.session import scratch_table

_SEED = 20240229
_SHORT = np.uint64(0xA24BAED4963EE407)


@dataclass(frozen=True)
class Settings:
    """``percent``: least Jaccard similarity. ``rows`` per band; ``miss``: chance to miss a pair just at the threshold."""

    words: int = 5
    percent: int = 80
    rows: int = 6
    miss: float = 1e-6
    representatives: int = 8
    block: int = 256

    @property
    def bands(self) -> int:
        hit = (self.percent / 100) ** self.rows
        return 2 * math.ceil(math.log(self.miss) / math.log1p(-hit) / 2)

    @property
    def permutations(self) -> int:
        return self.bands * self.rows // 2


def _shingles(data: np.ndarray, offsets: np.ndarray, words: int, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, ascending, and where each row's begin."""
    n, data = len(offsets) - 1, LOWER[data]
    starts, ends, first = runs(~BLANKS[data], offsets)
    own = hasher.between(hasher.prefix(data), starts, ends)
    row = np.repeat(np.arange(n), np.diff(first))
    found = sequence_hashes(own, words)
    inside = row[: len(found)] == row[words - 1 :] if len(found) else np.zeros(0, dtype=bool)
    values, rows = mix(found[inside]), row[: len(found)][inside]
    short = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < words))
    if len(short):
        one = np.array([int(mix(sequence_hashes(own[first[r] : first[r + 1]], first[r + 1] - first[r]) + _SHORT)[0]) for r in short], dtype=np.uint64)
        values, rows = np.concatenate([values, one]), np.concatenate([rows, short])
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    fresh = np.ones(len(values), dtype=bool)
    fresh[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    values, rows = values[fresh], rows[fresh]
    return values, np.searchsorted(rows, np.arange(n + 1))


def _band_keys(values: np.ndarray, begin: np.ndarray, settings: Settings) -> np.ndarray:
    """One key per row and band, for rows that have shingles."""
    random = np.random.default_rng(_SEED)
    factors = random.integers(0, 1 << 63, settings.permutations, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = random.integers(0, 1 << 63, settings.permutations, dtype=np.uint64)
    half = settings.bands // 2
    keys = np.zeros((len(begin), settings.bands), dtype=np.uint64)
    for p in range(settings.permutations):
        hashed = values * factors[p] + shifts[p]
        band = p // settings.rows
        for place, ends in ((band, np.minimum.reduceat(hashed, begin)), (band + half, np.maximum.reduceat(hashed, begin))):
            keys[:, place] = mix(keys[:, place] + ends)
    return mix(keys + np.arange(settings.bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def signatures(df: DataFrame, settings: Settings, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, s1, s2, keys): s1 and s2 name the set of shingles, keys its bands."""

    def run(batches):
        hasher = Hasher()
        for batch in batches:
            ids = column(batch, "doc_id")
            for start, count, data, offsets in text_slices(column(batch, "text")):
                values, begin = _shingles(data, offsets, settings.words, hasher)
                sizes = np.diff(begin)
                full = np.flatnonzero(sizes > 0)
                sums = np.zeros((2, count), dtype=np.uint64)
                keys = np.zeros((0, settings.bands), dtype=np.int64)
                if len(full):
                    sums[0, full] = np.add.reduceat(mix(values + np.uint64(1)), begin[full])
                    sums[1, full] = np.add.reduceat(mix(values ^ _SHORT), begin[full])
                    keys = _band_keys(values, begin[full], settings)
                bounds = np.zeros(count + 1, dtype=np.int32)
                np.cumsum(np.where(sizes > 0, settings.bands, 0), out=bounds[1:])
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(start, count), pa.array(sizes.astype(np.int64)), *map(pa.array, mix(sums).view(np.int64)), pa.ListArray.from_arrays(pa.array(bounds), pa.array(keys.ravel()))],
                    ["doc_id", "n_shingles", "s1", "s2", "keys"],
                )

    narrow = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, n_shingles long, s1 long, s2 long, keys array<long>")


def shingle_sets(df: DataFrame, words: int) -> DataFrame:
    """(doc_id, shingles) of (doc_id, text)."""

    def run(batches):
        hasher = Hasher()
        for batch in batches:
            ids = column(batch, "doc_id")
            for start, count, data, offsets in text_slices(column(batch, "text")):
                values, begin = _shingles(data, offsets, words, hasher)
                lists = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids.slice(start, count), lists], ["doc_id", "shingles"])

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, shingles array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """Those pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    common = F.size(F.array_intersect("x", "y")).cast("long")
    sizes = F.size("x") + F.size("y")
    both = pairs.join(left, "a").join(right, "b").where(100 * common >= settings.percent * (sizes - common))
    return scratch_table(both.select("a", "b"), "minmax-links")


def _compare(settings: Settings):
    """Links of rows sorted by group, block i against block j: a forest, with exact intersections."""

    def group(ids, comps, blocks, i, j, sizes, flat):
        left, right = np.flatnonzero(blocks == i), np.flatnonzero(blocks == j)
        if not len(left) or not len(right):
            return []
        row = np.repeat(np.arange(len(ids)), sizes)
        values, place, times = np.unique(flat, return_inverse=True, return_counts=True)
        shared = times[place] > 1  # a shingle of one row is in no intersection
        renumbered = np.cumsum(times > 1) - 1
        row, place = row[shared], renumbered[place[shared]]
        order = np.argsort(place, kind="stable")
        row, place = row[order], place[order]
        common = np.zeros((len(left), len(right)), dtype=np.float32)
        for low in range(0, int(place[-1]) + 1 if len(place) else 0, 4096):
            cut = slice(*np.searchsorted(place, [low, low + 4096]))
            holds = np.zeros((len(ids), 4096), dtype=np.float32)
            holds[row[cut], place[cut] - low] = 1
            common += holds[left] @ holds[right].T
        linked = 100 * common >= settings.percent * (sizes[left][:, None] + sizes[right] - common)
        linked &= comps[left][:, None] != comps[right]
        a, b = np.nonzero(linked)
        return forest(ids[left[a]], ids[right[b]])

    def run(batches):
        names = ("key", "i", "j")
        for table in whole_groups(batches, names):
            own = {name: table[name].to_numpy() for name in ("node", "group", "block", "i", "j")}
            sizes = pc.list_value_length(table["shingles"]).to_numpy().astype(np.int64)
            flat = pc.list_flatten(table["shingles"]).to_numpy()
            begin = np.append(0, np.cumsum(sizes))
            edges = []
            for a, b in group_bounds(table, names):
                edges += group(own["node"][a:b], own["group"][a:b], own["block"][a:b], own["i"][a], own["j"][a], sizes[a:b], flat[begin[a] : begin[b]])
            edges = np.array(edges, dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["a", "b"])

    return run


def _left_over(crowded: DataFrame, groups: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """Links between members of large buckets that are still in different components.

    The largest component of a bucket is not compared with itself. Both it and the rest are cut
    into blocks, each pair of blocks is one group, and pairs are judged where they meet.
    """
    spread = crowded.join(groups, "node", "left").select("key", "node", F.coalesce("component", "node").alias("group"))
    tally = spread.groupBy("key", "group").agg(F.count("*").alias("n"))
    tally = tally.groupBy("key").agg(F.max_by("group", F.struct("n", "group")).alias("main"), F.max("n").alias("of_main"), F.sum("n").alias("of_all"), F.count("*").alias("groups"))
    tally = tally.where("groups > 1").select("key", "main", F.ceil(F.col("of_main") / settings.block).cast("int").alias("p"), F.ceil((F.col("of_all") - F.col("of_main")) / settings.block).cast("int").alias("q"))
    opened = spread.join(tally, "key")
    is_main, mark = F.col("group") == F.col("main"), F.xxhash64("node")
    block = F.when(is_main, F.pmod(mark, "p")).otherwise(F.col("p") + F.pmod(mark, "q")).cast("int")
    others = F.sequence(F.when(is_main, F.col("p")).otherwise(F.lit(0)), F.col("p") + F.col("q") - 1)
    pairs = F.transform(others, lambda k: F.struct(F.least(k, "block").alias("i"), F.greatest(k, "block").alias("j")))
    placed = opened.withColumn("block", block).withColumn("pair", F.explode(pairs)).select("key", "node", "group", "block", "pair.i", "pair.j")
    grouped = placed.join(sets, "node").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")
    return scratch_table(grouped.mapInArrow(_compare(settings), "a long, b long").distinct(), "minmax-links")


def near_duplicates(df: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each input row."""
    texts = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).where("doc_id IS NOT NULL")
    signed = scratch_table(signatures(df, settings, doc_id, text), "minmax-signatures")
    classes = signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("s1", "s2").agg(F.min("doc_id").alias("node"), F.min("n_shingles").alias("size"), F.min("keys").alias("keys"))
    classes = scratch_table(classes, "minmax-classes")
    members = scratch_table(classes.select("node", F.col("size").cast("int"), F.explode("keys").alias("key")), "minmax-bands")
    shared = members.groupBy("key").agg(F.count("*").alias("many")).where("many > 1")
    crowded = scratch_table(members.join(shared, "key"), "minmax-buckets")

    # the one pass that reads texts again; merged at every size, so that cost stays in proportion
    wanted = crowded.select(F.col("node").alias("doc_id")).distinct().hint("merge")
    sets = shingle_sets(texts.join(wanted, "doc_id", "left_semi"), settings.words).withColumnRenamed("doc_id", "node")
    sets = scratch_table(sets, "minmax-sets")

    few = settings.representatives
    ranked = crowded.selectExpr("*", "row_number() OVER (PARTITION BY key ORDER BY xxhash64(node), node) AS place")
    heads = ranked.where(f"place <= {few}").select("key", F.col("node").alias("head"), F.col("size").alias("head_size"))
    near = f"100 * least(size, head_size) >= {settings.percent} * greatest(size, head_size)"
    pair = (F.least("node", "head").alias("a"), F.greatest("node", "head").alias("b"))
    pairs = crowded.join(heads, "key").where("node <> head").where(near).select(*pair).distinct()
    pairs = scratch_table(pairs, "minmax-pairs")
    links = _confirmed(pairs, sets, settings)

    # ids on rows of different sets join those sets' classes
    named = signed.where("n_shingles > 0 AND doc_id IS NOT NULL").join(classes.select("s1", "s2", "node"), ["s1", "s2"])
    same_id = named.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count_distinct("node").alias("n")).where("n > 1")
    same_id = named.join(same_id.select("doc_id", "a"), "doc_id").where("node <> a").select("a", F.col("node").alias("b"))
    links = links.union(same_id)
    groups = scratch_table(components(links, "minmax-stars"), "minmax-groups")

    more = _left_over(crowded.where(f"many > {few + 1}"), groups, sets, settings)
    if not more.isEmpty():
        groups = components(links.union(more), "minmax-stars")

    joined = signed.select("doc_id", "n_shingles", "s1", "s2").join(classes.select("s1", "s2", "node"), ["s1", "s2"], "left").join(groups, "node", "left")
    linked = F.when(F.col("n_shingles") > 0, F.coalesce("component", "node"))
    found = joined.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce(linked, "doc_id")).alias("component_id"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def survivors(df: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of one document of each group, and all rows without an id.

    An id is one document: its rows with different texts all stay, of rows equal in id and text
    the one that is smallest in the other columns.
    """
    groups = near_duplicates(df.select(doc_id, text), settings, doc_id, text)
    kept = groups.where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias(doc_id)).distinct()
    whole = F.struct(text, *[name for name in df.columns if name not in (doc_id, text)])
    named = df.join(kept, doc_id).groupBy(doc_id, F.xxhash64(text).alias("text_hash")).agg(F.min(whole).alias("whole"))
    return named.select(doc_id, "whole.*").select(*df.columns).unionByName(df.where(F.col(doc_id).isNull()))
