"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosine checks.

Vectors are brought to length one. Each table hashes a vector to the floors of ``projections``
Gaussian projections over ``width``; near vectors share a bucket of some table. The number of
tables follows from the threshold and the wanted miss rate: at cosine c the distance is
sqrt(2 - 2 c), and p-stable theory gives the chance that one floor agrees.

Buckets with more than ``block`` vectors are cut into blocks, and every pair of blocks is a group
of its own, so no task holds a bucket whole; pairs are compared by matrix products and counted
where they are, never listed. A pair that meets in several tables counts in the first one. What
leaves a group is one number per vector and the edges of a spanning forest.

Equal vectors are one representative with a weight from the start. Distinct vectors within half
the link distance of a pivot all link with each other by the triangle inequality: such a ball is
counted as a whole, and its members meet only vectors outside it.

Defined cases: vectors that are null, empty, all zero, or have null or non-finite components link
with nothing, nor do vectors of different lengths with each other. Usable rows that share an id are
one node of the components, and a row's links count all other rows. A null id takes no part. Extra
columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from siltgate.llm.components import components
from siltgate.llm.text import column, forest, group_bounds, mix, whole_groups
from siltgate.session import scratch_table


@dataclass(frozen=True)
class Settings:
    """``miss``: chance to overlook a pair just at the threshold."""

    cosine: float = 0.95
    projections: int = 12
    width: float = 2.4
    miss: float = 1e-5
    block: int = 2048
    seed: int = 4242

    @property
    def distance(self) -> float:
        return math.sqrt(2 - 2 * self.cosine)

    @property
    def tables(self) -> int:
        t = self.width / self.distance
        tail = (1 - math.erf(t / math.sqrt(2))) / 2
        same = 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))
        return math.ceil(math.log(self.miss) / math.log1p(-(same**self.projections)))


def unit_vectors(lists) -> np.ndarray:
    """Vectors of one length, as unit vectors in double precision."""
    x = np.array(lists, dtype=np.float64)
    # scaling by the largest component first keeps squares finite and above zero
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def bucket_keys(unit: np.ndarray, settings: Settings) -> np.ndarray:
    """One 64-bit key per vector and table."""
    random = np.random.default_rng([settings.seed, unit.shape[1]])
    lines = random.standard_normal((unit.shape[1], settings.tables * settings.projections))
    shift = random.uniform(0, settings.width, lines.shape[1])
    cells = np.floor((unit @ lines + shift) / settings.width).astype(np.int64).reshape(len(unit), settings.tables, settings.projections)
    keys = np.zeros(cells.shape[:2], dtype=np.uint64) + (np.arange(settings.tables, dtype=np.uint64) + np.uint64(unit.shape[1] << 32))
    for p in range(settings.projections):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + cells[:, :, p].view(np.uint64))
    return keys.view(np.int64)


def _hashed(reps: DataFrame, settings: Settings) -> DataFrame:
    def run(batches):
        for batch in batches:
            lists = column(batch, "v").to_pylist()
            ids = np.array(column(batch, "node").to_pylist())
            for dim in sorted(set(map(len, lists))):
                place = [k for k, x in enumerate(lists) if len(x) == dim]
                keys = bucket_keys(unit_vectors([lists[k] for k in place]), settings)
                yield pa.RecordBatch.from_arrays([pa.array(ids[place]), pa.array(list(keys), pa.list_(pa.int64()))], ["node", "keys"])

    return reps.select("node", "v").mapInArrow(run, "node long, keys array<long>")


def _links(x, y, rows, others, same: bool, settings: Settings) -> tuple[np.ndarray, np.ndarray, list]:
    """Links per row of either block, and forest edges; rows and others are dicts of columns."""
    counts, other_counts = np.zeros(len(x), dtype=np.int64), np.zeros(len(y), dtype=np.int64)
    edges, table = [], int(rows["table"][0])
    for start in range(0, len(x), 512):
        near = x[start : start + 512] @ y.T >= settings.cosine
        if same:
            near = np.triu(near, start + 1)
        p, q = np.nonzero(near)
        for t0 in range(0, len(p), 1 << 20):
            u, v = p[t0 : t0 + (1 << 20)] + start, q[t0 : t0 + (1 << 20)]
            apart = (rows["ball"][u] < 0) | (rows["ball"][u] != others["ball"][v])
            u, v = u[apart], v[apart]
            if table:  # met in an earlier table
                fresh = (rows["marks"][u, :table] != others["marks"][v, :table]).all(axis=1)
                u, v = u[fresh], v[fresh]
            counts += np.bincount(u, others["weight"][v], len(x)).astype(np.int64)
            other_counts += np.bincount(v, rows["weight"][u], len(y)).astype(np.int64)
            edges += forest(rows["node"][u], others["node"][v])
    return counts, other_counts, edges


def _compare(settings: Settings):
    """Of rows sorted by group: what each group (block i of a bucket against block j, or itself) links."""
    names = ["node", "block", "i", "j", "table", "weight", "ball"]

    def groups(table: pa.Table) -> Iterator[pa.RecordBatch]:
        columns = {name: table[name].to_numpy() for name in names}
        columns["marks"] = pc.list_flatten(table["marks"]).to_numpy().reshape(len(table), -1)
        flat, sizes = pc.list_flatten(table["v"]).to_numpy(), pc.list_value_length(table["v"]).to_numpy()
        unit = {int(d): unit_vectors(flat[np.repeat(sizes == d, sizes)].reshape(-1, d)) for d in np.unique(sizes)}
        place = {d: np.cumsum(sizes == d) - 1 for d in unit}
        out = []
        for a, b in group_bounds(table, ("key", "i", "j")):
            dim = int(sizes[a])
            x = unit[dim][place[dim][a] : place[dim][a] + b - a]
            own = {name: value[a:b] for name, value in columns.items()}
            if own["i"][0] == own["j"][0]:
                if not (np.count_nonzero(x @ x.T >= settings.cosine) > len(x) if len(x) <= 512 else True):
                    continue
                first, second, edges = _links(x, x, own, own, True, settings)
                counts = first + second
            else:
                left, right = np.flatnonzero(own["block"] == own["i"]), np.flatnonzero(own["block"] == own["j"])
                if not len(left) or not len(right):
                    continue
                counts = np.zeros(b - a, dtype=np.int64)
                counts[left], counts[right], edges = _links(x[left], x[right], {k: v[left] for k, v in own.items()}, {k: v[right] for k, v in own.items()}, False, settings)
            found = np.flatnonzero(counts)
            edges = np.array(forest(*np.array(edges, dtype=np.int64).reshape(-1, 2).T), dtype=np.int64).reshape(-1, 2)
            none = np.full(len(found), -1)
            fill = np.zeros(len(edges), dtype=np.int64)
            out.append((np.concatenate([own["node"][found], fill - 1]), np.concatenate([counts[found], fill]), np.concatenate([none, edges[:, 0]]), np.concatenate([none, edges[:, 1]])))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["node", "links", "a", "b"])

    def run(batches):
        for table in whole_groups(batches, ("key", "i", "j")):
            yield from groups(table)

    return run


def _balls(buckets: DataFrame, reps: DataFrame, settings: Settings) -> DataFrame:
    """(node, ball): vectors close to the pivot of a crowded bucket; at most one ball each."""
    pivots = buckets.groupBy("key").agg(F.count("*").alias("many"), F.min("node").alias("pivot")).where("many > 8")
    near = buckets.join(pivots.select("key", "pivot"), "key").select("node", "pivot").distinct()
    # a margin keeps rounding from putting two members beyond the threshold
    radius = math.sqrt(2 - 2 * settings.cosine) / 2 - 1e-9

    def run(batches):
        for batch in batches:
            node, pivot, v, w = (column(batch, k) for k in ("node", "pivot", "v", "w"))
            pairs = [(n, p, x, y) for n, p, x, y in zip(node.to_pylist(), pivot.to_pylist(), v.to_pylist(), w.to_pylist()) if len(x) == len(y)]
            for dim in {len(x) for _, _, x, _ in pairs}:
                own = [z for z in pairs if len(z[2]) == dim]
                close = np.linalg.norm(unit_vectors([z[2] for z in own]) - unit_vectors([z[3] for z in own]), axis=1) <= radius
                yield pa.RecordBatch.from_arrays([pa.array([z[0] for z, c in zip(own, close) if c], pa.int64()), pa.array([z[1] for z, c in zip(own, close) if c], pa.int64())], ["node", "ball"])

    pairs = near.join(reps.select("node", "v"), "node").join(reps.select(F.col("node").alias("pivot"), F.col("v").alias("w")), "pivot")
    return pairs.mapInArrow(run, "node long, ball long").groupBy("node").agg(F.min("ball").alias("ball"))


def near_duplicates(df: DataFrame, settings: Settings = Settings(), vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each input row."""
    v = F.col("v")
    usable = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").alias("v"))
    # 0.0 and -0.0 are one number
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)) & F.col("vec_id").isNotNull())
    zero = F.lit(0).cast(rows.schema["v"].dataType.elementType)
    rows = rows.withColumn("v", F.when(F.col("usable"), F.transform("v", lambda x: F.when(x == 0, zero).otherwise(x))))
    rows = scratch_table(rows, "vectors-rows")
    reps = rows.where("usable").groupBy("v").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("weight"))
    # a number of its own for each distinct vector, fixed by writing it; its smallest id may be another vector's too
    reps = scratch_table(reps.withColumn("node", F.monotonically_increasing_id()), "vectors-distinct")
    hashed = scratch_table(_hashed(reps, settings), "vectors-keys")
    spread = hashed.select("node", F.posexplode("keys").alias("table", "key"))
    sizes = spread.groupBy("key").agg(F.count("*").alias("many")).where("many > 1")
    buckets = scratch_table(spread.join(sizes, "key"), "vectors-buckets")
    balls = scratch_table(_balls(buckets, reps, settings), "vectors-balls")

    balled = reps.select("node", "weight").join(balls, "node")
    ball_sizes = balled.groupBy("ball").agg(F.sum("weight").alias("ball_weight"))
    in_ball = balled.join(ball_sizes, "ball").select("node", (F.col("ball_weight") - F.col("weight")).alias("links"))

    # a bucket in which all vectors are in one ball has nothing left to compare
    own = buckets.join(balls, "node", "left").withColumn("ball", F.coalesce("ball", F.lit(-1)))
    settled = own.groupBy("key").agg(F.min("ball").alias("low"), F.max("ball").alias("high")).where("low < high OR low = -1").select("key")
    own = own.join(settled, "key")
    parts = F.ceil(F.col("many") / settings.block).cast("int")
    block = F.pmod(F.xxhash64("node"), parts).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least(k, "block").alias("i"), F.greatest(k, "block").alias("j")))
    placed = own.withColumn("parts", parts).withColumn("block", block).withColumn("pair", F.explode(pairs))
    placed = placed.join(hashed.select("node", F.transform("keys", lambda k: F.shiftright(k, 32).cast("int")).alias("marks")), "node").join(reps.drop("first_id"), "node")
    placed = placed.select("key", "table", F.col("pair.i").alias("i"), F.col("pair.j").alias("j"), "block", "node", "v", "weight", "ball", "marks")
    placed = placed.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")
    found = placed.mapInArrow(_compare(settings), "node long, links long, a long, b long")
    found = scratch_table(found, "vectors-found")

    links = found.where("links > 0").select("node", "links").union(in_ball).groupBy("node").agg(F.sum("links").alias("links"))
    edges = found.where("a <> b").select("a", "b").union(balls.select(F.col("node").alias("a"), F.col("ball").alias("b")))
    for end in ("a", "b"):
        edges = edges.join(reps.select(F.col("node").alias(end), F.col("first_id").alias(f"{end}_id")), end)
    edges = edges.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    named = rows.where("usable").join(reps, "v").select("vec_id", "node", "first_id", "weight")
    named = scratch_table(named, "vectors-named")
    repeated = named.groupBy("vec_id").agg(F.min("first_id").alias("a"), F.max("first_id").alias("b")).where("a <> b").select("vec_id", "a")
    same_id = named.join(repeated, "vec_id").where("first_id <> a").select("a", F.col("first_id").alias("b"))
    groups = components(edges.union(same_id), "vectors-stars").withColumnRenamed("node", "first_id")
    known = named.join(links, "node", "left").join(groups, "first_id", "left")
    known = known.select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "first_id").alias("component_id"))
    alone = rows.where("NOT usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return known.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
