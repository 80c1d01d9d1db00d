"""Operators across rows against brute force, and the pipeline."""

from __future__ import annotations

import bisect
import math
import random
import string
import sys
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from compare import connect, differences
from pyspark.sql import functions as F

import corpus_pipeline
from siltgate.llm import language_crf, minmax, quality_classifier, queries, source_mix, vector_dedup
from siltgate.llm.components import components
from test_texts import WORD

SMALL = "/root/testdata/sf0.001"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


class Groups:
    def __init__(self):
        self.parent = {}

    def root(self, x):
        while (up := self.parent.setdefault(x, x)) != x:
            x = up
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)


@pytest.mark.parametrize("name", queries.ORACLES)
def test_query_agrees_with_sql(spark, name):
    assert differences(queries.QUERIES[name](spark, SMALL), connect(SMALL), queries.ORACLES[name]) == []


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(2001, 2100)] + [(7777, 7777)]
    groups = Groups()
    for a, b in edges:
        groups.join(a, b)
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), "test").collect()}
    assert found == {x: groups.root(x) for e in edges for x in e if e[0] != e[1]}


# documents


def shingles(text, n):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()


def brute_documents(rows, n, percent):
    sets = [(i, shingles(text, n)) for i, text in rows if i is not None]
    groups, where = Groups(), defaultdict(set)
    for k, (_, s) in enumerate(sets):
        for x in s:
            where[x].add(k)
    for k, (i, s) in enumerate(sets):
        groups.root(i)
        for j in {j for x in s for j in where[x] if j > k}:
            both = len(s & sets[j][1])
            if 100 * both >= percent * (len(s) + len(sets[j][1]) - both):
                groups.join(i, sets[j][0])
    return groups


def edited(words, rng, share):
    return [rng.choice("klmnop") * 5 if rng.random() < share else w for w in words]


@pytest.mark.parametrize("n, percent", [(3, 85), (5, 80)])
def test_minmax_against_brute_force(spark, n, percent):
    rng = random.Random(n)
    rows = []
    for _ in range(12):  # groups of edited copies, some of them large
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([6, 40, 300]))]
        rows += [" ".join(edited(base, rng, rng.choice([0, 0.005, 0.02, 0.04]))) for _ in range(rng.choice([2, 5, 60]))]
    rows += ["same text here again"] * 40 + ["Same TEXT here\nagain"] * 3 + [None, "", " \t", "a", "a", "a b", "A  b", "É x", "é x"]
    rows = list(enumerate(rows)) + [(3, "an id used twice"), (900, "an id used twice"), (None, "same text here again")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, node string, size int")
    groups = brute_documents(rows, n, percent)
    found = minmax.near_duplicates(df, minmax.Settings(words=n, percent=percent)).collect()
    assert len(found) == len(rows)
    for r in found:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == groups.root(r["doc_id"]) and r["kept"] == (r["component_id"] == r["doc_id"])
    sizes = sorted((i is not None, i, len(shingles(t, n))) for i, t in rows)
    assert sizes == sorted((r["doc_id"] is not None, r["doc_id"], r["n_shingles"]) for r in found)


def test_minmax_compares_all_of_large_buckets(spark):
    """With one representative a bucket, the second pass must find the rest."""
    rng = random.Random(8)
    base = [f"w{k}" for k in range(400)]
    rows = list(enumerate(" ".join(edited(base, rng, 0.03)) for _ in range(80)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    settings = minmax.Settings(words=3, percent=85, representatives=1)
    groups = brute_documents(rows, 3, 85)
    assert {(r["doc_id"], r["component_id"]) for r in minmax.near_duplicates(df, settings).collect()} == {(i, groups.root(i)) for i, _ in rows}


def test_minmax_bands_follow_the_threshold():
    for percent in (60, 80, 85, 95):
        settings = minmax.Settings(percent=percent)
        assert (1 - (percent / 100) ** settings.rows) ** settings.bands <= settings.miss
        assert 2 * settings.permutations == settings.bands * settings.rows


def test_minmax_of_nothing(spark):
    assert minmax.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert minmax.near_duplicates(spark.createDataFrame([(1, None)], "doc_id long, text string")).collect()[0]["kept"]


# vectors


def brute_vectors(rows, cosine=0.95):
    groups, links = Groups(), [0] * len(rows)
    for k, (i, v) in enumerate(rows):
        groups.root(i)
        for j, w in rows[k + 1 :]:
            if usable(v) and usable(w) and len(v) == len(w):
                x, y = np.array(v, dtype=float), np.array(w, dtype=float)
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine:
                    groups.join(i, j)
        links[k] = sum(usable(v) and usable(w) and len(v) == len(w) and np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) >= cosine for m, (_, w) in enumerate(rows) if m != k)
    return groups, links


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)


def vectors(seed):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(8):
        centre = rng.normal(size=16)
        rows += [(centre + rng.normal(size=16) * rng.choice([0.02, 0.1, 0.2, 0.3])).astype("float32").tolist() for _ in range(20)]
    rows += [[0.5] * 16] * 30 + [[1.0] * 16, [0.0] * 16, [-0.0] * 16, [], None, [1.0, None], [float("nan")] * 16, [float("inf")] + [1.0] * 15, [1.0] * 15, [3.0] * 15]
    return list(enumerate(rows))


@pytest.mark.parametrize("block", [2048, 7])
def test_vectors_against_brute_force(spark, block):
    rows = vectors(1)
    groups, links = brute_vectors(rows)
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<float>, node int, ball string")
    found = vector_dedup.near_duplicates(df, vector_dedup.Settings(block=block)).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in found) == [(i, links[i], groups.root(i), groups.root(i) == i) for i, _ in rows]


def test_vectors_with_repeated_and_null_ids(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [1.0, 0.01]), (None, [1.0, 0.0])]
    found = vector_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r["vec_id"], r["component_id"]) for r in found if r["vec_id"] is not None) == [(1, 1), (1, 1), (2, 1), (3, 1)]
    assert [r["kept"] for r in found if r["vec_id"] is None] == [True]
    assert vector_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_links_of_ids_on_three_vectors(spark):
    """Vectors of one id are one component, and each counts its own links."""
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    rows = [(9, a), (9, b), (9, c), (1, a), (3, b), (5, c), (6, [0.0, 1.0, 0.01]), (-4, [1.0, -1.0, 1.0]), (-4, [1.0, 1.0, -1.0]), (-4, [1.0, 1.0, 1.0])]
    rows += [(20 + k, [1.0, -1.0, 1.0 + k / 1000]) for k in range(12)]
    groups, links = brute_vectors(rows)
    found = vector_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    want = sorted((i, links[k], groups.root(i), groups.root(i) == i) for k, (i, _) in enumerate(rows))
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in found) == want


# mixing


def wanted_targets(sizes, weights=(5, 2, 1), share=1.5, repeats=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > repeats * sizes[s]]
        if not full:
            return target | {s: left * weight[s] / total for s in open_}
        target |= {s: repeats * sizes[s] for s in full}
        left -= sum(repeats * sizes[s] for s in full)
        open_ -= set(full)
    return target


@pytest.mark.parametrize("block", [512, 5])
def test_mix_meets_its_targets(spark, block):
    rng = random.Random(block)
    rows = [(k, " ".join("w" * (1 + j % 3) for j in range(rng.choice([0, 1, 3, 40, 200]))), rng.choice(["a", "a", "a", "B", "é", "z", None])) for k in range(300)]
    rows += [(5, "twice the id", "a"), (5, "twice the id", "a"), (None, "no id at all", None), (400, None, "empty"), (401, " ", "empty"), (402, "x " * 5000, "long")]
    df = spark.createDataFrame([(*r, 9, 9) for r in rows], "doc_id long, text string, source string, size int, copy int")
    settings = source_mix.Settings(block=block, shard_slots=16)
    found = source_mix.mix(df, settings).collect()
    again = source_mix.mix(df.repartition(3), settings).collect()
    assert sorted(map(repr, (sorted(r["spans"]) for r in found))) == sorted(map(repr, (sorted(r["spans"]) for r in again)))
    key = lambda r: (r["doc_id"] is not None, r["doc_id"], r["size"])
    assert sorted(map(key, found)) == sorted((i is not None, i, len(WORD.findall(t or ""))) for i, t, _ in rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in found:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert r["taken"] == sum(s["to_word"] - s["from_word"] for s in r["spans"])
        for turn in (0, 1):  # within a pass no word is taken twice
            own = sorted((s["from_word"], s["to_word"]) for s in r["spans"] if s["pass"] == turn)
            assert all(b <= c for (_, b), (c, _) in zip(own, own[1:])) and all(0 <= a < b <= r["size"] for a, b in own)
    target = wanted_targets(sizes)
    for r in found:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in sizes)


def test_permutations_are_permutations(spark):
    for n in (1, 2, 7, 1000):
        found = [r[0] for r in spark.range(n).select(source_mix.permuted(F.col("id"), F.lit(n), F.lit(5), source_mix.Settings())).collect()]
        assert sorted(found) == list(range(n))
    assert sum(abs(a - b) == 1 for a, b in zip(found, found[1:])) < 50


def test_shards_are_full_and_mixed(spark):
    settings = source_mix.Settings(block=4, shard_slots=64)
    sources = source_mix.targets(source_mix.sizes(spark.read.parquet(f"{SMALL}/documents.parquet")), settings)
    slots = source_mix.slots(sources, settings).collect()
    assert len({(r["shard"], r["slot"]) for r in slots}) == len(slots)
    assert max(r["shard"] * 64 + r["slot"] for r in slots) == len(slots) - 1
    largest = max(sources.collect(), key=lambda r: r["quota"])
    share = largest["quota"] / sum(r["quota"] for r in sources.collect())
    for shard in range(3):
        own = [r for r in slots if r["shard"] == shard]
        # within five standard deviations of the multinomial mean
        assert abs(sum(r["rank"] == largest["rank"] for r in own) - 64 * share) <= 5 * math.sqrt(64 * share * (1 - share))


def test_shards_hold_drawn_counts(spark):
    """Tickets, counts and settled slots, worked out again without Spark."""
    settings = source_mix.Settings(block=4, shard_slots=64)
    sources = source_mix.targets(source_mix.sizes(spark.read.parquet(f"{SMALL}/documents.parquet")), settings)
    wanted = sorted((r["first"], r["slots"], r["rank"]) for r in sources.collect() if r["slots"])
    total = sum(n for _, n, _ in wanted)
    ends = [first + n for first, n, _ in wanted]
    counts = Counter()
    for at in range(total):
        mark = 42
        for value in (settings.seed, at // 64, at % 64):
            mark = xxhash.xxh64_intdigest(value.to_bytes(8, "little"), mark)
        ticket = (mark - (1 << 64) if mark >> 63 else mark) % total
        counts[wanted[bisect.bisect_right(ends, ticket)][2], at // 64] += 1
    assert {(r["rank"], r["shard"]): r["drawn"] for r in source_mix.draws(sources, settings).collect()} == counts
    slots = source_mix.slots(sources, settings).collect()
    shown, drawn = Counter(r["rank"] for r in slots), Counter()
    for (rank, _), n in counts.items():
        drawn[rank] += n
    assert shown == {rank: n for _, n, rank in wanted}  # every source has its slots, however the draws fell
    moved = sum((counts - Counter((r["rank"], r["shard"]) for r in slots)).values())
    assert moved == sum((drawn - shown).values())  # and only draws too many changed hands


def test_mix_query_deals_shards(spark, capsys):
    queries.QUERIES["op8_source_mix"](spark, SMALL).explain("extended")
    assert "mix-draws" in capsys.readouterr().out


def test_mix_takes_the_slots_that_were_dealt(spark):
    settings, documents = source_mix.Settings(block=4, shard_slots=64), spark.read.parquet(f"{SMALL}/documents.parquet")
    sources = source_mix.targets(source_mix.sizes(documents), settings)
    ranks = {r["source"]: r["rank"] for r in sources.collect()}
    dealt = {(r["rank"], r["pass"], r["shard"], r["slot"]) for r in source_mix.slots(sources, settings).collect()}
    taken = {(ranks[r["source"]], s["pass"], s["shard"], s["slot"]) for r in source_mix.mix(documents, settings).collect() for s in r["spans"]}
    assert taken == dealt


def test_mix_of_many_small_sources_and_equal_rows(spark):
    rows = [(k, f"w{k} x y", f"s{k}") for k in range(300)] + [(None, "no id here", "hot")] * 200 + [(None, f"none {k}", "hot") for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    settings = source_mix.Settings(block=2, shard_slots=8)
    found = source_mix.mix(df, settings).collect()
    assert len(found) == len(rows) and sum(r["size"] for r in found) == sum(len(r[1].split()) for r in rows)
    taken, target = defaultdict(int), {}
    for r in found:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in target)
    words = sum(len(r["text"].split()) for r in source_mix.taken_texts(df, settings).collect())
    assert words == sum(taken.values())


def test_mix_is_native(spark, capsys):
    source_mix.mix(spark.read.parquet(f"{SMALL}/documents.parquet")).explain("extended")
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_mix_of_nothing(spark):
    schema = "doc_id long, text string, source string"
    assert source_mix.mix(spark.createDataFrame([], schema)).count() == 0
    assert source_mix.mix(spark.createDataFrame([(1, None, None)], schema)).collect()[0]["taken"] == 0


# pipeline


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "/root/testdata/sf0.01").write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        kept.append(docs.count())
        if k < 4:
            assert docs.columns == before.columns
        if name == "quality":
            labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
            gone = labels.join(before, "doc_id").join(docs.select("doc_id"), "doc_id", "left_anti").where(quality_classifier.held_out())
            assert gone.where("quality = 1").count() <= 0.02 * labels.count() and gone.where("quality = 0").count() > 0
        if name == "language":
            assert docs.count() >= 0.97 * before.count()
        if name == "near_duplicates":
            rows = [(r["doc_id"], r["text"]) for r in before.collect()]
            groups = brute_documents(rows, 5, 80)
            assert {r["doc_id"] for r in docs.collect()} == {i for i, _ in rows if groups.root(i) == i}
        if name == "mixing":
            texts = {r["doc_id"]: WORD.findall(r["text"]) for r in before.collect()}
            assert all(set(WORD.findall(r["text"])) <= set(texts[r["doc_id"]]) and r["n_chars"] == len(r["text"]) for r in docs.collect())
            total = sum(map(len, texts.values()))
            assert sum(len(WORD.findall(r["text"])) for r in docs.collect()) == pytest.approx(1.5 * total, abs=20)
    assert kept[0] < 1000 and kept[2] < kept[1] and kept[4] == kept[3]


def test_language_stage_keeps_clean_text_in_three_languages(spark):
    rng = random.Random(4)
    letters = {"aa": "abcde", "bb": "fghij", "cc": "klmno"}
    say = lambda x, n: " ".join("".join(rng.choice(letters[x]) for _ in range(6)) for _ in range(n))
    rows = [(k, say(x, 40), x, "s", 0) for k, x in enumerate([*letters] * 20)]
    rows.append((1000, " ".join(say(x, 12) for x in letters), None, "s", 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = language_crf.predict(docs, language_crf.fit(docs, quality_classifier.held_out())).where("doc_id = 1000").first()
    assert found["score"] < 0.4 < 0.9 < found["certainty"]
    assert corpus_pipeline.language(spark, docs, SMALL).count() == len(rows)


def test_pipeline_of_odd_documents(spark, tmp_path):
    """Null, blank and repeated rows pass through every stage without a crash."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "word " * 30, "en", "a", 150), (3, "word " * 30, "en", "a", 150), (None, "no id " * 10, "en", None, 60), (4, "…", "fr", "b", 1)]
    for own in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        docs = own
        for name, stage in corpus_pipeline.STAGES:
            path = str(tmp_path / f"{name}-{own is docs}-{own.count()}")
            stage(spark, docs, SMALL).write.parquet(path)
            docs = spark.read.parquet(path)


def test_pipeline_keeps_rows_of_one_id_with_different_texts(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "one two three four five six", "en", "b", 1), (1, "uno dos tres cuatro cinco seis", "es", "b", 2), (1, "one two three four five six", "en", "a", 1), (2, "one two three four five six", "en", "b", 1)]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, schema), SMALL).collect()
    assert sorted(map(tuple, kept)) == [(1, "one two three four five six", "en", "a", 1), (1, "uno dos tres cuatro cinco seis", "es", "b", 2)]


CLASHING = ["__id", "__y", "id", "y", "__size", "__copy", "__pass", "__words", "size", "copy", "spans", "taken", "row", "words", "turn", "kept", "component_id", "component", "node", "text_hash", "whole", "score", "predicted", "lang_pred", "certainty", "n_tokens", "own_id"]


def test_pipeline_stages_take_extra_columns(spark):
    """Every name that a stage uses inside may also be a column of its input."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).withColumns({name: F.lit("x") for name in CLASHING})
    for name, stage in corpus_pipeline.STAGES:
        result = stage(spark, docs, "/root/testdata/sf0.001")
        assert result.count() > 0 and (name == "tokens" or result.columns == corpus_pipeline.COLUMNS)


def test_nothing_else_imports_the_subpackage():
    import subprocess

    code = "import sys, siltgate, siltgate.catalog; assert not [m for m in sys.modules if m.startswith('siltgate.llm')]"
    assert subprocess.run([sys.executable, "-c", code], cwd=corpus_pipeline.__file__.rpartition("/")[0]).returncode == 0
