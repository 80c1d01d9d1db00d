"""Personal data, ranked search and fill-in-the-middle against plain restatements of their rules."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from compare import connect, differences
from pyspark.sql import functions as F

from siltgate.llm import bloom_search, fill_middle, pii_crf, queries, terms
from siltgate.llm.text import Hasher

SF_DIR = "/root/testdata/sf0.001"
ODD = [None, "", " \n\t ", "a", "a b", "\n\na\n", "é", "x" * 5000, "one two " * 400, "日本 語", "<P> a", "a <M>", "…", "<S", "THE the The", "1 2 3"]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, each twice, one row without id, and columns with the names of results and helpers."""
    rows = [(k, text, 1, "x", 2.0, "i", 7) for k, text in enumerate(ODD)] * 2 + [(None, "no id the", 1, "x", 2.0, "i", 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, n int, spans string, score double, id string, hash int")


@pytest.mark.parametrize("name", ["op12_lexical_search", "op13_fill_middle"])
def test_query_agrees_with_sql(spark, name):
    assert differences(queries.QUERIES[name](spark, SF_DIR), connect(SF_DIR), queries.ORACLES[name]) == []


# fill-in-the-middle

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def filled(key, text):
    text = text or ""
    units = [m.group() for m in UNIT.finditer(text)]
    digest = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    low, high = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if h[3] % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_middle_of_odd_texts(odd):
    made = fill_middle.transform(odd, "doc_id").withColumn("back", fill_middle.restored())
    assert made.columns == ["doc_id", "text", "spans", "score", "id", "hash", *fill_middle.OUTPUTS, "back"]
    rows = made.collect()
    assert len(rows) == 2 * len(ODD) + 1
    for row in rows:
        assert tuple(row[x] for x in fill_middle.OUTPUTS) == filled(row["doc_id"], row["text"])
        assert row["back"] == (row["text"] or "")
    assert fill_middle.transform(odd.limit(0), "doc_id").count() == 0


def test_fill_middle_of_many_keys(spark):
    rng = random.Random(3)
    rows = [(k, "".join(rng.choice(["a", "bc", " ", "\n", "<", "P>", "S", "é", " ü"]) for _ in range(rng.randrange(40)))) for k in range(600)]
    made = fill_middle.transform(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id")
    found = made.withColumn("back", fill_middle.restored()).collect()
    assert {r["form"] for r in found} == {"plain", "psm", "spm"}
    for row in found:
        assert tuple(row[x] for x in fill_middle.OUTPUTS) == filled(row["doc_id"], row["text"]) and row["back"] == row["text"]


def test_token_ends_do_not_depend_on_windows():
    rng = random.Random(4)
    for _ in range(200):
        text = "".join(rng.choice("ab \n\té") for _ in range(rng.randrange(80)))
        expected = [m.end() for m in UNIT.finditer(text)]
        for window in (1, 3, 10, 1000):
            assert fill_middle.token_ends(text, window).tolist() == expected
    long = "word and " * 3_000_000
    assert len(fill_middle.token_ends(long)) == 6_000_001
    assert fill_middle.token_ends("x" * 1_000_000).tolist() == [1_000_000]


# personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(digits):
    total = 0
    for place, d in enumerate(reversed(digits)):
        d = int(d) * (1 + place % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_of(text):
    found = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            fine = {
                "email": True,
                "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else None,
                "card": 12 <= len(digits) <= 19 and plain_luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if fine:
                found.append((m.start(), order, m.end()))
    return sorted(found)


def test_base_spans_against_plain_patterns(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("text").collect()]
    rng = random.Random(5)
    pieces = ["a", "b.c", "@", "a@b.c", "1", "255", "256", "007", ".", " ", "-", "+", "(", "4111111111111111", "+1 (555) 010-9999", "é", "\n"]
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randrange(30))) for _ in range(3000)]
    assert sum(len(base_of(t)) for t in texts) > 1000
    for text in texts:
        assert pii_crf.base_spans(text or "") == base_of(text)


def all_paths(scores, transitions):
    n, k = scores.shape
    for path in itertools.product(range(k), repeat=n):
        yield path, sum(scores[t, y] for t, y in enumerate(path)) + sum(transitions[a, b] for a, b in zip(path, path[1:]))


def test_viterbi_and_expectations_against_all_paths():
    rng = np.random.default_rng(6)
    transitions, sizes = rng.normal(size=(3, 3)), [1, 4, 2, 5, 1]
    first = np.concatenate(([0], np.cumsum(sizes)))
    scores = rng.normal(size=(first[-1], 3))
    labels = pii_crf.viterbi(scores, first, transitions)
    found, pairs = pii_crf.expectations(scores, first, transitions)
    expected_pairs = np.zeros((3, 3))
    for a, b in zip(first, first[1:]):
        paths = list(all_paths(scores[a:b], transitions))
        assert tuple(labels[a:b]) == max(paths, key=lambda x: x[1])[0]
        total = sum(math.exp(v) for _, v in paths)
        single = np.zeros((b - a, 3))
        for path, value in paths:
            for t, y in enumerate(path):
                single[t, y] += math.exp(value) / total
            for y, z in zip(path, path[1:]):
                expected_pairs[y, z] += math.exp(value) / total
        assert np.allclose(found[a:b], single)
    assert np.allclose(pairs, expected_pairs)


def test_training_climbs_the_likelihood():
    # the gradient is zero where the weights' pull equals their decay: labels are learned
    lines = pii_crf.labelled_lines()
    weights, transitions = pii_crf.train(lines)
    data, offsets = terms.text_bytes(pa.array([t for t, _ in lines], pa.large_string()))
    words = pii_crf._sequences(data, offsets, Hasher(), 14)
    labels = pii_crf.viterbi(weights[words.features].sum(axis=1), words.first, transitions)
    for row, (text, spans) in enumerate(lines):
        inside = np.zeros(len(words.starts), dtype=bool)
        for start, end, _ in spans:
            low, high = (int(offsets[row]) + len(text[:x].encode()) for x in (start, end))
            inside |= (words.starts < high) & (words.ends > low)
        assert ((labels > 0) == inside)[words.row == row].all(), text


UNSEEN = [
    ("my phone 212 555 0187 thanks", "phone", "212 555 0187"),
    ("é call (030) 555-123456 now", "phone", "(030) 555-123456"),
    ("mail peter_x [at] foo.com, or", "email", "peter_x [at] foo.com"),
    ("by ada.l (at) post (dot) example (dot) net", "email", "ada.l (at) post (dot) example (dot) net"),
    ("see 10[.]0[.]0[.]1 there", "ip", "10[.]0[.]0[.]1"),
    ("paid 4111.1111.1111.1111 here", "card", "4111.1111.1111.1111"),
    ("THE!! +1!! (310)!! 555-0142!! OF!!", "phone", "+1!! (310)!! 555-0142"),
]
CLEAN = ["in 2019 and 2020 we", "the number 9807915762804490 of", "version 3.1.4 of 12-05", "Licensed under CC BY-NC 4.0.", "call f(x) or [see] page 12", "about 12 000 people", "4111.1111.1111.1112 is no card"]


def test_labelled_spans_are_added_and_clean_texts_left_alone(spark):
    rows = [(k, text) for k, text in enumerate([t for t, _, _ in UNSEEN] + CLEAN)]
    found = {r["doc_id"]: r for r in pii_crf.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, (text, kind, content) in enumerate(UNSEEN):
        assert [(s["kind"], text[s["start"] : s["end"]]) for s in found[k]["spans"]] == [(kind, content)] and not found[k]["base"]
    assert all(not found[k]["spans"] for k in range(len(UNSEEN), len(rows)))


def test_personal_data_of_odd_texts(spark, odd):
    more = spark.createDataFrame([(99, "mail a@b.cd and +1 (555) 010-9999 at 1.2.3.4, 4111 1111 1111 1111"), (99, None)], "doc_id long, text string")
    found = pii_crf.find(odd.unionByName(more, allowMissingColumns=True))
    rows = found.collect()
    assert len(rows) == 2 * len(ODD) + 3 and found.columns[-2:] == ["base", "spans"] and found.columns.count("spans") == 1
    for row in rows:
        assert [(s["start"], pii_crf.KINDS.index(s["kind"]), s["end"]) for s in row["base"]] == base_of(row["text"])
        assert all(s in row["spans"] for s in row["base"])
    hidden = [r["text"] for r in pii_crf.masked(found).where("doc_id = 99").collect()]
    assert set(hidden) == {"mail [email] and [phone] at [ip], [card]", None}
    assert pii_crf.find(odd.limit(0)).count() == 0


def test_windows_do_not_change_labels(monkeypatch):
    rng = random.Random(7)
    words = ["the", "of", "+1", "(743)", "555-0124", "[at]", "é", "x.y", "4111.1111.1111.1111", "and", "in", "on", "by", "2020"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(300))) for _ in range(20)] + [""]
    data, offsets = terms.text_bytes(pa.array(texts, pa.large_string()))
    model, whole = pii_crf.train(pii_crf.labelled_lines()), None
    for window in (1 << 18, 4096, 256, 64):
        monkeypatch.setattr(pii_crf, "WINDOW", window)
        found = list(pii_crf._labelled(data, offsets, model, Hasher(), 14))
        whole = whole or found
        assert found == whole and len(found) > 10


def test_query_of_personal_data(spark):
    documents = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    for row in queries.QUERIES["op11_pii"](spark, SF_DIR).collect():
        base = base_of(documents[row["doc_id"]])
        listed = [f"{pii_crf.KINDS[k]}:{a}:{b}" for a, k, b in base]
        assert row["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert [row[f"n_{kind}"] for kind in pii_crf.KINDS] == [sum(k == i for _, k, _ in base) for i in range(4)]
        assert set(listed) <= set(filter(None, row["spans"].split(",")))


# ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def term_list(text):
    return TERM.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def ranked(documents, items, k):
    """(item, rank, doc, score) of (id, text) rows, by the rule as written."""
    bags = [(key, Counter(term_list(text))) for key, text in documents]
    bags = [(key, bag) for key, bag in bags if bag]
    big_n, big_l = len(bags), sum(sum(bag.values()) for _, bag in bags)
    df = Counter(t for _, bag in bags for t in bag)
    out = []
    for item, text in items:
        scores = []
        for key, bag in bags:
            m = 50 + (50 * sum(bag.values()) * big_n) // big_l
            score = 0
            for t in set(term_list(text)):
                if bag[t]:
                    w = math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1)))
                    score += w * ((1000000000 * bag[t]) // (1000 * bag[t] + 20 * m))
            if score > 0:
                scores.append((-score, key is None, key or 0, key))
        out += [(item, rank, key, -s) for rank, (s, _, _, key) in enumerate(sorted(scores)[:k], start=1)]
    return sorted(out, key=repr)


def test_terms_do_not_depend_on_windows():
    rng = random.Random(8)
    texts = ["".join(rng.choice("abAZ09 _-é日~") for _ in range(rng.randrange(60))) for _ in range(60)] + ["x" * 500, "", "é" * 300 + " y"]
    data, offsets = terms.text_bytes(pa.array(texts, pa.large_string()))
    hasher, whole = Hasher(), None
    for limit in (1 << 18, 64, 16, 7):
        parts = [list(x) for x in zip(*terms.terms(data, offsets, hasher, limit))]
        rows, hashes, starts, ends = (np.concatenate(x) for x in parts)
        words = [(int(r), data[a:b].tobytes().lower().decode()) for r, a, b in zip(rows, starts, ends)]
        assert words == [(r, t) for r, text in enumerate(texts) for t in term_list(text)]
        whole = hashes if whole is None else whole
        assert (hashes == whole).all()


def test_vocabulary_compares_bytes():
    vocabulary = terms.Vocabulary([b"one", b"two"])
    data = np.frombuffer(b"One tWo six", dtype=np.uint8)
    starts, ends = np.array([0, 4, 8]), np.array([3, 7, 11])
    first, second = vocabulary.hashes
    assert vocabulary.find(data, np.array([first, second, second]), starts, ends)[1].tolist() == [0, 1]  # `six` under the hash of `two`
    assert vocabulary.find(data, np.array([second, first, second]), starts, ends)[1].tolist() == [0, 1]


def random_texts(rng, n):
    words = ["alpha", "Beta", "gamma", "délta", "e1", "zeta", "eta", "theta"] + [f"w{k}" for k in range(60)]
    return [" ".join(rng.choice(words[: rng.choice([3, 8, 68])]) for _ in range(rng.randrange(1, 60))) for _ in range(n)]


@pytest.mark.parametrize("strip, block_keys, block_items", [(256, 1 << 20, 1024), (8, 50, 5)])
def test_search_against_brute_force(spark, monkeypatch, strip, block_keys, block_items):
    for name, value in (("STRIP", strip), ("BLOCK_KEYS", block_keys), ("BLOCK_ITEMS", block_items)):
        monkeypatch.setattr(bloom_search, name, value)
    rng = random.Random(9)
    documents = [(k, text) for k, text in enumerate(random_texts(rng, 300))]
    documents += [(300 + k, documents[5][1]) for k in range(40)]  # ties
    documents += [(7, documents[7][1]), (7, "another alpha text"), (None, "alpha beta w3"), (None, None), (400, ""), (401, "...")]
    items = [(k, text) for k, text in enumerate(random_texts(rng, 12))] + [(12, None), (13, ""), (14, "unknown words"), (0, "w1 w2")]
    docs = spark.createDataFrame([(*row, 1, "a") for row in documents], "doc_id long, text string, id int, items string").repartition(3)
    own = spark.createDataFrame([(*row, "b") for row in items], "item_id long, text string, doc_id string")
    found = [tuple(r) for r in bloom_search.search(docs, own, k=7).collect()]
    assert sorted(found, key=repr) == ranked(documents, items, 7)


def test_search_of_empty_tables(spark, odd):
    items = spark.createDataFrame([(1, "the one"), (None, "two")], "item_id long, text string")
    found = bloom_search.search(odd, items, k=3).collect()
    assert [tuple(r) for r in sorted(found, key=repr)] == ranked([(r["doc_id"], r["text"]) for r in odd.collect()], [(1, "the one"), (None, "two")], 3)
    for documents, own in ((odd.limit(0), items), (odd, items.limit(0)), (odd.where("text IS NULL"), items)):
        nothing = bloom_search.search(documents, own)
        assert nothing.count() == 0 and nothing.columns == ["item_id", "rank", "doc_id", "score"]


def test_bounds_are_never_below_scores(spark):
    rng = random.Random(10)
    documents = spark.createDataFrame(list(enumerate(random_texts(rng, 200))), "id long, text string").withColumn("hash", F.xxhash64("text"))
    found = [set(t.encode() for t in term_list(x)) for x in random_texts(rng, 8)]
    vocabulary = terms.Vocabulary(w for own in found for w in own)
    rows = bloom_search.scan(documents, vocabulary, True).collect()
    counts = Counter()
    for row in rows:
        if row["term"] is not None:
            counts[row["term"]] += row["found"]
    query, live = bloom_search._weighted(found, vocabulary, counts)
    none = np.ones(len(live), dtype=np.int64)
    every = documents.withColumn("items", F.array(*map(F.lit, range(len(live)))))
    exact = {(r["item"], r["id"]): r["score"] for r in bloom_search.exact_scores(every, vocabulary, query, none).collect()}
    seen = 0
    for row in rows:
        if row["term"] is None:
            for begin, bound in bloom_search._bounds(len(row["ids"]), np.array(row["n"]), np.array(row["top"]), row["width"], bytes(row["bits"]), query):
                for item, place in np.ndindex(bound.shape):
                    assert bound[item, place] >= exact.get((item, row["ids"][begin + place]), 0)
                    seen += 1
    assert seen == 200 * len(live)
