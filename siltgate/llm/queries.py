"""The registered queries of the training-data operators, over whole tables, and their SQL.

Each query derives its contract's columns from what its operator returns.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from siltgate.llm import bloom_search, bpe, binary_records, fill_middle, html_text, language_crf, minmax, pii_crf, quality_classifier, quality_rules, source_mix, token_attribution, vector_dedup
from siltgate.session import scratch_path

#: Where tokenizer files are; executors must reach the same path.
BYTE_BPE = os.environ.get("BYTE_BPE_FILE", public_tokenizers.path("byte_bpe_50k.json"))
WORD_BPE = os.environ.get("WORD_BPE_FILE", public_tokenizers.path("word_bpe_49k.json"))
END_ID = 1


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_classifier.fit(documents, _table(spark, sf_dir, "labels"))
    scored = quality_classifier.score(documents, model, keep=["doc_id"])
    return scored.select("doc_id", quality_classifier.held_out().alias("held_out"), "score", "predicted")


def op2_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_crf.fit(documents, quality_classifier.held_out())
    found = language_crf.predict(documents.select("doc_id", "text"), model, keep=["doc_id"])
    return found.select("doc_id", quality_classifier.held_out().alias("held_out"), "lang_pred", "score")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_documents(documents, BYTE_BPE, keep=["doc_id"], outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op6_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax.near_duplicates(_table(spark, sf_dir, "documents"), minmax.Settings(words=3, percent=85))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.ledger(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = quality_rules.passes(quality_rules.BASE)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~base).alias("base_failed"), quality_rules.passes(quality_rules.STANDARD).alias("kept"), "failed_bits")


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "token-records")
    binary_records.write_records(_table(spark, sf_dir, "documents"), folder, WORD_BPE, END_ID)
    return binary_records.sequence_starts(spark, folder)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document's source, language, first line and body."""
    documents = _table(spark, sf_dir, "documents")
    whole = F.coalesce("text", F.lit(""))
    title = F.substring_index(whole, "\n", 1)
    body = F.expr("substring(coalesce(text, ''), char_length(substring_index(coalesce(text, ''), '\\n', 1)) + 2)")
    text, sections = token_attribution.joined_fields({"source": F.col("source"), "lang": F.col("lang"), "title": title, "body": body})
    joined = documents.select("doc_id", text.alias("joined"), sections.alias("sections"))
    return token_attribution.attribute(joined, BYTE_BPE, "joined", "sections", rule="majority", keep=["doc_id"])


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_crf.find(_table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    counts = [pii_crf.spans_of("base", kind).alias(f"n_{kind}") for kind in pii_crf.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii_crf.listed("base"), 256).alias("base_sha256"), pii_crf.listed("spans").alias("spans"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloom_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=50)


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    made = fill_middle.transform(documents, "doc_id", keep=["doc_id"])
    digests = [F.sha2("output", 256).alias("output_sha256"), F.sha2(fill_middle.restored(), 256).alias("restored_sha256")]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


_WORD = r"[^\x20\x09-\x0D]+"

OP7_SQL = rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
words AS (SELECT doc_id, w, unnest(range(len(w) - 7)) AS i FROM docs WHERE len(w) >= 8),
windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i + 1 : i + 8]) AS times FROM words),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM windows, range(8) AS r(k) WHERE times > 1 GROUP BY doc_id),
split AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM docs),
lines AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT l) AS dup FROM split WHERE regexp_matches(l, '{_WORD}') GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w) AS n_words, list_sum(list_transform(w, lambda x: length(x)))::BIGINT AS chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(l.n, 0) AS n_lines, coalesce(l.dup, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
  FROM docs d LEFT JOIN covered c ON c.doc_id IS NOT DISTINCT FROM d.doc_id LEFT JOIN lines l ON l.doc_id IS NOT DISTINCT FROM d.doc_id),
b AS (
  SELECT *, coalesce(chars, 0) AS word_chars,
    (CASE WHEN n_words < 20 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * n_symbols > 40 * n_words THEN 4 ELSE 0 END) + (CASE WHEN 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END)
    + (CASE WHEN coalesce(chars, 0) < 2 * n_words THEN 16 ELSE 0 END) + (CASE WHEN coalesce(chars, 0) > 15 * n_words THEN 32 ELSE 0 END) AS bits
  FROM m)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
       bits & 3 <> 0 AS base_failed, bits = 0 AS kept, bits::BIGINT AS failed_bits
FROM b"""

OP6_SQL = rf"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
long AS (SELECT doc_id, w, unnest(range(len(w) - 2)) AS i FROM docs WHERE len(w) >= 3),
s AS (SELECT DISTINCT doc_id, w[i + 1 : i + 3] AS x FROM long UNION ALL SELECT doc_id, w FROM docs WHERE len(w) IN (1, 2)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS k FROM s p JOIN s q ON p.x = q.x AND p.doc_id < q.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id,
       d.doc_id = coalesce(c.component_id, d.doc_id) AS kept
FROM docs d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)"""

OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, e AS x, sqrt(list_sum(list_transform(e, lambda y: y * y))) AS norm
  FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)),
links AS (
  SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.vec_id <> q.vec_id
  WHERE list_dot_product(p.x, q.x) / (p.norm * q.norm) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM c LEFT JOIN n USING (vec_id)"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_SMALL = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP12_SQL = rf"""
WITH q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all({_SMALL.format("text")}, '{_TERM}')) AS term FROM benchmark),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_SMALL.format("text")}, '{_TERM}') AS w FROM documents),
g AS (SELECT count(*) AS big_n, sum(len(w))::BIGINT AS big_l FROM d WHERE len(w) > 0),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) SEMI JOIN q USING (term) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
w AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS weight FROM f, g),
m AS (SELECT r, doc_id, 50 + (50 * len(w) * big_n) // big_l AS m FROM d, g WHERE len(w) > 0),
s AS (SELECT item_id, r, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
      FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM o WHERE rank <= 50"""

_UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"

OP13_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_UNIT}') AS u,
                  sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
r AS (SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
             ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                  WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM r),
p AS (SELECT *, array_to_string(u[1:lo], '') AS pre, array_to_string(u[lo + 1:hi], '') AS mid, array_to_string(u[hi + 1:n], '') AS suf FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_classifier,
        op2_vector_dedup,
        op3_language_id,
        op4_html_extraction,
        op5_bpe,
        op6_minmax_dedup,
        op7_quality_rules,
        op8_source_mix,
        op9_binary_records,
        op10_token_counts,
        op11_pii,
        op12_lexical_search,
        op13_fill_middle,
    )
}
ORACLES = {"op2_vector_dedup": OP2_SQL, "op6_minmax_dedup": OP6_SQL, "op7_quality_rules": OP7_SQL, "op12_lexical_search": OP12_SQL, "op13_fill_middle": OP13_SQL}
