"""The registered queries of this subpackage, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.llm import archives, bytebpe, hard_negatives, packing, preference, quality_model, quality_rules, repeats
from wardlight.llm import shingle_join, toxicity, url_rules, vectors, whitening
from wardlight.llm.tables import written
from wardlight.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold(key: str, parts: int):
    """The remainder that decides whether a document's label may be learnt from."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % parts, F.lit(-1))


@query
def op1_toxicity(spark, folder):
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = toxicity.learn(docs, labels.where(fold("doc_id", 3) != 1))
    return toxicity.score(docs, model, ["doc_id"]).select(
        "doc_id",
        (fold("doc_id", 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
        "threshold",
        "toxic",
    )


@query
def op2_repeats(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return repeats.remove_repeats(docs, keep=["doc_id"]).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256")
    )


@query
def op3_byte_bpe(spark, folder):
    ranks = bytebpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return bytebpe.round_trip(docs, ranks, public_tokenizers.PATTERN, ["doc_id"])


@query
def op4_preference(spark, folder):
    pairs = preference.pairs_by_opening(table(spark, folder, "conversations"))
    return preference.format_pairs(pairs)


ORACLES["op4_preference"] = """
WITH t AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn, role, text) AS turns,
    arg_min(coalesce(text, ''), (turn, role, text)) FILTER (role = 'user') AS opening
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), c AS (
  SELECT conv_id, turns, lag(turns) OVER (PARTITION BY opening ORDER BY conv_id) AS earlier, opening,
    list_max(list_filter(range(1, len(turns) + 1), lambda i: turns[i].role = 'assistant')) AS last
  FROM t
), p AS (
  SELECT conv_id, turns AS chosen, CASE WHEN opening IS NOT NULL AND earlier IS NOT NULL THEN earlier ELSE
    list_transform(range(1, len(turns) + 1), lambda i: CASE WHEN i = last
      THEN {'role': turns[i].role, 'text': array_to_string(list_reverse(string_split(turns[i].text, ' ')), ' ')} ELSE turns[i] END) END AS rejected
  FROM c
), k AS (
  SELECT *, coalesce(list_min(list_filter(range(1, greatest(len(chosen), len(rejected)) + 1),
      lambda i: chosen[i] IS DISTINCT FROM rejected[i])) - 1, greatest(len(chosen), len(rejected))) AS n_common FROM p
), r AS (
  SELECT conv_id, n_common,
    list_transform(chosen[1:n_common], lambda m: '<|im_start|>' || coalesce(m.role, '') || chr(10) || coalesce(m.text, '') || '<|im_end|>' || chr(10)) AS p,
    list_transform(chosen[n_common + 1:], lambda m: {'o': '<|im_start|>' || coalesce(m.role, '') || chr(10), 'b': coalesce(m.text, '') || '<|im_end|>', 'r': m.role}) AS c,
    list_transform(rejected[n_common + 1:], lambda m: {'o': '<|im_start|>' || coalesce(m.role, '') || chr(10), 'b': coalesce(m.text, '') || '<|im_end|>', 'r': m.role}) AS j
  FROM k
)
SELECT conv_id, CAST(n_common AS INTEGER) AS n_common, coalesce(array_to_string(p, ''), '') AS prompt,
  coalesce(array_to_string(list_transform(c, lambda m: m.o || m.b || chr(10)), ''), '') AS chosen_completion,
  coalesce(array_to_string(list_transform(c, lambda m: repeat('0', length(m.o)) || repeat(CASE WHEN m.r = 'assistant' THEN '1' ELSE '0' END, length(m.b)) || '0'), ''), '') AS chosen_mask,
  coalesce(array_to_string(list_transform(j, lambda m: m.o || m.b || chr(10)), ''), '') AS rejected_completion,
  coalesce(array_to_string(list_transform(j, lambda m: repeat('0', length(m.o)) || repeat(CASE WHEN m.r = 'assistant' THEN '1' ELSE '0' END, length(m.b)) || '0'), ''), '') AS rejected_mask
FROM r
"""


@query
def op5_quality(spark, folder):
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = quality_model.learn(docs, labels.where(fold("doc_id", 5) != 0))
    return quality_model.score(docs, model, ["doc_id"]).select(
        "doc_id",
        (fold("doc_id", 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


@query
def op6_vectors(spark, folder):
    return vectors.near_duplicates(table(spark, folder, "embeddings"))


@query
def op7_jaccard_join(spark, folder):
    return shingle_join.near_duplicates(table(spark, folder, "documents"))


ORACLES["op7_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), c AS (
  SELECT text, min(doc_id) AS class_id, count(*) AS mult, any_value(words) AS words FROM w GROUP BY text
), g AS (
  SELECT DISTINCT class_id, unnest(CASE WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS s
  FROM c WHERE len(words) > 0
), z AS (
  SELECT class_id, count(*) AS n FROM g GROUP BY class_id
), k AS (
  SELECT a.class_id AS a, b.class_id AS b, count(*) AS hits FROM g a JOIN g b ON a.s = b.s AND a.class_id <> b.class_id GROUP BY 1, 2
), l AS (
  SELECT k.a, k.b FROM k JOIN z x ON x.class_id = k.a JOIN z y ON y.class_id = k.b WHERE 5 * hits >= 4 * (x.n + y.n - hits)
), r AS (
  SELECT class_id AS a, class_id AS b FROM c UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b
), p AS (
  SELECT a AS class_id, min(b) AS component_id FROM r GROUP BY a
), d AS (
  SELECT l.a AS class_id, sum(c.mult) AS links FROM l JOIN c ON c.class_id = l.b GROUP BY l.a
)
SELECT w.doc_id, c.class_id, CAST(c.mult - 1 + coalesce(d.links, 0) AS BIGINT) AS n_links, p.component_id, w.doc_id = p.component_id AS kept
FROM w JOIN c USING (text) JOIN p USING (class_id) LEFT JOIN d USING (class_id)
"""


@query
def op8_quality_rules(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    stats = written(quality_rules.statistics(docs, keep=["doc_id", "lang", "source"]), "quality-counts")
    judged = quality_rules.judge(stats, quality_rules.fit(stats))
    return judged.select("doc_id", *COUNTS, "base_failed", "kept", "distance2")


#: Production setting of the packing query: the token that ends a document.
END_ID = 2


def word_tokenizer() -> str:
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        return file.read()


@query
def op9_packing(spark, folder):
    return packed_pieces(table(spark, folder, "documents"))


def token_pieces(docs: DataFrame) -> DataFrame:
    """The pieces of the packed documents, with their token ids."""
    return packing.pack_texts(docs, word_tokenizer(), END_ID)


def packed_pieces(docs: DataFrame) -> DataFrame:
    return token_pieces(docs).select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
        "sequence_tokens",
    )


@query
def op10_arc_to_warc(spark, folder):
    arcs = archives.pages_to_arc(table(spark, folder, "pages"))
    marked = archives.mark_revisits(archives.arc_to_records(arcs))
    path = scratch_path(spark, "warc")
    archives.write_warc(archives.warc_records(marked), path)
    found = archives.read_warc(spark, path, payload=False)
    responses = found.where("warc_type = 'response'").select(F.col("record_id").alias("target"), F.col("page_key").alias("kept"))
    # A response looks itself up, so that no single key holds all of them.
    aimed = found.withColumn("target", F.coalesce("refers_to_id", "record_id"))
    return aimed.join(responses, "target", "left").select(
        F.col("page_key").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.col("warc_type").alias("record_type"),
        F.when(F.col("warc_type") == "revisit", F.col("kept")).alias("refers_to"),
    )


ORACLES["op10_arc_to_warc"] = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), d AS (
  SELECT page_id, payload_bytes, max(page_id) OVER (PARTITION BY hex) AS kept,
    list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::INTEGER >> (15 - 5 * (i % 4))::INTEGER) & 31), 1)), 'string_agg', '') AS payload_digest
  FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = kept THEN NULL ELSE kept END AS refers_to
FROM d
"""


#: Host rules, and pattern rules for what no host rule decides: sign-in pages and pages of listings.
URL_RULES = [
    url_rules.Rule("block", "net/"),
    url_rules.Rule("allow", "example.net/en/"),
    url_rules.Rule("block", "example.com/de/"),
    url_rules.Rule("allow", "org/fr/"),
    url_rules.Rule("block", "/login^", "pattern"),
    url_rules.Rule("block", "?page=*&ref=", "pattern"),
]


@query
def op11_url_rules(spark, folder):
    return url_rules.judge(table(spark, folder, "pages"), URL_RULES, keep=["page_id"])


ORACLES["op11_url_rules"] = r"""
WITH u AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, url, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u
), p AS (
  SELECT page_id, url, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h
), r AS (
  SELECT *, CASE
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM p
), q AS (
  SELECT *, CASE WHEN rule IS NOT NULL THEN NULL
    WHEN regexp_matches(url, '(?s)[?]page=.*&ref=') THEN '?page=*&ref='
    WHEN regexp_matches(url, '/login([^A-Za-z0-9_.%-]|$)') THEN '/login^' END AS pattern FROM r
)
SELECT page_id, host, path, rule, pattern,
  CASE WHEN rule IN ('net/', 'example.com/de/') OR pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM q
"""


@query
def op12_whitening(spark, folder):
    return whitening.whiten(table(spark, folder, "embeddings"))


@query
def op13_hard_negatives(spark, folder):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, folder, "embeddings"), F.col("id") % 100 == 0, label=moved)


ORACLES["op13_hard_negatives"] = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label = v.label AS same, v.vec_id, CAST(list_inner_product(a.x, v.x) AS BIGINT) AS score
  FROM v a JOIN v ON a.vec_id % 100 = 0 AND v.vec_id <> a.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10
"""
