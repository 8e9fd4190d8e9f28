"""The registered queries of this subpackage, one for each operator, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, chat, codes, decontaminate, extract, fim, quality, repeats, secrets, simhash, topk, warc
from .common import parquet

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_simhash")
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(parquet(spark, sf_dir, "documents"), distance=3, width=3)


@query("op2_warc_round_trip", """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
f AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to
FROM f
""")
def op2_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.archive_round_trip(spark, parquet(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op3_extract")
def op3_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = parquet(spark, sf_dir, "pages")
    return extract.extract(pages, extract.train(pages))


@query("op4_quality")
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = parquet(spark, sf_dir, "documents")
    model = quality.train(docs, parquet(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", "site_quality.*", (F.col("site_quality.quality") >= 0.5).alias("keep"))


@query("op5_bpe")
def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_path("word_bpe_49k.json")
    return bpe.digests(bpe.encode(parquet(spark, sf_dir, "documents"), path, with_text=True))


@query("op6_repeats", r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
grams AS (SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
hit AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY g) AS m FROM grams) WHERE m < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM hit),
sets AS (SELECT doc_id, list(i) AS s, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN n IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(s, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN sets ON d.doc_id = sets.doc_id
""")
def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(parquet(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op7_decontaminate", r"""
WITH words AS (
  SELECT item_id AS id, 'i' AS kind, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM benchmark
  UNION ALL SELECT doc_id, 'd', list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') FROM documents
), grams AS (SELECT DISTINCT id, kind, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i+4], ' '))) AS g FROM words WHERE len(w) > 0),
items AS (SELECT *, count(*) OVER (PARTITION BY id) AS n_item FROM grams WHERE kind = 'i')
SELECT d.id AS doc_id, i.id AS item_id, CAST(count(*) AS BIGINT) AS n_shared, CAST(n_item AS BIGINT) AS n_item
FROM items i JOIN grams d ON d.kind = 'd' AND d.g = i.g GROUP BY d.id, i.id, n_item HAVING count(*) >= ceil(n_item * 0.8)
""")
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contained(parquet(spark, sf_dir, "documents"), parquet(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_shared", "n_item")


@query("op8_exact_topk", """
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS t FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (SELECT vec_id, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM good),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.w * c.w) AS BIGINT) AS score
  FROM parts q JOIN parts c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0 GROUP BY 1, 2
), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
""")
def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.usable(parquet(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10)


@query("op9_secrets")
def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = parquet(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.train(docs))


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op10_token_codes")
def op10_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.token_files(spark, parquet(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"))


@query("op11_fim", r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS k,
    sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
h AS (SELECT *, CAST('0x' || d[1:8] AS BIGINT) % (len(k) + 1) AS c1, CAST('0x' || d[9:16] AS BIGINT) % (len(k) + 1) AS c2,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || d[17:24] AS BIGINT) % 100 >= 50 THEN 'plain'
      WHEN CAST('0x' || d[25:32] AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM t),
p AS (SELECT doc_id, text, form, CAST(len(k) AS BIGINT) AS n, array_to_string(k[1:least(c1, c2)], '') AS prefix,
    array_to_string(k[least(c1, c2) + 1:greatest(c1, c2)], '') AS middle, array_to_string(k[greatest(c1, c2) + 1:], '') AS suffix FROM h)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
""")
def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(fim.restore(fim.transform(parquet(spark, sf_dir, "documents"), seed=42, rate=50, spm=80)))


@query("op12_alignment")
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(parquet(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"), public_path("piece_bpe_32k.model"))


SAID = "</s>[INST] ok [/INST]"


@query("op13_chat", r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), m AS (SELECT *, 8 + length(regexp_replace(replace(replace(role, '\', '\0'), chr(10), '\1'), '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g'))
    + length(regexp_replace(text, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g')) AS size FROM t),
o AS (SELECT *, sum(size) OVER w AS upto, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM m
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars
FROM o GROUP BY conv_id
""")
def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = parquet(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(F.lit(-7).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit(SAID).alias("text"))
    return chat.digests(chat.read_back(chat.examples(kept.unionByName(added))))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
