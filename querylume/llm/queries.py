"""The registered queries of the operators, each over its whole table."""

import public_tokenizers
from pyspark.sql import functions as F

from querylume.llm import (
    fill_middle, fm_index, kd_shards, maxscore, periodic, pieces, repeats, separators,
    simhash, suffix_dedup, token_files, toxicity, warc,
)

QUERIES = {}
ORACLES = {}


def query(sql=None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql.strip()
        return fn
    return add


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")


@query("""
SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes,
       sha256(body) AS payload_digest,
       CASE WHEN octet_length(encode(body)) >= 100 AND page_id > first
            THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN octet_length(encode(body)) >= 100 AND page_id > first
            THEN first END AS refers_to
FROM (SELECT page_id, coalesce(html, '') AS body,
             min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages) p
""")
def op1_warc(spark, sf_dir):
    packages = warc.write_packages(table(spark, sf_dir, "pages"))
    return warc.read_packages(packages, payload=False).drop("url")


@query()
def op2_token_files(spark, sf_dir):
    manifest = token_files.write_token_files(table(spark, sf_dir, "documents"), WORDS, end_id=2)
    return token_files.read_digests(manifest)


@query()
def op3_token_counts(spark, sf_dir):
    """Per document: doc_id and n_tokens, from flat files that hold no index."""
    end = 49407
    files = separators.write_flat_files(table(spark, sf_dir, "documents"), WORDS, end)
    names = files.select("path", F.posexplode("doc_ids").alias("ordinal", "doc_id"))
    found = separators.count_tokens(files, end)
    return found.join(names, ["path", "ordinal"]).select("doc_id", "n_tokens", "ended")


@query()
def op4_sentencepiece(spark, sf_dir):
    """Per document: its pieces counted, their crc32, and a digest of the text that the
    pieces decode to."""
    return pieces.round_trip(table(spark, sf_dir, "documents"), PIECES)


@query()
def op5_simhash(spark, sf_dir):
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


@query()
def op6_suffix_dedup(spark, sf_dir):
    return suffix_dedup.repeats(table(spark, sf_dir, "documents")).drop("kept")


@query()
def op7_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.is_held_out("doc_id").alias("held_out"), "score", "predicted")


@query()
def op8_kd_shards(spark, sf_dir):
    return kd_shards.kd_shards(table(spark, sf_dir, "documents"))


@query(r"""
WITH item_words AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), windows AS (
  SELECT DISTINCT item, n, array_to_string(ws[i:i + n - 1], ' ') AS phrase
  FROM (SELECT item, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS i
        FROM (SELECT *, least(len(ws), 10) AS n FROM item_words WHERE len(ws) > 0) x) y
), doc_words AS (
  SELECT doc_id, coalesce(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents
), places AS (
  SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS i
        FROM doc_words, (SELECT DISTINCT n FROM windows) l WHERE len(ws) >= n) x
), found AS (
  SELECT doc_id, item, i, n FROM places JOIN windows USING (n, phrase)
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM found) x GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item FROM found) x GROUP BY doc_id
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
""")
def op9_fm_index(spark, sf_dir):
    return fm_index.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("""
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS w
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) IS NOT FALSE
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_dot_product(q.w, c.w) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
      FROM scored) s
WHERE rank <= 5
""")
def op10_maxscore(spark, sf_dir):
    return maxscore.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("""
WITH h AS (
  SELECT doc_id, coalesce(text, '') AS text, len(coalesce(text, '')) AS n,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents
), k AS (
  SELECT doc_id, text, n, CAST('0x' || substr(d, 1, 8) AS BIGINT) % (n + 1) AS c1,
         CAST('0x' || substr(d, 9, 8) AS BIGINT) % (n + 1) AS c2,
         CAST('0x' || substr(d, 17, 8) AS BIGINT) % 100 AS h3,
         CAST('0x' || substr(d, 25, 8) AS BIGINT) % 100 AS h4 FROM h
), f AS (
  SELECT doc_id, text, n, least(c1, c2) AS a, greatest(c1, c2) AS b,
         CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>')
                OR contains(text, '<M>') OR h3 >= 90 THEN 'plain'
              WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k
), p AS (
  SELECT *, array_slice(text, 1, a) AS prefix, array_slice(text, a + 1, b) AS middle,
         array_slice(text, b + 1, n) AS suffix FROM f
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text
              WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
""")
def op11_fill_middle(spark, sf_dir):
    return fill_middle.digests(table(spark, sf_dir, "documents"))


@query()
def op12_periodic_runs(spark, sf_dir):
    """Over whole texts, every tenth of them made periodic as the test asks."""
    docs = periodic.with_planted_runs(table(spark, sf_dir, "documents"))
    return periodic.digests(periodic.periodic_runs(docs))


@query()
def op13_repeats(spark, sf_dir):
    kept = repeats.first_occurrences(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed",
                       F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))
