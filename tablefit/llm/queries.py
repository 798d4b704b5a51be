"""One query for each operator, over its whole table."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablefit.functions.frames import shared_folder
from tablefit.llm import (byte_pairs, decontaminate, main_text, nearest, pieces, pseudo_likelihood, quality, simhash,
                          substrings, token_counts, url_filter, vector_codes, whitening)
from tablefit.llm.common import literal_rows, read

# The rules that URLs are judged by.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"),
         ("org", "/fr/", "allow")]


def lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood.score(read(spark, sf_dir, "documents"))


def piece_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pieces.encode_decode(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(read(spark, sf_dir, "pages"))


def leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_windows", "n_matched", "containment")


def repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
                        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    return quality.judge(docs, model).select("row.doc_id", "row.lang", "perplexity", "threshold", "keep")


def near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex().alias("fingerprint"), "component_id")


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = literal_rows(spark, ["host", "path", "verdict"], RULES)
    return url_filter.filter_urls(read(spark, sf_dir, "pages"), rules)


def token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A cache of its own: what earlier runs have counted would hide the work.
    cache = posixpath.join(shared_folder(spark), f"token-counts-{uuid.uuid4().hex}")
    return token_counts.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), cache)


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector_codes.compress(read(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def whitened(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(read(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))


def byte_pair_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = byte_pairs.encode_decode(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_scores": lm_scores, "op2_piece_ids": piece_ids, "op3_main_text": page_text, "op4_leaks": leaks,
    "op5_repeats": repeats, "op6_quality": judged, "op7_near_copies": near_copies, "op8_nearest": neighbours,
    "op9_urls": urls, "op10_token_counts": token_totals, "op11_vector_codes": codes, "op12_whitening": whitened,
    "op13_byte_pairs": byte_pair_ids,
}


def _codes_sql(parts: int, entries: int, rounds: int) -> str:
    """Assigning and floor means, written out round by round."""

    def assigned(books: str) -> str:
        return f"""SELECT r, part, x, min(struct_pack(d := list_sum(list_transform(range(1, len(x) + 1),
    lambda i: (x[i] - c[i]) * (x[i] - c[i]))), e := e)) AS best FROM cut JOIN {books} USING (part) GROUP BY r, part, x"""

    text = f"""WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL
   AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 numbered AS (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS r FROM kept),
 cut AS (SELECT r, part, v[part * (len(v) // {parts}) + 1:(part + 1) * (len(v) // {parts})] AS x
  FROM numbered, range({parts}) AS p(part)),
 books0 AS (SELECT part, r - 1 AS e, x AS c FROM cut WHERE r <= {entries})"""
    for i in range(rounds):
        text += f""",
 assigned{i} AS ({assigned(f"books{i}")}),
 spread{i} AS (SELECT part, best.e AS e, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS x FROM assigned{i}),
 sums{i} AS (SELECT part, e, i, sum(x) AS s, count(*) AS n FROM spread{i} GROUP BY part, e, i),
 means{i} AS (SELECT part, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM sums{i} GROUP BY part, e),
 books{i + 1} AS (SELECT b.part, b.e, coalesce(m.c, b.c) AS c FROM books{i} b LEFT JOIN means{i} m USING (part, e))"""
    return text + f""",
 final AS ({assigned(f"books{rounds}")}),
 coded AS (SELECT r, string_agg(format('{{:02x}}', best.e), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error
  FROM final GROUP BY r),
 entries AS (SELECT part, e, unnest(range(1, len(c) + 1)) AS i, unnest(c) AS x FROM books{rounds}),
 digest AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, e, i)) AS codebooks_sha256 FROM entries)
 SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
 FROM coded JOIN numbered USING (r), digest"""


SQL: dict[str, str] = {
    "op11_vector_codes": _codes_sql(vector_codes.PARTS, vector_codes.ENTRIES, vector_codes.ROUNDS),
    "op8_nearest": """WITH usable AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
   AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
   AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
 queries AS (SELECT vec_id AS query_id, min(v) AS q FROM usable WHERE vec_id % 100 = 0 GROUP BY vec_id, len(v)),
 scored AS (
  SELECT query_id, vec_id, sqrt(list_sum(list_transform(range(1, len(q) + 1),
    lambda i: (q[i] - v[i]) * (q[i] - v[i])))) AS score
  FROM queries JOIN usable ON vec_id <> query_id AND len(q) = len(v)),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM scored)
 SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10""",
    "op9_urls": """WITH parts AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz') AS host,
   coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
 ruled AS (SELECT *, CASE
   WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
   WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
   WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
   WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM parts)
 SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM ruled""",
}
