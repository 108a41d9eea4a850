"""Registered queries of the operators of this package, with their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelmill.llm import (
    byte_cnn,
    cross_polytope,
    golay_simhash,
    heap_bpe,
    lightest_repair,
    mil_quality,
    numpy_bpe,
    owned_secrets,
    periodic_runs,
    poisson_mix,
    syncmers,
    training_order,
    warc_chunks,
)
from labelmill.llm.common import remainder, table
from labelmill.session import scratch_dir

MIX_SEED = 20


def tokenizer(name: str) -> str:
    """The path of a public tokenizer file that is installed beside the libraries."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = mil_quality.fit(docs, labels.filter(remainder("doc_id", 3) != 1))
    scored = mil_quality.with_quality(docs.select("doc_id", "text"), model)
    held_out = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op2_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "training-order")
    training_order.write_shards(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"), path)
    return training_order.read_shards(spark, path)


def op3_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = golay_simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", golay_simhash.hex_digits().alias("fingerprint"), "component_id")


def op4_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.edited_likeness(table(spark, sf_dir, "documents"))


def op6_numpy_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = numpy_bpe.with_encoding(docs, tokenizer("word_bpe_49k.json"))
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op7_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "archives")
    warc_chunks.write_archives(warc_chunks.chunk_table(table(spark, sf_dir, "pages")), path)
    return warc_chunks.read_records(spark, path)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = heap_bpe.with_token_counts(docs, tokenizer("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op9_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = poisson_mix.mix(table(spark, sf_dir, "documents"), MIX_SEED)
    return mixed.select("doc_id", "source", "text", "copy_no", "shuffle_key")


def op10_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = byte_cnn.fit(docs.filter(remainder("doc_id", 4) != 2))
    found = byte_cnn.with_language(docs.select("doc_id", "text"), net)
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = periodic_runs.damaged(F.col("doc_id"), F.col("text"))
    found = periodic_runs.with_runs(docs.select("doc_id", text.alias("text")))
    runs, best = F.col("runs"), F.col("best")
    return found.withColumn("best", periodic_runs.strongest(runs)).select(
        "doc_id",
        F.size(runs).cast("long").alias("n_runs"),
        *[best[c].alias(c) for c in ("start", "length", "period")],
        F.floor(best["length"] * 1000 / best["period"]).alias("exponent_milli"),
        F.sha2(periodic_runs.listed(runs), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_owned_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = owned_secrets.find_secrets(table(spark, sf_dir, "documents"))
    secrets = F.col("secrets")
    return found.select(
        "doc_id",
        *[F.size(owned_secrets.only(secrets, (k,))).cast("long").alias(f"n_{k}") for k in owned_secrets.BASE],
        F.sha2(owned_secrets.listed(owned_secrets.only(secrets, owned_secrets.BASE)), 256).alias("base_sha256"),
        owned_secrets.listed(secrets).alias("spans"),
        owned_secrets.judged(secrets, "live").alias("n_live"),
        owned_secrets.judged(secrets, "copied").alias("n_copied"),
    )


def op13_lightest_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    found = lightest_repair.repair(lightest_repair.damaged(rows), known=rows)
    return found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


QUERIES = {
    "op1_quality": op1_quality,
    "op2_training_order": op2_training_order,
    "op3_golay_simhash": op3_golay_simhash,
    "op4_cross_polytope": op4_cross_polytope,
    "op5_syncmers": op5_syncmers,
    "op6_numpy_bpe": op6_numpy_bpe,
    "op7_warc_chunks": op7_warc_chunks,
    "op8_token_counts": op8_token_counts,
    "op9_poisson_mix": op9_poisson_mix,
    "op10_byte_cnn": op10_byte_cnn,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_owned_secrets": op12_owned_secrets,
    "op13_lightest_repair": op13_lightest_repair,
}

_PART = "translate(lpad(to_base(CAST('0x' || substr(h, {at}, 10) AS BIGINT), 32), 8, '0'), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')"

_SECRET_SPANS = """
  SELECT row, doc_id, owner, {no} AS kind_no, '{kind}' AS kind, s.e - length(s.w) AS start, s.e AS "end", s.v AS value
  FROM (
    SELECT row, doc_id, owner, unnest(list_transform(range(1, len(w) + 1), lambda i: {{
      'e': list_sum(list_transform(gaps[:i], lambda x: length(x))) + list_sum(list_transform(w[:i], lambda x: length(x))), 'w': w[i], 'v': v[i]}})) AS s
    FROM (
      SELECT row, doc_id, owner, regexp_extract_all(t, $p${pattern}$p$, 0) AS w, regexp_extract_all(t, $p${pattern}$p$, {group}) AS v,
        string_split_regex(t, $p${pattern}$p$) AS gaps
      FROM texts WHERE regexp_matches(t, $p${pattern}$p$)
    ) x
  ) y WHERE length(s.v) >= {least}"""
_SECRETS_FOUND = "\n  UNION ALL".join(
    _SECRET_SPANS.format(no=i, kind=k, pattern=p, group=g, least=n) for i, (k, (p, g, n, _)) in enumerate(owned_secrets.KINDS.items())
)
_SPAN_TEXT = "kind || ':' || start || ':' || \"end\""

ORACLES = {
    "op12_owned_secrets": f"""
WITH texts AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(source, '') AS owner, coalesce(text, '') AS t FROM documents
), found AS ({_SECRETS_FOUND}
), live AS (
  SELECT *, length(value) >= {owned_secrets.LIVE_LENGTH} AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')
    AND len(list_distinct(string_split(value, ''))) >= {owned_secrets.LIVE_CHARACTERS}
    AND NOT regexp_matches(lower(value), '{owned_secrets.PLACEHOLDER}') AS looks_live
  FROM found
), clear AS (
  SELECT * FROM live l WHERE kind <> 'owned' OR looks_live AND NOT EXISTS (
    SELECT 1 FROM live b WHERE b.row = l.row AND b.kind <> 'owned' AND b.start < l."end" AND l.start < b."end")
), owners AS (
  SELECT value, count(DISTINCT owner) AS owners FROM clear GROUP BY value
), judged AS (
  SELECT clear.*, owners, looks_live AND owners < {owned_secrets.WIDE} AS is_live FROM clear JOIN owners USING (value)
), by_row AS (
  SELECT row, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg({_SPAN_TEXT}, ',' ORDER BY start, kind_no) FILTER (kind <> 'owned') AS base,
    string_agg({_SPAN_TEXT}, ',' ORDER BY start, kind_no) AS spans,
    count(*) FILTER (is_live) AS n_live, count(*) FILTER (owners >= {owned_secrets.WIDE}) AS n_copied
  FROM judged WHERE kind <> 'owned' OR is_live GROUP BY row
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM texts LEFT JOIN by_row USING (row)""",
    "op7_warc_chunks": f"""
WITH hashed AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), marked AS (
  SELECT page_id, payload_bytes, {' || '.join(_PART.format(at=10 * i + 1) for i in range(4))} AS payload_digest FROM hashed
), firsts AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS original FROM marked
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> original THEN original END AS refers_to
FROM firsts""",
    "op9_poisson_mix": f"""
WITH counted AS (
  SELECT coalesce(source, '') AS s, CAST(coalesce(sum(length(text)), 0) AS DOUBLE) AS chars FROM documents GROUP BY 1
), totals AS (
  SELECT sum(chars) AS all_chars, sum(CASE WHEN chars > 0 THEN pow(chars, 0.5) ELSE 0 END) AS all_weight FROM counted
), rated AS (
  SELECT s, CASE WHEN chars > 0 THEN pow(chars, 0.5) / all_weight * all_chars / chars ELSE 0 END AS rate FROM counted, totals
), terms AS (
  SELECT s, k, exp(-rate + CASE WHEN k = 0 THEN 0 ELSE k * ln(rate) - lgamma(k + 1) END) AS p
  FROM rated, generate_series(0, 400) AS g(k) WHERE rate > 0 AND k <= ceil(rate + 12 * sqrt(rate) + 20)
), cumulated AS (
  SELECT s, list(c ORDER BY k) AS cs FROM (SELECT s, k, sum(p) OVER (PARTITION BY s ORDER BY k) AS c FROM terms) x GROUP BY s
), drawn AS (
  SELECT doc_id, source, text, coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))) AS key, cs
  FROM documents JOIN cumulated ON s = coalesce(source, '')
), copies AS (
  SELECT doc_id, source, text, key,
    len(list_filter(cs, lambda c: c <= CAST('0x' || substr(md5('{MIX_SEED}|' || key || '|1'), 1, 13) AS BIGINT) / 4503599627370496.0)) AS n
  FROM drawn
)
SELECT doc_id, source, text, CAST(copy_no AS INTEGER) AS copy_no, md5('{MIX_SEED}|order|' || key || '|' || copy_no) AS shuffle_key
FROM copies, unnest(range(1, n + 1)) AS u(copy_no)""",
}
