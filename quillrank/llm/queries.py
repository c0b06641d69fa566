"""The registered queries of this package, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.llm import (
    curve_search,
    filter_audit,
    length_buckets,
    license_templates,
    near_vectors,
    piece_codec,
    quality,
    secret_ledger,
    suffix_dedup,
    token_counts,
    token_groups,
    url_lists,
    whitening,
)
from quillrank.session import fresh_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
OVER_LIMIT = 512


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


@_query
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return quality.score(docs, labels).select("row.doc_id", "p_text", "p_host", "p_path", "p_good", "kept")


@_query
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_templates.license_report(license_templates.scan_licenses(_table(spark, sf_dir, "documents")))


@_query
def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    rows = piece_codec.encode(_table(spark, sf_dir, "documents"), model)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "parity", "round_trip")


def _hex(text: Column, start: int) -> Column:
    return F.conv(F.substring(F.md5(text), start, 4), 16, 10).cast("int")


def list_events(pages: DataFrame) -> DataFrame:
    """Dated list entries derived from the pages' own hosts and sections, by the digits of a hash of their names."""
    sites = pages.select(url_lists.host_of(F.col("url")).alias("host"), url_lists.path_of(F.col("url")).alias("path"))
    sites = sites.where("host <> ''")
    labels = F.split("host", r"\.")
    parent = F.array_join(F.slice(labels, 2, F.size(labels)), ".")
    hosts = sites.select("host").distinct().withColumn("n", _hex(F.col("host"), 1)).withColumn("m", _hex(F.col("host"), 5))
    domains = hosts.where("n % 5 < 3").select(
        F.when(F.col("n") % 2 == 0, "adult").otherwise("spam").alias("list"),
        F.lit("domain").alias("kind"),
        F.when((F.col("n") % 3 == 0) & (F.size(labels) > 3), parent).otherwise(F.col("host")).alias("pattern"),
        (F.col("n") % 200).alias("start"),
        F.when(F.col("m") % 3 != 0, 20 + F.col("m") % 100).alias("held"),
        F.when(F.col("m") % 4 == 0, F.lit(150)).alias("again"),
    )
    section = F.concat("host", F.lit("/"), F.regexp_extract("path", "^/+([^/]+)", 1))
    sections = sites.where(F.regexp_extract("path", "^/+([^/]+)", 1) != "").select(section.alias("pattern")).distinct()
    sections = sections.withColumn("n", _hex(F.col("pattern"), 1)).withColumn("m", _hex(F.col("pattern"), 5)).where("n % 4 = 0")
    prefixes = sections.select(
        F.lit("archive").alias("list"),
        F.lit("prefix").alias("kind"),
        "pattern",
        (F.col("n") % 250).alias("start"),
        F.when(F.col("m") % 2 == 0, F.lit(40)).alias("held"),
        F.lit(None).cast("int").alias("again"),
    )
    entries = domains.union(prefixes)
    event = lambda day, action: F.struct(day.alias("offset"), F.lit(action).alias("action"))
    dated = F.array(
        event(F.col("start"), "add"),
        event(F.col("start") + F.col("held"), "remove"),
        event(F.col("start") + F.col("again"), "add"),
    )
    out = entries.select("list", "kind", "pattern", F.explode(dated).alias("e")).where("e.offset is not null")
    return out.select("list", "kind", "pattern", F.date_add(F.lit("2024-01-01").cast("date"), F.col("e.offset")).alias("day"), "e.action")


def captures(pages: DataFrame) -> DataFrame:
    """Pages with a fetch day derived from their id, over one year."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(365)).cast("int"))
    return pages.select("page_id", "url", day.alias("day"))


@_query
def op4_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    judged = url_lists.evaluate(captures(pages), list_events(pages))
    return judged.withColumn("fetched_on", F.col("day").cast("string")).drop("day")


ORACLES["op4_url_lists"] = r"""
WITH capture AS (
  SELECT DISTINCT page_id, url, DATE '2024-01-01' + CAST((page_id * 37) % 365 AS INTEGER) AS day,
    regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1), '\.+$', '') AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
host AS (
  SELECT *, string_split(host, '.') AS labels, ('0x' || substr(md5(host), 1, 4))::INTEGER AS n,
    ('0x' || substr(md5(host), 5, 4))::INTEGER AS m
  FROM (SELECT DISTINCT host FROM capture WHERE host <> '')),
part AS (
  SELECT *, ('0x' || substr(md5(pattern), 1, 4))::INTEGER AS n, ('0x' || substr(md5(pattern), 5, 4))::INTEGER AS m
  FROM (SELECT DISTINCT host || '/' || regexp_extract(path, '^/+([^/]+)', 1) AS pattern FROM capture
        WHERE host <> '' AND regexp_extract(path, '^/+([^/]+)', 1) <> '')),
entry AS (
  SELECT CASE WHEN n % 2 = 0 THEN 'adult' ELSE 'spam' END AS list, 'domain' AS kind,
    CASE WHEN n % 3 = 0 AND len(labels) > 3 THEN array_to_string(labels[2:], '.') ELSE host END AS pattern,
    n % 200 AS start, CASE WHEN m % 3 <> 0 THEN 20 + m % 100 END AS held, CASE WHEN m % 4 = 0 THEN 150 END AS again
  FROM host WHERE n % 5 < 3
  UNION ALL
  SELECT 'archive', 'prefix', pattern, n % 250, CASE WHEN m % 2 = 0 THEN 40 END, NULL FROM part WHERE n % 4 = 0),
event AS (
  SELECT list, kind, pattern, start AS on_day, FALSE AS gone FROM entry
  UNION ALL SELECT list, kind, pattern, start + held, TRUE FROM entry WHERE held IS NOT NULL
  UNION ALL SELECT list, kind, pattern, start + again, FALSE FROM entry WHERE again IS NOT NULL),
folded AS (
  SELECT list, kind, pattern, DATE '2024-01-01' + CAST(on_day AS INTEGER) AS day, bool_or(gone) AS gone
  FROM event GROUP BY ALL),
span AS (
  SELECT list, kind, pattern, day AS since, lead(day) OVER (PARTITION BY list, kind, pattern ORDER BY day) AS until, gone
  FROM folded),
hit AS (
  SELECT c.page_id, c.url, c.day, s.list, s.pattern
  FROM capture c JOIN span s ON NOT s.gone AND s.since <= c.day AND (s.until IS NULL OR c.day < s.until)
   AND c.host <> '' AND CASE s.kind
     WHEN 'domain' THEN c.host = s.pattern OR ends_with(c.host, '.' || s.pattern)
     ELSE starts_with(regexp_replace(c.host || c.path || '/', '/+', '/', 'g'), s.pattern || '/') END),
found AS (
  SELECT page_id, url, day, count(*) AS n_entries, string_agg(DISTINCT list, ',' ORDER BY list) AS lists,
    first(pattern ORDER BY length(pattern) DESC, pattern) AS pattern
  FROM hit GROUP BY ALL)
SELECT c.page_id, c.url, c.host, coalesce(f.n_entries, 0) AS n_entries, coalesce(f.lists, '') AS lists,
  coalesce(f.pattern, '') AS pattern, f.n_entries IS NOT NULL AS blocked, CAST(c.day AS VARCHAR) AS fetched_on
FROM capture c LEFT JOIN found f USING (page_id, url, day)
"""


@_query
def op5_length_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return length_buckets.pack(docs.select("doc_id", length_buckets.word_count("text").alias("n_tokens")))


@_query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    counted = token_counts.token_counts(_table(spark, sf_dir, "documents"), path)
    return counted.withColumn("over_limit", F.col("n_tokens") > OVER_LIMIT)


@_query
def op7_curve_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return curve_search.nearest(vectors, vectors.where("vec_id % 100 = 0"), k=10)


@_query
def op8_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    ledger = secret_ledger.Ledger(spark, fresh_path(spark, "ledger"))
    secret_ledger.scan(ledger, docs)
    return secret_ledger.digest(secret_ledger.secret_report(ledger, docs))


def _span_sql(rule: secret_ledger.Rule) -> str:
    pattern = rule.sql.replace("'", "''")
    return f"""SELECT doc_id, '{rule.kind}' AS kind, {rule.place} AS place, {rule.least} AS least,
    regexp_extract_all(t, '{pattern}', 0) AS w, regexp_extract_all(t, '{pattern}', {rule.group}) AS g,
    string_split_regex(t, '{pattern}') AS s FROM d"""


ORACLES["op8_secret_ledger"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(map(_span_sql, secret_ledger.RULES))}),
x AS (
  SELECT doc_id, kind, place, least, generate_subscripts(w, 1) AS i, w, g, s FROM m WHERE len(w) > 0),
span AS (
  SELECT doc_id, kind, place, CAST(list_sum(list_transform(s[1:i], lambda y: length(y)))
    + coalesce(list_sum(list_transform(w[1:i-1], lambda y: length(y))), 0) AS BIGINT) AS start, length(w[i]) AS size
  FROM x WHERE length(g[i]) >= least),
told AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || start || ':' || (start + size), ',' ORDER BY start, place) FILTER (place < 3) AS base,
    string_agg(kind || ':' || start || ':' || (start + size), ',' ORDER BY start, place) AS spans
  FROM span GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN told USING (doc_id)
"""


@_query
def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_duplicates(_table(spark, sf_dir, "embeddings"))


@_query
def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_groups.similar_documents(_table(spark, sf_dir, "documents"))


@_query
def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    n_spans = F.size("spans").cast("long").alias("n_spans")
    return left.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", n_spans, F.sha2("kept", 256).alias("kept_sha256"))


@_query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned = whitening.whitened(_table(spark, sf_dir, "embeddings"))
    return turned.withColumnRenamed("id", "vec_id").withColumn("deviation", F.col("deviation").cast("long"))


@_query
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.interaction_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


ORACLES["op13_filter_audit"] = r"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
lab AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
d AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(words) < 50 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
  FROM t LEFT JOIN lab USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY ALL),
f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
p AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
    AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
s AS (
  SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step-1]), 0)::INTEGER AS before
  FROM p, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
x AS (
  SELECT part, filter_order, step, bit,
    coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0) AS kept,
    coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before = 0), 0) AS removed,
    coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before <> 0), 0) AS redundant,
    coalesce(sum(n) FILTER (mask = bit), 0) AS unique_fails,
    coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & before = 0), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (mask & bit <> 0 AND mask & before = 0), 0) AS toxic_lost
  FROM c, s GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM x
"""
