"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import pii, toxicity
from quarry.llm.decontaminate import find_leaks
from quarry.llm.html_extract import extract_pages
from quarry.llm.licenses import scan_licenses
from quarry.llm.mixing import mix_sources
from quarry.llm.periodic_runs import find_runs, run_digests, with_periodic_tails
from quarry.llm.secrets import find_secrets, labelled_findings, train_forest
from quarry.llm.simhash import simhash_components
from quarry.llm.suffix_dedup import remove_repeats
from quarry.llm.url_filter import filter_urls, rule_table
from quarry.llm.winnowing import edit_likeness


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` mixed to source weights 5, 2, 1 at 150 % of their words."""
    return mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '/' || coalesce(text, '')), 1, 15))::BIGINT AS k
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk
  FROM sized GROUP BY source),
weighed AS (SELECT *, CASE rk % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM src),
steps AS (
  SELECT coalesce(sum(source_size) OVER (ORDER BY source_size / w::DOUBLE, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s,
         coalesce(sum(w) OVER (ORDER BY source_size / w::DOUBLE, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cw,
         sum(source_size) OVER () AS all_s, sum(w) OVER () AS all_w, source_size, w, rk
  FROM weighed),
level AS (
  SELECT arg_min((1.5::DOUBLE * all_s - 2.0::DOUBLE * s) / (all_w - cw), source_size / w::DOUBLE)
           FILTER (WHERE source_size * 2.0::DOUBLE > w * ((1.5::DOUBLE * all_s - 2.0::DOUBLE * s) / (all_w - cw))) AS lam
  FROM steps),
targets AS (
  SELECT source, source_size,
         CASE WHEN source_size * 2.0::DOUBLE <= w * lam THEN source_size * 2.0::DOUBLE ELSE w * lam END AS target
  FROM weighed, level),
ordered AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier,
         CASE WHEN t.source_size > 0 THEN floor(floor(t.target) / t.source_size) ELSE 0 END AS epochs
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, floor(target) - epochs * source_size - earlier)))::BIGINT AS taken
FROM ordered"""

def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every ``pages`` row."""
    return extract_pages(_table(spark, sf_dir, "pages"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ``documents`` text scored by a model of the labels that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``benchmark`` items that ``documents`` leak, as pairs."""
    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


#: Host, path and verdict of the url rules.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ``pages`` url judged by the rules above; without one, allowed."""
    return filter_urls(_table(spark, sf_dir, "pages"), rule_table(spark, URL_RULES))


OP4_SQL = r"""
WITH cut AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
         row_number() OVER () AS rn
  FROM pages),
rules(rhost, rpath, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
best AS (
  SELECT rn, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM cut JOIN rules ON ('.' || host) LIKE ('%.' || rhost) AND starts_with(path, rpath)
  GROUP BY rn)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM cut LEFT JOIN best USING (rn)"""


def op6_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components of ``documents``: 3-word shingles, links at 2 bits or fewer."""
    return simhash_components(_table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices of every ``documents`` text."""
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ``documents`` text without strings of 400 bytes that occur again."""
    found = remove_repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op9_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winnowed fingerprints of every document and its edited text."""
    return edit_likeness(_table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of secrets in ``documents``, judged by a forest of made findings."""
    return find_secrets(_table(spark, sf_dir, "documents"), train_forest(labelled_findings(spark)))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every ``documents`` text: base spans and those that boosted trees add."""
    docs = _table(spark, sf_dir, "documents")
    return pii.span_digests(pii.find_pii(docs, pii.train(docs)))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of words of every ``documents`` text, a tenth of which are given a periodic tail."""
    return run_digests(find_runs(with_periodic_tails(_table(spark, sf_dir, "documents"))))


QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_html_extract": op2_html_extract,
    "op3_toxicity": op3_toxicity,
    "op4_url_filter": op4_url_filter,
    "op5_decontamination": op5_decontamination,
    "op6_simhash_trie": op6_simhash_trie,
    "op7_license_scan": op7_license_scan,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_winnowing": op9_winnowing,
    "op10_secret_scan": op10_secret_scan,
    "op11_pii": op11_pii,
    "op12_periodic_runs": op12_periodic_runs,
}
SQL = {"op1_mix_sources": OP1_SQL, "op4_url_filter": OP4_SQL}
