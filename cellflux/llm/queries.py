"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import privacy
from .decontaminate import contamination
from .exact_dedup import exact_dedup
from .jaccard_join import jaccard_components
from .language import held_out, identify, train
from .packing import best_fit
from .privacy import personal_data, spans_text
from .quality import quality
from .token_counts import token_counts
from .urls import ADDRESS, DOUBLE_SUFFIX, Rule, document_of, url_verdicts
from .wrappers import extract

RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))
TOKEN_LIMIT = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(table(spark, sf_dir, "documents"), all_digests=True)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), train(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    # Not F.filter with a default k=k: a second parameter of the function gets the element's index.
    kinds = F.transform("base", lambda x: x["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(privacy.KINDS)]
    return found.select("doc_id", *counts, F.sha2(spans_text("base"), 256).alias("base_sha256"), spans_text("spans").alias("spans"))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's label is that of the document it carries, whose id ends the url's path; it is bad if
    it is toxic or of low quality, and no label if both are null."""
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)
    outcomes = table(spark, sf_dir, "labels").select("doc_id", bad.alias("bad"))
    found = url_verdicts(table(spark, sf_dir, "pages"), outcomes, RULES, outcome_id="doc_id", key=document_of(F.col("url")))
    return found.select("page_id", "host", "path", "rule", "verdict")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), size=4, num=85, den=100)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    found = contamination(docs, benchmark).select("doc_id", "contamination.*")
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["end"] - h["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counts = token_counts(table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op10_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counts = token_counts(table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")))
    return best_fit(counts, "doc_id", "n_tokens")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_exact_dedup, op2_language_id, op3_personal_data, op4_main_text, op5_url_filter, op6_quality,
        op7_jaccard_join, op8_decontamination, op9_token_counts, op10_best_fit, pipeline,
    )
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = f"""
WITH t AS (SELECT doc_id, sha256({_LOWER}) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM t
"""


def _level(name: str, above: str | None, parents: str) -> str:
    """One level of the reputation: members, the moment estimate of the strength, posteriors."""
    parent = "(SELECT rate FROM root)" if above is None else "p.mean"
    source = f"(SELECT {name}{', any_value(' + above + ') AS above' if above else ''}, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY {name})"
    joined = f"{source} h" + (f" JOIN {parents} p ON p.{above} = h.above" if above else "")
    return f"""
m_{name} AS (SELECT h.{name}, h.n, h.bad, {parent} AS parent FROM {joined}),
s_{name} AS (SELECT coalesce(1 / least(0.999, greatest(0.0001,
    (sum((bad - n * parent) ** 2) - sum(n * parent * (1 - parent))) / nullif(sum(n * (n - 1) * parent * (1 - parent)), 0))) - 1, 10) AS k FROM m_{name} WHERE n > 1),
p_{name} AS (SELECT {name}, n, (bad + k * parent) / (n + k) AS mean, n + k AS weight FROM m_{name}, s_{name})"""


_BARE = "regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]+$', '')"
_ADDRESS = f"(regexp_full_match({_BARE}, '[0-9]+([.][0-9]+){{3}}') OR starts_with({_BARE}, '['))"
_LAST_TWO, _LAST_THREE = (f"regexp_extract({_BARE}, '[^.]*([.][^.]*){{{{0,{n}}}}}$')".replace("{{", "{").replace("}}", "}") for n in (1, 2))
_DOUBLE = f"regexp_matches({_LAST_TWO}, '{DOUBLE_SUFFIX}')"
_DOMAIN = f"CASE WHEN {_ADDRESS} THEN {_BARE} WHEN {_DOUBLE} THEN {_LAST_THREE} ELSE {_LAST_TWO} END"
_SUFFIX = f"CASE WHEN {_ADDRESS} THEN '{ADDRESS}' WHEN {_DOUBLE} THEN {_LAST_TWO} ELSE regexp_extract({_BARE}, '[^.]*$') END"

OP5_SQL = f"""
WITH rows AS (
  SELECT *, {_DOMAIN} AS domain, {_SUFFIX} AS suffix, try_cast(regexp_extract(path, '/([0-9]{{1,18}})([.][A-Za-z]+)?/*$', 1) AS BIGINT) AS document
  FROM (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
          regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages)),
outcomes AS (SELECT doc_id, CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NOT NULL OR toxic IS NOT NULL THEN 0 END AS bad FROM labels),
hosts AS (
  SELECT host, domain, suffix, count(*)::DOUBLE AS n, sum(bad)::DOUBLE AS bad FROM rows JOIN outcomes ON document = doc_id WHERE bad IS NOT NULL GROUP BY host, domain, suffix),
root AS (SELECT (sum(bad) + 0.5) / (sum(n) + 1) AS rate, sum(n) AS n, sum(bad) AS bad FROM hosts),
{_level("suffix", None, "")},{_level("domain", "suffix", "p_suffix")},{_level("host", "domain", "p_domain")},
judged AS (
  SELECT r.host, r.path, r.page_id, coalesce(h.mean, d.mean, s.mean, (root.bad + root.rate) / (root.n + 1)) AS mean, coalesce(h.weight, d.weight, s.weight, root.n + 1) AS weight,
    CASE WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
         WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
         WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
         WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM rows r CROSS JOIN root LEFT JOIN p_host h USING (host)
  LEFT JOIN p_domain d ON d.domain = r.domain LEFT JOIN p_suffix s ON s.suffix = r.suffix)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN mean - 2 * sqrt(mean * (1 - mean) / (weight + 1)) > 0.5 THEN 'block' ELSE 'allow' END AS verdict
FROM judged
"""

OP7_SQL = f"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [hash(w)]
         ELSE list_transform(range(1, len(w) - 2), lambda i: hash(w[i:i + 3])) END) AS s FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id
  WHERE 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS node, a AS other FROM edges UNION SELECT r.node, e.b FROM reach r JOIN edges e ON e.a = r.other),
least AS (SELECT node, min(other) AS c FROM reach GROUP BY node)
SELECT doc_id, len(s)::BIGINT AS n_shingles, coalesce(c, doc_id) AS component_id FROM sets LEFT JOIN least ON node = doc_id
"""

_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
OP8_SQL = f"""
WITH words AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: w[i:i + 9])) AS g FROM items WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT doc_id, n, i, w[i:i + n - 1] AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, sizes)),
hits AS (SELECT doc_id, i, grams.n, item_id FROM grams JOIN windows ON grams.n = windows.n AND grams.g = windows.g),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN places USING (doc_id) LEFT JOIN found USING (doc_id)
"""

ORACLES = {"op1_exact_dedup": OP1_SQL, "op5_url_filter": OP5_SQL, "op7_jaccard_join": OP7_SQL, "op8_decontamination": OP8_SQL}
