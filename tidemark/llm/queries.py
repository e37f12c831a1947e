"""The queries opN_<name> of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, jaccard, langid, licenses, linedup, pii, quality, urlfilter, wrapper
from .common import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE of every document, decoded again."""
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every page; labelled documents fit the text model."""
    return langid.identified(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents")).drop("posteriors")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with pseudonyms for its personal data."""
    return pii.pseudonymised(table(spark, sf_dir, "documents"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every license mention of every document."""
    return licenses.scanned(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and compression bands of every document; documents labelled good fit the bands."""
    docs = table(spark, sf_dir, "documents")
    return quality.judged(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    return urlfilter.verdicts(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "by")


def op7_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article of every page."""
    return wrapper.extracted(table(spark, sf_dir, "pages"))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document under links of its shingle set."""
    return jaccard.similar(table(spark, sf_dir, "documents"))


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the later copies of repeated line runs."""
    return linedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_deleted", "text")


def op10_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that each document contains."""
    found = decontam.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "item_words", "marked_words", "n_tiles", "coverage")


def url_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6's operator with redirects: each page is moved to the one before it, in chains of five pages, by way of another host."""
    pages = table(spark, sf_dir, "pages")
    way = F.concat(F.lit("https://moved.example/"), F.col("page_id").cast("string"))
    before = pages.select((F.col("page_id") + 1).alias("page_id"), F.col("url").alias("dst"))
    there = pages.where("page_id % 5 <> 0").select(F.col("url").alias("src"), way.alias("dst"))
    on = pages.where("page_id % 5 <> 0").join(before, "page_id").select(way.alias("src"), "dst")
    return urlfilter.verdicts(pages, redirects=there.unionByName(on)).select("page_id", "rule", "verdict", "by")


QUERIES = {f.__name__: f for f in (op1_bpe, op2_langid, op3_pii, op4_licenses, op5_quality, op6_urls, op7_wrapper, op8_jaccard, op9_lines, op10_tiling, url_redirects)}

_HOST = r"regexp_extract(u, '^([^/?#]*)', 1)"
#: Pages of these tables hold no redirects or canonical links, so that the method's verdict is allow; the
#: SQL still finds links, and fails its comparison where a page with one appears.
ORACLE_SQL = {
    "op6_urls": """
WITH p AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) END AS u,
         regexp_matches(coalesce(html, ''), '(?i)rel\\s*=\\s*["'']?[^"''>]*canonical|http-equiv\\s*=\\s*["'']?\\s*refresh|og:url') AS linked
  FROM pages),
s AS (
  SELECT page_id, linked, coalesce(translate(regexp_extract(u, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(u, '^[^/?#]*([^?#]*)', 1), '') AS path FROM p),
r(rhost, rpath, rverdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (
  SELECT s.*, r.*, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost) + length(rpath) DESC NULLS LAST) AS n
  FROM s LEFT JOIN r ON (s.host = rhost OR s.host LIKE '%.' || rhost) AND starts_with(s.path, rpath))
SELECT page_id, host, path, rhost || rpath AS rule, CASE WHEN rverdict IS NULL AND linked THEN 'unknown' ELSE coalesce(rverdict, 'allow') END AS verdict,
       CASE WHEN rverdict IS NULL THEN 'default' ELSE 'rule' END AS by
FROM m WHERE n = 1"""
}
# Pages are nodes by host, path and query; chains of five and equal nodes are closed over by labels.
ORACLE_SQL["url_redirects"] = (
    "WITH RECURSIVE " + ORACLE_SQL["op6_urls"].strip().removeprefix("WITH ").partition("SELECT page_id, host, path, rhost")[0].rstrip() + """,
v AS (SELECT m.page_id, rhost || rpath AS rule, rverdict, m.host || CASE WHEN tail = '' OR tail LIKE '?%' THEN '/' || tail ELSE tail END AS node FROM m JOIN (SELECT page_id AS id, regexp_extract(u, '^[^/?#]*([^#]*)', 1) AS tail FROM p) ON id = m.page_id WHERE n = 1),
e AS (SELECT DISTINCT a.page_id AS x, b.page_id AS y FROM v a JOIN v b ON a.page_id // 5 = b.page_id // 5 OR a.node = b.node),
c AS (SELECT page_id AS x, page_id AS y FROM v UNION SELECT c.x, e.y FROM c JOIN e ON c.y = e.x),
d AS (SELECT c.x AS page_id, CASE WHEN bool_or(rverdict = 'allow') THEN 'allow' WHEN bool_or(rverdict = 'block') THEN 'block' END AS alias FROM c JOIN v ON v.page_id = c.y GROUP BY c.x)
SELECT v.page_id, rule, coalesce(rverdict, alias, 'allow') AS verdict, CASE WHEN rverdict IS NOT NULL THEN 'rule' WHEN alias IS NOT NULL THEN 'alias' ELSE 'default' END AS by
FROM v JOIN d USING (page_id)"""
)
#: Shingles by a hash of 64 bits, as the operator's; all pairs that share one; a closure over the links.
ORACLE_SQL["op8_jaccard"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
x AS (SELECT doc_id, words, unnest(generate_series(1, greatest(len(words) - 4, 1))) AS i FROM w WHERE len(words) > 0),
s AS MATERIALIZED (SELECT DISTINCT doc_id, hash(array_to_string(words[i:i + 4], ' ')) AS shingle FROM x),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
l AS MATERIALIZED (SELECT a AS x, b AS y FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT documents.doc_id, coalesce(n, 0) AS n_shingles, coalesce(least_id, documents.doc_id) AS component_id FROM documents LEFT JOIN n ON n.doc_id = documents.doc_id
LEFT JOIN (SELECT x, min(y) AS least_id FROM r GROUP BY x) ON x = documents.doc_id"""
#: Runs of equal lines on a diagonal of two documents (or of one): each is a maximal repeated run, of which the later lines go.
ORACLE_SQL["op9_lines"] = r"""
WITH l AS MATERIALIZED (
  SELECT doc_id, i - 1 AS pos, lines[i] AS line, len(regexp_extract_all(lines[i], '[^\x20\x09-\x0D]+')) AS w
  FROM (SELECT doc_id, lines, unnest(generate_series(1, len(lines))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL))),
m AS MATERIALIZED (SELECT l.* FROM l JOIN (SELECT line FROM l GROUP BY line HAVING count(*) > 1) USING (line)),
p AS (SELECT a.doc_id, a.pos, a.w, b.doc_id AS other, a.pos - b.pos AS diagonal FROM m a JOIN m b ON a.line = b.line AND (b.doc_id < a.doc_id OR (b.doc_id = a.doc_id AND b.pos < a.pos))),
q AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, other, diagonal ORDER BY pos) AS run FROM p),
g AS MATERIALIZED (SELECT DISTINCT doc_id, pos FROM (SELECT doc_id, pos, sum(w) OVER (PARTITION BY doc_id, other, diagonal, run) AS words FROM q) WHERE words >= 50),
k AS (SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_deleted, string_agg(CASE WHEN g.pos IS NULL THEN line END, chr(10) ORDER BY l.pos) AS kept FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.pos = l.pos GROUP BY l.doc_id)
SELECT documents.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_deleted, 0) AS n_deleted, CASE WHEN text IS NOT NULL THEN coalesce(kept, '') END AS text FROM documents LEFT JOIN k ON k.doc_id = documents.doc_id"""
