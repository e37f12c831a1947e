"""Language identification by Bayesian evidence fusion (operator 2).

For each page four kinds of evidence are multiplied: the likelihood of its text, the language that the
markup declares, the suffix of its address (a language part of the path, else the top-level domain), and
a prior for its host. Text likelihoods are a naive Bayes model over hashed byte trigrams, fitted on
labelled documents: at most SAMPLE of each language, those with the least hash of doc_id (a bound on
memory; every row can be among them). How declarations and suffixes go with languages, and what hosts
hold, are counts over all pages, gathered by grouped aggregation from the posteriors of the texts alone;
host counts are smoothed towards their registered domain, the domain's towards its top-level domain, and
that towards all pages. A page's own share is taken out of the counts that judge it.

A page without text (null or empty html) has no text evidence; without a url it has no host evidence
beyond all pages'. Ties go to the first language in alphabetical order. Repeated rows get the same
result. Documents without language or text are no training rows; without any, the result has null
languages. Extra columns don't matter.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, urlfilter
from .common import stored

#: Training documents of a language at most.
SAMPLE = 1000
#: Salts that a language's ids are dealt by.
SALTS = 32
#: Buckets of trigrams.
BUCKETS = 1 << 16
#: Trigrams overlap and repeat: so many count as one piece of evidence, and so many pieces at most.
PER_PIECE, PIECES = 3.0, 200.0
#: Pseudo-counts of the next wider level.
SMOOTH = 5.0

_SKIP = re.compile(r"(?is)<(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)|<[!/?a-z][^>]*>?")
_DECLARED = re.compile(r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?\s*([a-z]{2,3})""")
_META = re.compile(r"""(?is)<meta\b[^>]*?content-language[^>]*?content\s*=\s*["']?\s*([a-z]{2,3})""")


def visible(html: str | None) -> str:
    return entities.unescape(_SKIP.sub(" ", html)) if html else ""


def declared(html: str | None) -> str | None:
    m = html and (_DECLARED.search(html) or _META.search(html))
    return m[1].lower() if m else None


def trigrams(text: str) -> np.ndarray:
    """Hashed byte trigrams of a whole text, in lower case, digits and signs as spaces."""
    raw = np.frombuffer((" " + " ".join(re.findall(r"[^\W\d_]+", text.lower())) + " ").encode("utf-8", "ignore"), np.uint8).astype(np.uint32)
    if len(raw) < 3:
        return np.zeros(0, np.int64)
    return ((((raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]) * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64) % BUCKETS


def fit(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages, and the log likelihood of each bucket in each. What reaches the driver is BUCKETS counts for each language."""
    spark = docs.sparkSession
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "lang")
    langs = sorted(r["lang"] for r in labelled.select("lang").distinct().collect())
    if not langs:
        return [], np.zeros((BUCKETS, 0), np.float32)
    # Ids alone are ranked, in one pass: by language and salt first, where each task sends its first ones only, then SALTS
    # times sample ids of a language at most.
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    salted = labelled.withColumn("salt", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(SALTS)))
    first = salted.withColumn("n", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("n") <= sample)
    picked = first.select("doc_id", "lang", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).alias("n")).where(F.col("n") <= sample)
    ids = picked.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang")).distinct()
    texts = docs.join(F.broadcast(ids), (F.col("doc_id").cast("long") == F.col("_id")) & (F.col("lang") == F.col("_lang"))).select("lang", "text")  # at most sample ids of each language

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[lang] = sums.get(lang, 0) + np.bincount(trigrams(text), minlength=BUCKETS)
        for lang, c in sums.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(c[at])], names=["lang", "bucket", "c"])

    counts = np.zeros((BUCKETS, len(langs)))
    for r in texts.mapInArrow(common.in_worker()(count), "lang string, bucket long, c long").groupBy("lang", "bucket").agg(F.sum("c").alias("c")).collect():
        counts[r["bucket"], langs.index(r["lang"])] = r["c"]
    return langs, np.log((counts + 0.5) / (counts + 0.5).sum(0)).astype(np.float32)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def identified(pages: DataFrame, docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """page_id, url, host, declared, suffix, text_lang, lang, posterior, posteriors (by language) of every row of pages."""
    spark = pages.sparkSession
    common.prepare(spark)
    langs, table = fit(docs, sample)
    if not langs:
        blank = ("host", "declared", "suffix", "text_lang", "lang")
        return pages.select("page_id", "url", *(F.lit(None).cast("string").alias(c) for c in blank), F.lit(None).cast("double").alias("posterior"), F.lit(None).cast("array<double>").alias("posteriors"))
    model = spark.sparkContext.broadcast(table)

    def read(batches):
        logs = model.value
        for batch in batches:
            said, likely = [], []
            for h in batch.column(0).to_pylist():
                said.append(declared(h))
                t = trigrams(visible(h))
                total = logs[t].sum(0, dtype=np.float64) if len(t) else np.zeros(len(langs))
                pieces = min(len(t) / PER_PIECE, PIECES)
                likely.append((total / max(len(t), 1) * pieces).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(said, pa.string()), pa.array(likely, pa.list_(pa.float64()))], names=["page_id", "url", "declared", "likely"])

    fields = {f.name: f.dataType.simpleString() for f in pages.select("page_id", "url").schema.fields}
    rows = pages.select("html", "page_id", "url").mapInArrow(common.in_worker()(read), f"page_id {fields['page_id']}, url string, declared string, likely array<double>")
    n = len(langs)
    first = F.regexp_extract("path", "^/([A-Za-z]{2})(?:/|$)", 1)
    rows = rows.withColumn("host", urlfilter.host_of(F.col("url"))).withColumn("path", urlfilter.path_of(F.col("url")))
    top = F.regexp_extract("host", r"([^.]+)$", 1)
    rows = rows.withColumn("suffix", F.when(F.lower(first).isin(langs), F.concat(F.lit("/"), F.lower(first))).when(top != "", F.concat(F.lit("."), top)))
    rows = rows.withColumn("domain", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)).withColumn("top", top)
    best = F.array_max("likely")
    weights = F.transform("likely", lambda x: F.exp(x - best))
    soft = F.transform(weights, lambda w: w / F.aggregate(weights, F.lit(0.0), lambda a, b: a + b))
    rows = rows.withColumn("soft", soft).drop("path")
    rows = stored(rows)

    def sums(key: str) -> DataFrame:
        return stored(rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_c"), F.array(*(F.sum(F.get("soft", F.lit(i))) for i in range(n))).alias(f"s_{key}")))

    everything = rows.agg(F.array(*(F.coalesce(F.sum(F.get("soft", F.lit(i))), F.lit(0.0)) for i in range(n))).alias("s")).first()["s"]
    total = sum(everything) or 1.0
    base = [(x + 1) / (total + n) for x in everything]
    log_base = F.array(*(F.lit(float(np.log(b))) for b in base))
    flat = F.array(*(F.lit(float(b)) for b in base))
    zero = F.array(*(F.lit(0.0) for _ in range(n)))
    out = rows
    for key in ("declared", "suffix", "top", "domain", "host"):
        out = common.with_table(out, key, sums(key), "_c", F.xxhash64("page_id", "url"))

    def less(name: str):
        """The counts of a key without the page itself."""
        return F.zip_with(F.coalesce(F.col(f"s_{name}"), zero), F.col("soft"), lambda a, b: F.greatest(a - b, F.lit(0.0)))

    def smoothed(counts, prior):
        size = F.aggregate(counts, F.lit(0.0), lambda a, b: a + b)
        return F.zip_with(counts, prior, lambda c, p: (c + p * SMOOTH) / (size + SMOOTH))

    # One level after the other, each stored in a column, so that no expression holds the ones before it twice.
    out = out.select("*", *(less(k).alias(f"c_{k}") for k in ("declared", "suffix", "top", "domain", "host")))
    out = out.withColumn("p_top", smoothed(F.col("c_top"), flat))
    out = out.withColumn("p_domain", smoothed(F.col("c_domain"), F.col("p_top")))
    out = out.withColumn("p_host", smoothed(F.col("c_host"), F.col("p_domain")))
    # P(sign | language) is P(language | sign) P(sign) / P(language); P(sign) is the same for all languages.
    for key in ("declared", "suffix"):
        out = out.withColumn(f"e_{key}", F.when(F.col(key).isNull(), zero).otherwise(F.zip_with(smoothed(F.col(f"c_{key}"), flat), log_base, lambda p, b: F.log(p) - b)))
    score = F.zip_with(F.zip_with("likely", F.transform("p_host", lambda p: F.log(p)), lambda a, b: a + b), F.zip_with("e_declared", "e_suffix", lambda a, b: a + b), lambda a, b: a + b)
    out = out.withColumn("score", score).withColumn("best", F.array_max("score"))
    out = out.withColumn("odds", F.transform("score", lambda x: F.exp(x - F.col("best")))).withColumn("all", F.aggregate("odds", F.lit(0.0), lambda a, b: a + b))
    out = out.withColumn("posteriors", F.transform("odds", lambda x: x / F.col("all")))
    names = F.array(*(F.lit(x) for x in langs))
    at = lambda c: F.get(names, (F.array_position(c, F.array_max(c)) - 1).cast("int"))
    no_text = F.array_max("likely") == F.array_min("likely")
    return out.select("page_id", "url", "host", "declared", "suffix", F.when(~no_text, at(F.col("soft"))).alias("text_lang"), at(F.col("posteriors")).alias("lang"), F.array_max("posteriors").alias("posterior"), "posteriors")
