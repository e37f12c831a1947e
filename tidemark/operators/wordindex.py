"""A kept index: postings of several weighted fields, stored once and asked many times.

The index is made of tables in the shared folder: documents, postings ordered by term (so that a question
reads the row groups of its words alone), and the vocabulary. Questions are answered by DataFrame
operations; what reaches the driver are a question's own words. Scores are BM25's with each field's weight,
in points of 2**-32; a field's statistics are the whole index's, whatever a question filters.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stem import russian
from ..session import ship, stored
from . import search

#: Documents of one call of set_many, unless it is told otherwise.
MOST_SET = 1000
#: Letters of a script; a word is corrected by words of its own script alone.
SCRIPTS = ("Latin", "Cyrillic", "Greek", "Hebrew", "Arabic")


def _analysed(docs: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """(field, stem, term, doc, tf, length) of every document: words as written, and the stems of Cyrillic words as a part of their own."""
    kind = docs.schema[key].dataType
    names = ["field", "stem", "term", "doc", "tf", "length"]

    def run(batches):
        for batch in batches:
            rows = []
            for doc, *texts in zip(*(batch.column(i).to_pylist() for i in range(1 + len(fields)))):
                for number, text in enumerate(texts):
                    found = search.words(text)
                    stems = [russian(w) for w in found if _CYRILLIC.search(w)]
                    for stem, terms in ((False, found), (True, stems)):
                        counts: dict[str, int] = {}
                        for w in terms:
                            counts[w] = counts.get(w, 0) + 1
                        rows += [(number, stem, w, doc, c, len(terms)) for w, c in counts.items()]
            for i in range(0, len(rows), 20_000):
                some = list(zip(*rows[i : i + 20_000]))
                yield pa.RecordBatch.from_arrays([pa.array(some[0], pa.int32()), pa.array(some[1], pa.bool_()), pa.array(some[2], pa.string()), pa.array(some[3], batch.column(0).type), pa.array(some[4], pa.int64()), pa.array(some[5], pa.int64())], names=names)

    return docs.select(key, *fields).mapInArrow(run, f"field int, stem boolean, term string, doc {kind.simpleString()}, tf long, length long")


_CYRILLIC = regex.compile(r"\p{Cyrillic}")


@dataclass(frozen=True)
class WordIndex:
    """Documents by key, with the postings of their fields. Every change gives a new index."""

    docs: DataFrame
    postings: DataFrame
    vocabulary: DataFrame
    key: str
    weights: dict[str, float]
    count: int
    tokens: dict[tuple[int, bool], int]

    @staticmethod
    def of_table(docs: DataFrame, key: str, fields: dict[str, float]) -> WordIndex:
        """The index of a table: fields by name, with their weights. Documents without a key are left out; of one key the first counts."""
        ship(docs.sparkSession)
        held = stored(docs.where(F.col(key).isNotNull()).dropDuplicates([key]), "index-docs")
        return WordIndex._kept(held, _analysed(held, key, tuple(fields)), key, fields)

    @staticmethod
    def _kept(docs: DataFrame, postings: DataFrame, key: str, fields: dict[str, float]) -> WordIndex:
        n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        kept = stored(postings.repartitionByRange(n, "term").sortWithinPartitions("term", "field", "stem", "doc"), "index-postings")
        words = stored(kept.where("NOT stem").groupBy("term").agg(F.count_distinct("doc").alias("df"), F.count("*").alias("keys")), "index-words")
        sums = kept.groupBy("field", "stem").agg(F.sum("tf").alias("t")).collect()  # a row for each part of a field
        return WordIndex(docs, kept, words, key, dict(fields), docs.count(), {(r["field"], r["stem"]): r["t"] for r in sums})

    # -- writes

    def set_many(self, new: DataFrame, most: int | None = MOST_SET) -> WordIndex:
        """The index with new documents in place of those of their keys. More than `most` are refused, none is left out; None: any number."""
        if most is not None and new.limit(most + 1).count() > most:
            raise ValueError(f"more than {most} documents; set a table with most=None")
        new = stored(new.dropDuplicates([self.key]), "index-new")  # of one key the same row everywhere
        old = self.delete_keys(new.select(self.key))
        docs = stored(old.docs.unionByName(new.select(*self.docs.columns)), "index-docs")
        return WordIndex._kept(docs, old.postings.unionByName(_analysed(new, self.key, tuple(self.weights))), self.key, self.weights)

    def delete_keys(self, keys: DataFrame) -> WordIndex:
        """The index without the documents of some keys, not stored yet: for a change that follows."""
        gone = keys.select(F.col(self.key).alias("_gone")).distinct()
        return replace(self, docs=self.docs.join(gone, F.col(self.key) == F.col("_gone"), "left_anti"), postings=self.postings.join(gone, F.col("doc") == F.col("_gone"), "left_anti"))

    def delete(self, keys: DataFrame) -> WordIndex:
        left = self.delete_keys(keys)
        return WordIndex._kept(stored(left.docs, "index-docs"), left.postings, self.key, self.weights)

    def get(self, key) -> DataFrame:
        return self.docs.where(F.col(self.key) == F.lit(key))

    # -- words

    def held(self, words: list[str]) -> set[str]:
        """Those of a question's words that a document holds."""
        return {r["term"] for r in self.vocabulary.where(F.col("term").isin(words)).select("term").collect()} if words else set()

    def corrections(self, word: str, most: int = 8) -> DataFrame:
        """(term, edits, df): the nearest words of the word's script: one edit from 5 letters, two from 9, a swap being one; held by most first."""
        edits = 0 if len(word) < 5 else 1 if len(word) < 9 else 2
        if not edits:
            return self.vocabulary.limit(0).select("term", F.lit(0).alias("edits"), "df")
        near = self.vocabulary.where(F.length("term").between(len(word) - edits, len(word) + edits) & (F.col("term") != word))
        script = next((s for s in SCRIPTS if regex.match(rf"\p{{{s}}}", word)), None)
        if script:
            near = near.where(F.col("term").rlike(rf"^\p{{Is{script}}}"))
        near = near.where(F.levenshtein("term", F.lit(word), 2 * edits) >= 0)  # a swap is two such edits, so none is lost

        @F.pandas_udf("int")
        def distance(s: pd.Series) -> pd.Series:
            return s.map(lambda t: search.damerau(word, t, edits))

        best = near.withColumn("edits", distance(F.col("term"))).where(F.col("edits") <= edits).orderBy("edits", F.desc("df"), "term").limit(most)
        first = Window.partitionBy(F.lit(1))  # over `most` rows
        return best.withColumn("_least", F.min("edits").over(first)).where("edits = _least").orderBy(F.desc("df"), "term").select("term", "edits", "df")

    def read(self, text: str, layouts: tuple[str, ...] = ("en", "ru"), correct: bool = True) -> tuple[list[str], str | None]:
        """The words of a question as it is best read, and that reading where it differs from the text: pieces typed on another layout, then typos."""
        pieces = text.split()
        ways = {p: [r for a in layouts for b in layouts if a != b and (r := search.retyped(p, a, b)) != p] for p in pieces}
        held = self.held(sorted({w for p in pieces for t in (p, *ways[p]) for w in search.words(t)}))
        out = []
        for p in pieces:
            if not held & set(search.words(p)):
                p = next((r for r in ways[p] if search.words(r) and set(search.words(r)) <= held), p)
            if correct:
                for w in search.words(p):
                    if w not in held and len(w) >= 5 and (near := self.corrections(w).first()):
                        p = near["term"]
            out.append(p)
        return search.words(" ".join(out)), " ".join(out) if out != pieces else None

    # -- answers

    def _keys(self, words: list[str]) -> list[tuple[int, bool, str]]:
        """(field, stem, term) that a question's words are found by, each once: as written, by their stems, and stems as written too."""
        out: dict[tuple[int, bool, str], None] = {}
        for w in words:
            stem = russian(w) if _CYRILLIC.search(w) else w
            for number in range(len(self.weights)):
                out |= dict.fromkeys([(number, False, w), (number, True, stem)] + ([(number, False, stem)] if stem != w else []))
        return list(out)

    def _points(self, hits: DataFrame) -> DataFrame:
        """hits (field, stem, list, doc, tf, length, weight) with points, by the statistics of the whole index."""
        df = hits.groupBy("field", "stem", "list").agg(F.count("*").alias("df"))
        weights = list(self.weights.values())
        part = F.create_map(*(x for (f, s), t in self.tokens.items() for x in (F.concat(F.lit(f).cast("string"), F.lit(s).cast("string")), F.lit(t / max(1, self.count)))))
        mean = F.try_element_at(part, F.concat(F.col("field").cast("string"), F.col("stem").cast("string")))
        field = reduce(lambda a, i: F.when(F.col("field") == i, weights[i]).otherwise(a), range(len(weights)), F.lit(0.0))
        scored = hits.join(F.broadcast(df), ["field", "stem", "list"])  # a row for each list of a question
        idf = F.log(1 + (F.lit(float(self.count)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        k1, b = search.K1, search.B
        sat = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / mean))
        scale = field * F.when(F.col("stem"), search.STEM_WEIGHT).otherwise(1.0) * F.col("weight") * idf
        return scored.withColumn("points", F.floor(scale * sat * search.POINTS + 0.5).cast("long"))

    def _hits(self, words: list[str], prefixes: list[str]) -> DataFrame:
        keys = self._keys(words)
        named = self.postings.where(F.col("term").isin(sorted({t for _, _, t in keys})))  # read by the order of terms
        wanted = reduce(lambda a, k: a | ((F.col("field") == k[0]) & (F.col("stem") == k[1]) & (F.col("term") == k[2])), keys, F.lit(False))
        hits = named.where(wanted).select("field", "stem", F.col("term").alias("list"), "doc", "tf", "length", F.lit(1.0).alias("weight"))
        for p in prefixes:
            longer = self.postings.where(F.startswith("term", F.lit(p)) & (F.col("term") != p) & ~F.col("stem"))
            most = longer.groupBy("field", "term").agg(F.count("*").alias("c")).withColumn("_n", F.row_number().over(Window.partitionBy("field").orderBy(F.desc("c"), "term"))).where(F.col("_n") <= search.PREFIX_WORDS)
            joined = longer.join(F.broadcast(most.select("field", "term")), ["field", "term"]).groupBy("field", "doc", "length").agg(F.sum("tf").alias("tf"))  # at most PREFIX_WORDS terms of a field
            hits = hits.unionByName(joined.select("field", F.lit(False).alias("stem"), F.lit(p + "*").alias("list"), "doc", "tf", "length", F.lit(search.PREFIX_WEIGHT).alias("weight")))
        return hits

    def scored(self, text: str, prefix: str = "whole", correct: bool = True, where: Column | None = None) -> tuple[DataFrame, str | None]:
        """(doc, points, score) of the documents a question finds, and how it was read if otherwise than as it stands.

        prefix: "whole"; "last", the last word of two letters or more also begins longer ones, if nothing follows it; "every", each of the
        first words does, and documents that hold all of them come first. where: a condition on the documents' columns.
        """
        if prefix not in ("whole", "last", "every"):
            raise ValueError(f"no way to read prefixes: {prefix!r}")
        words, reading = self.read(text, correct=correct)
        starts: list[str] = []
        if prefix == "last" and words and len(words[-1]) >= 2 and text[-1:].isalnum():
            starts = words[-1:]
        elif prefix == "every":
            starts = list(dict.fromkeys(w for w in words if len(w) >= 2))[: search.EVERY_WORDS]
        points = self._points(self._hits(words, starts))
        out = points.groupBy("doc").agg(F.sum("points").alias("points"), *([F.collect_set(F.rtrim("list", F.lit("*"))).alias("_lists")] if prefix == "every" and starts else []))
        if prefix == "every" and starts:
            top = points.groupBy("field", "stem", "list").agg(F.max("points").alias("p")).agg(F.sum("p").alias("_above"))
            ways = [{w, russian(w)} if _CYRILLIC.search(w) else {w} for w in starts]
            all_ = reduce(lambda a, some: a & F.arrays_overlap("_lists", F.array(*map(F.lit, sorted(some)))), ways, F.lit(True))
            out = out.join(F.broadcast(top)).withColumn("points", F.col("points") + F.when(all_, F.col("_above")).otherwise(0)).select("doc", "points")  # one row
        if where is not None:
            passing = self.docs.where(where).select(F.col(self.key).alias("doc"))
            out = out.join(passing, "doc", "left_semi")
        return out.withColumn("score", F.col("points") / search.POINTS), reading

    def search(self, text: str, limit: int = 10, offset: int = 0, near: DataFrame | None = None, vector_weight: float | None = None, rerank: bool = False, **how) -> Hits:
        """The best hits: id, value, score, text_score and similarity. near: (doc, similarity) of a vector question, joined by weight or for reranking."""
        scored, reading = self.scored(text, **how)
        pool = max(100, offset + limit)
        if near is None or vector_weight == 0:
            best = scored.select("doc", "score", F.col("score").alias("text_score"), F.lit(None).cast("double").alias("similarity"))
        elif vector_weight == 1:
            best = near.select("doc", F.col("similarity").alias("score"), F.lit(None).cast("double").alias("text_score"), "similarity")
        elif rerank:
            best = search.reranked(scored, near, pool).join(near, "doc", "left")
        else:
            best = search.fused(scored, near, 0.5 if vector_weight is None else vector_weight, pool).join(scored.select("doc", F.col("score").alias("text_score")), "doc", "left").join(near, "doc", "left")
        page = best.orderBy(F.desc("score"), *([F.desc("text_score")] if rerank and near is not None else []), "doc").offset(offset).limit(limit)
        value = F.struct(*self.docs.columns).alias("value")
        hits = page.join(self.docs.withColumn("value", value).select(F.col(self.key).alias("doc"), "value"), "doc").orderBy(F.desc("score"), "doc")
        return Hits(hits.select(F.col("doc").alias("id"), "value", "score", "text_score", "similarity"), scored, reading, self, text)


@dataclass(frozen=True)
class Hits:
    """A page of hits; `corrected` is how the question was read, where that is not as it stands."""

    page: DataFrame
    scored: DataFrame
    corrected: str | None
    index: WordIndex
    text: str

    def total(self) -> DataFrame:
        """(count, at_least): exact up to a bound, and whether there are more."""
        return search.total(self.scored)

    def matches(self) -> DataFrame:
        """(doc, field, start, length, word): where the fields of the page's hits hold the question's words, in UTF-8 bytes."""
        words, _ = self.index.read(self.text)
        asked = {w: w for w in words} | {russian(w): w for w in words if _CYRILLIC.search(w)}

        def spans(text: str | None) -> list[dict]:
            out = []
            for m in regex.finditer(r"[\p{L}\p{N}\p{M}]+(?:['’.][\p{L}\p{N}\p{M}]+)*", text or ""):
                found = search.words(m[0])
                w = next((asked[y] for x in found for y in (x, russian(x) if _CYRILLIC.search(x) else x) if y in asked), None)
                if w is not None:
                    out.append({"start": len(text[: m.start()].encode()), "length": len(m[0].encode()), "word": w})
            return out

        @F.pandas_udf("array<struct<start:int,length:int,word:string>>")
        def found(s: pd.Series) -> pd.Series:
            return s.map(spans)

        fields = list(self.index.weights)
        each = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"value.{f}").alias("text")) for f in fields))).alias("f")
        rows = self.page.select(F.col("id").alias("doc"), each).select("doc", "f.field", "f.text")
        return rows.select("doc", "field", F.explode(found(F.col("text"))).alias("x")).select("doc", "field", "x.*")


_BUILT: dict[tuple, WordIndex] = {}


def kept(docs: DataFrame, name: str, key: str, fields: dict[str, float]) -> WordIndex:
    """The index of that name in this application, built by the first question."""
    at = (docs.sparkSession.sparkContext.applicationId, name, key, tuple(fields.items()))
    if at not in _BUILT:
        _BUILT[at] = WordIndex.of_table(docs, key, fields)
    return _BUILT[at]
