"""Line deduplication by a suffix array over line ids (operator 9), in DataFrame operations only.

The corpus is one sequence of line ids. The suffix that begins at each line gets ranks by prefix
doubling: rank 0 names its first line, and rank k+1 comes from the pair (rank k here, rank k at 2**k
lines further on), so that two suffixes have equal rank k exactly if their first 2**k lines are equal.
A rank is the place of the first suffix that has it, which saves a global sort and tells the first copy
at once. Ranks are made from partial minima; lines that stand everywhere get theirs by broadcast, so that no
task gathers a common line. A suffix whose prefix is met once only leaves the doubling (its prefix can't be repeated), so
that the rounds work on repeated lines alone and stop at the depth that is asked for.

Suffixes with a common prefix of m lines are an interval of the suffix array with a longest common
prefix of m at least; overlapping ranks (k here, k at m - 2**k further on) name it for any m. A run of
lines counts from min_words words. For each line the shortest such prefix that begins there, and the
shortest such run that ends there, are named; a maximal repeated run is the union of the repeated ones
among them. Every line that lies in a copy of one, other than the first copy in the order of (doc_id,
line), is deleted.

Lines are what split at "\\n" gives; they are compared byte by byte through 128 bits of hashes. A null
text stays null and has n_lines 0; an empty text is one empty line, and stays (it has no words).
Documents lose all their lines if another document holds them before; their text is then empty.
Repeated rows (one doc_id and one text) are one document: a copy inside the text is deleted from each,
and they are not copies of one another. Documents of one doc_id with different texts are ordered by a
hash of the text; a null doc_id comes first. Extra columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .common import discard, stored

#: Bits of the distance of doc_ids up to which they number the documents themselves.
WIDEST_IDS = 38
#: Words that a repeated run must have. The same bound as for other exact passages in this subpackage.
MIN_WORDS = 50


def _text_key(text: Column) -> Column:
    return F.xxhash64(text)


def _numbered(docs: DataFrame, dense: bool) -> tuple[DataFrame | None, int]:
    """None and the least doc_id, if doc_ids are distinct, near each other and not null; else a table (doc_id, text key, number)."""
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("c"))
    f = ids.agg(F.max("c").alias("c"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count_if(F.col("doc_id").isNull()).alias("none")).first()
    if f["c"] is None:
        return None, 0
    if not dense and f["c"] == 1 and f["none"] == 0 and f["high"] - f["low"] < 1 << WIDEST_IDS:
        return None, int(f["low"])
    keys = docs.select("doc_id", _text_key(F.col("text")).alias("tk")).distinct()
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = stored(keys.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "tk").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tk").withColumn("mid", F.monotonically_increasing_id()))
    # One row for each partition; the running total of their counts turns the numbers into dense ones.
    part = F.shiftright("mid", 33)
    base, at = [], 0
    for r in sorted(keys.groupBy(part.alias("p")).agg(F.count("*").alias("c")).collect(), key=lambda r: r["p"]):
        base.append((r["p"], at))
        at += r["c"]
    first = F.broadcast(docs.sparkSession.createDataFrame(base, "p long, first long"))
    return keys.withColumn("p", part).join(first, "p").select("doc_id", "tk", (F.col("first") + (F.col("mid") - F.shiftleft("p", 33))).alias("number")), 0


def _lines(docs: DataFrame, numbers: DataFrame | None, low: int) -> DataFrame:
    """(number of the document, lines as an array of (hash, hash, words))."""
    each = F.transform(F.split("text", "\n"), lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(x, F.lit(7)).alias("b"), F.regexp_count(x, F.lit(common.WORD)).alias("w")))
    if numbers is None:
        return docs.where("text IS NOT NULL").select((F.col("doc_id").cast("long") - F.lit(low)).alias("number"), each.alias("lines"))
    keyed = docs.where("text IS NOT NULL").select("doc_id", _text_key(F.col("text")).alias("tk"), each.alias("lines")).dropDuplicates(["doc_id", "tk"])
    n = numbers.select(F.col("doc_id").alias("_d"), F.col("tk").alias("_t"), "number")
    return keyed.join(n, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("tk") == F.col("_t"))).select("number", "lines")


def _repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows (stored; g, keys...) of which the keys are met twice or more, with r, the first g that has them."""
    return common.with_groups(rows, keys, F.min("g").alias("r"), where="_c > 1")


def deleted_lines(docs: DataFrame, min_words: int = MIN_WORDS, dense: bool = False) -> tuple[DataFrame, DataFrame | None, int]:
    """(number, gone: sorted line numbers) of documents that lose lines, and how documents are numbered."""
    common.prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    numbers, low = _numbered(docs, dense)
    arrays = _lines(docs, numbers, low)
    flat = stored(arrays.select("number", F.posexplode("lines").alias("pos", "line")).select("number", "pos", "line.a", "line.b", "line.w"))
    top = flat.agg(F.max("pos"), F.max("number")).first()
    if top[0] is None:
        return docs.sparkSession.createDataFrame([], "number long, gone array<int>"), numbers, low
    shift = (int(top[0]) + 1).bit_length() + 1  # a place 2**k lines further on never falls into the next document
    if int(top[1]).bit_length() + shift > 62:
        if numbers is None:
            discard(flat)
            return deleted_lines(docs, min_words, dense=True)
        raise ValueError(f"places of {int(top[1])} documents of {int(top[0])} lines don't fit 62 bits")
    lines = flat.select((F.shiftleft("number", shift) + F.col("pos")).alias("g"), "a", "b", "w")
    ranks = [stored(_repeated(lines, ["a", "b"]).select("g", "r", "w"))]

    # Stretches of repeated lines, and the words before each line of a stretch.
    number = F.shiftright("g", shift)
    in_doc = Window.partitionBy("number").orderBy("g")
    stretch = ranks[0].select("g", "w", number.alias("number")).withColumn("stretch", F.col("g") - F.row_number().over(in_doc))
    run = Window.partitionBy("number", "stretch")
    words = stretch.withColumn("to", F.sum("w").over(run.orderBy("g").rowsBetween(Window.unboundedPreceding, 0))).withColumn("since", F.col("to") - F.col("w"))
    words = words.drop("w")
    # The shortest run of min_words from g: it ends before the first line with `since` at since(g) + min_words or more,
    # or with the last line. Marks (kind 0) and questions (kind 1) are sorted together, and a running last() finds the mark.
    last = Window.partitionBy("number", "stretch")
    marks = words.select("number", "stretch", "g", F.explode(F.array(
        F.struct(F.lit(0).alias("kind"), F.col("to").alias("at"), (F.col("g") + 1).alias("place")),  # a run may end here
        F.struct(F.lit(1).alias("kind"), (F.col("since") + min_words).alias("at"), F.col("g").alias("place")),  # a run begins
        F.struct(F.lit(2).alias("kind"), F.col("since").alias("at"), F.col("g").alias("place")),  # a run may begin here
        F.struct(F.lit(3).alias("kind"), (F.col("to") - min_words).alias("at"), (F.col("g") + 1).alias("place")),  # a run ends
    )).alias("x")).select("number", "stretch", "x.*")
    mark = lambda kind: F.last(F.when(F.col("kind") == kind, F.col("place")), ignorenulls=True)
    down = last.orderBy(F.col("at").desc(), F.col("kind").asc(), F.col("place").desc()).rowsBetween(Window.unboundedPreceding, 0)
    up = last.orderBy(F.col("at").asc(), F.col("kind").asc(), F.col("place").asc()).rowsBetween(Window.unboundedPreceding, 0)
    begun = marks.where("kind < 2").withColumn("end", mark(0).over(down)).where("kind = 1 AND end IS NOT NULL").select(F.col("place").alias("g"), "end")
    ended = marks.where("kind > 1").withColumn("start", mark(2).over(up)).where("kind = 3 AND start IS NOT NULL").select(F.col("start").alias("g"), F.col("place").alias("end"))
    runs = stored(begun.unionByName(ended).distinct().withColumn("m", F.col("end") - F.col("g")))
    most = runs.agg(F.max("m")).first()[0]
    if most is None:
        discard(flat, runs, *ranks)
        return docs.sparkSession.createDataFrame([], "number long, gone array<int>"), numbers, low

    # Prefix doubling, as deep as the longest run that is asked for.
    while 2 ** len(ranks) <= most:
        half = 2 ** (len(ranks) - 1)
        here = ranks[-1].select("g", F.col("r").alias("r1"))
        there = ranks[-1].select((F.col("g") - half).alias("g"), F.col("r").alias("r2"))
        paired = stored(here.join(there, "g"))
        deeper = stored(_repeated(paired, ["r1", "r2"]).select("g", "r"))
        discard(paired)
        ranks.append(deeper)
        if deeper.isEmpty():
            break
    level = common.union_all(df.select(F.lit(k).alias("k"), "g", "r") for k, df in enumerate(ranks))
    asked = runs.withColumn("k", F.length(F.bin("m")) - 1).withColumn("tail", F.col("end") - F.expr("shiftleft(1L, k)"))
    named = asked.join(level.withColumnRenamed("r", "r1"), ["k", "g"]).join(level.select("k", F.col("g").alias("tail"), F.col("r").alias("r2")), ["k", "tail"])
    named = stored(named.select("m", "r1", "r2", "g", "end"))
    copies = common.with_groups(named, ["m", "r1", "r2"], F.min("g").alias("first"), where="_c > 1").where("g > first").groupBy("g").agg(F.max("end").alias("end"))

    # A line goes if a copy that begins at it or before reaches beyond it.
    reach = F.max("end").over(run.orderBy("g").rowsBetween(Window.unboundedPreceding, 0))
    gone = words.select("number", "stretch", "g").join(copies, "g", "left").withColumn("reach", reach).where("reach > g")
    pos = (F.col("g") - F.shiftleft("number", shift)).cast("int")
    out = stored(gone.groupBy("number").agg(F.sort_array(F.collect_list(pos)).alias("gone")))
    discard(flat, runs, named, *ranks)
    return out, numbers, low


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the later copies of repeated runs deleted from text, and n_lines, n_deleted (long), deleted_lines (array of int).

    Columns of these three names are replaced.
    """
    gone, numbers, low = deleted_lines(docs, min_words)
    d, t, g, all_lines = common.fresh(docs, "_d", "_t", "_gone", "_lines")
    doc_id = F.col("doc_id").cast("long")
    if numbers is None:
        gone = gone.select((F.col("number") + F.lit(low)).alias(d), F.col("gone").alias(g))
        same = doc_id == F.col(d)
    else:
        gone = stored(gone.join(numbers, "number").select(F.col("doc_id").alias(d), F.col("tk").alias(t), F.col("gone").alias(g)))
        same = doc_id.eqNullSafe(F.col(d)) & (_text_key(F.col("text")) == F.col(t))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.translate("text", "\n", "")) + 1).cast("long")
    # Documents that lose nothing stay where they are, as far as a bitmap of fixed size tells; the others are shuffled, always.
    some, safe = common.split_by_bitmap(docs, doc_id, gone, F.col(d))
    met = some.withColumn("n_lines", n_lines).join(gone.hint("merge"), same, "left").withColumn(all_lines, F.when(F.col(g).isNotNull(), F.split("text", "\n")))
    left = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col(g))
    text = F.when(F.col(g).isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(all_lines, i)), "\n"))
    met = met.withColumn("text", text).withColumn("deleted_lines", F.coalesce(g, F.array().cast("array<int>"))).withColumn("n_deleted", F.size("deleted_lines").cast("long"))
    safe = safe.withColumn("n_lines", n_lines).withColumn("deleted_lines", F.array().cast("array<int>")).withColumn("n_deleted", F.lit(0).cast("long"))
    return met.drop(d, t, g, all_lines).unionByName(safe)
