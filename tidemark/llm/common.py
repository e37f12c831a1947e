"""What the operators of this subpackage share: shared storage, word and shingle hashes, components."""

from __future__ import annotations

import gc
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path, ship

#: ASCII white space that ends a word, and the pattern of a word.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
SHINGLE = 5
#: Near duplicates: 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Rows of an Arrow batch, so that a batch of very long texts stays in memory.
BATCH_ROWS = 500


# --- the session ---------------------------------------------------------------------------------


def prepare(spark: SparkSession) -> None:
    """Sends this package to the executors once, and bounds the session's Arrow batches by BATCH_ROWS, as texts may be very long."""
    ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def stored(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read again: the lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = shared_path(spark, "corpus")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    return out


def discard(*frames: DataFrame | None) -> None:
    """Deletes what stored() wrote. Only for tables that no later result reads."""
    for df in frames:
        if df is not None and (path := getattr(df, "_tidemark_path", None)):
            jvm = df.sparkSession._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- words and shingles --------------------------------------------------------------------------


class WordHashes(dict):
    """64-bit hashes of words. Bounded: trim() forgets them all beyond LIMIT words."""

    LIMIT = 150_000

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def trim(self) -> None:
        if len(self) > self.LIMIT:
            self.clear()


HASHES = WordHashes()
#: What a worker keeps from one task to the next, by name.
CACHES: dict[str, dict] = {"words": HASHES}


def in_worker(*kept: str):
    """For a function over batches: a worker that goes over to it forgets the caches of other operators, and collects its garbage at the end, not meanwhile."""

    def around(f):
        def run(batches):
            for name, cache in CACHES.items():
                if name not in kept:
                    cache.clear()
            gc.disable()  # very many small objects, and hardly a cycle
            try:
                yield from f(batches)
            finally:
                gc.enable()
                gc.collect()

        return run

    return around


_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    """The words of a whole text with A-Z in lower case; null has none."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))


def windows(h: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """A hash for each window of k words, in order; fewer words make one window."""
    n = len(h)
    if n == 0:
        return h
    k = min(k, n)
    s = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        s += h[i : n - k + 1 + i] * _ODD[i % len(_ODD)] + np.uint64(i // len(_ODD))
    return mix(s)


def shingle_set(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingle hashes of a whole text."""
    return np.unique(windows(word_hashes(words_of(text)), k))


def texts_of(batch, column: str = "text") -> list:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()


# --- joins that hold up under hot keys, by DataFrame operations only --------------------------------

#: Groups with more than one HEAVY-th of the rows; there are fewer than HEAVY of them, whatever the data.
HEAVY = 1000
#: Words of 64 bits of the bitmap that a table is first filtered by.
BITMAP_WORDS = 1 << 16


def with_groups(rows: DataFrame, keys: list[str], *aggregates, where: str = "true") -> DataFrame:
    """rows (stored; keys not null), each with the aggregates of its group, for the groups that satisfy where (`_c`: rows of the group).

    Groups are pre-aggregated before they are shuffled. The heavy ones, fewer than HEAVY by their definition,
    go back to their rows by broadcast, so that no key gathers its rows in one task; the others by a shuffle.
    """
    groups = stored(rows.groupBy(*keys).agg(F.count("*").alias("_c"), *aggregates).where(where))
    total = groups.agg(F.sum("_c")).first()[0] or 0
    hot = F.col("_c") * HEAVY > total
    heavy, light = groups.where(hot).drop("_c"), groups.where(~hot).drop("_c")
    rest = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(heavy), keys).unionByName(rest.join(light, keys))


def split_by_bitmap(rows: DataFrame, key, wanted: DataFrame, wanted_key) -> tuple[DataFrame, DataFrame]:
    """(rows of which the key may be among the wanted, rows of which it is not), without a shuffle of rows.

    The wanted keys are bits of BITMAP_WORDS words, which are broadcast: their number is fixed, so is their
    size. Beyond some millions of wanted keys the bitmap is full and tells nothing apart: then all rows may
    be wanted, which is no less right. The two keys are columns of one type; null is a key like any other.
    """
    at = lambda k: F.pmod(F.xxhash64(k), F.lit(64 * BITMAP_WORDS))
    bit = lambda x: F.expr(f"shiftleft(1L, CAST(`{x}` & 63 AS INT))")
    word = lambda x: F.shiftright(F.col(x), 6)
    bits = wanted.select(at(wanted_key).alias("_at")).groupBy(word("_at").alias("_word")).agg(F.bit_or(bit("_at")).alias("_bits"))
    bits = stored(bits)
    mine = fresh(rows, "_at", "_word", "_bits")
    bits = bits.select(F.col("_word").alias(mine[1]), F.col("_bits").alias(mine[2]))
    met = rows.withColumn(mine[0], at(key)).withColumn(mine[1], word(mine[0])).join(F.broadcast(bits), mine[1], "left")
    on = F.coalesce(F.col(mine[2]).bitwiseAND(bit(mine[0])) != 0, F.lit(False))
    return met.where(on).select(*map(quoted, rows.columns)), met.where(~on).select(*map(quoted, rows.columns))


def with_table(rows: DataFrame, key: str, groups: DataFrame, size: str, tie: Column) -> DataFrame:
    """rows left-joined with the columns of groups (stored, small next to rows; key not null and once) by a key that may be null.

    size: the column of groups with the rows of each. Heavy groups, fewer than HEAVY, are broadcast; their rows, and those without
    a key, go by tie, a hash that spreads them, through the shuffle of the others.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    hot = F.col(size) * HEAVY > total
    columns = [c for c in groups.columns if c not in (key, size)]
    named = lambda df, end: df.select(F.col(key).alias(f"_k{end}"), F.struct(*columns).alias(f"_v{end}"))
    met = rows.join(F.broadcast(named(groups.where(hot), 1)), F.col(key) == F.col("_k1"), "left")
    met = met.withColumn("_k", F.when(F.col(key).isNotNull() & F.col("_k1").isNull(), F.concat(F.lit("k"), F.col(key))).otherwise(F.concat(F.lit("t"), tie.cast("string"))))
    met = met.join(named(groups.where(~hot), 2).withColumn("_k2", F.concat(F.lit("k"), F.col("_k2"))), F.col("_k") == F.col("_k2"), "left")
    return met.withColumn("_v", F.coalesce("_v1", "_v2")).select(*rows.columns, *(F.col(f"_v.{c}").alias(c) for c in columns))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of df has it."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def quoted(name: str):
    return F.col("`" + name.replace("`", "``") + "`")


# --- connected components, by DataFrame operations only -------------------------------------------


def _stars(e: DataFrame) -> bool:
    """Whether each u has one v, and no v is a u."""
    ends = e.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("a"), F.lit(0).alias("b")), F.struct(F.col("v").alias("x"), F.lit(0).alias("a"), F.lit(1).alias("b")))).alias("e")).select("e.*")
    return ends.groupBy("x").agg(F.sum("a").alias("a"), F.max("b").alias("b")).where("a > 1 OR (a > 0 AND b > 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of the undirected edges (u, v), by alternating stars.

    Large star: each node hands its larger neighbours to the smallest node it sees; small star does so
    with its smaller ones. The edges become stars around the smallest node of each component in a
    logarithmic number of rounds, however long the chains are. Every round is written to the shared
    folder; a hub's neighbours meet its smallest one by broadcast, not in one task. Nulls are no nodes;
    an edge from a node to itself names the node.
    """
    e = edges.select(F.col("u"), F.col("v")).where("u IS NOT NULL AND v IS NOT NULL")
    alone = e.where("u = v").select(F.col("u").alias("node")).distinct()
    e = stored(e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_groups(both, ["u"], F.least(F.col("u"), F.min("v")).alias("m")).where("v > u")
        large = stored(large.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        # Here u > v everywhere. Small star: u and its smaller neighbours go to the smallest of them.
        small = with_groups(large, ["u"], F.min("v").alias("m"))
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*")
        after = stored(small.where("u <> v").distinct())
        discard(e, large)
        e = after
    linked = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    singles = alone.join(linked.unionByName(roots).select("node"), "node", "left_anti").select("node", F.col("node").alias("component"))
    return linked.unionByName(roots).unionByName(singles)


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def batches(rows: Iterator[tuple], schema, size: int = 2000):
    """Arrow record batches of at most size rows."""
    import pyarrow as pa

    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)
