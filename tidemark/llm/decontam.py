"""Benchmark decontamination by greedy string tiling (operator 10).

Documents and benchmark items are joined on shared seeds of SEED words. For each document and item whose
seeds could cover enough of the item, greedy string tiling marks the longest common run of words that
touches no marked word, again and again until no run of SEED words is left. Runs are found by rolling
Karp-Rabin hashes of SEED words and are confirmed word by word as they grow. An item is contained when
100 * marked words >= PERCENT * its words; the order of the tiles is free, so reordered passages count.

A benchmark of at most BLOCK_CHARS characters (measured first) is broadcast, and documents meet it in one
pass without a shuffle. A larger one is joined by a shuffle on seeds: the documents send the distinct seeds
that a bitmap of fixed size lets through, under a hash of their text; texts and items of pairs with enough
seeds in common are then brought together and tiled, each text once however often it is repeated.

Words are compared with A-Z in lower case. Items without words, and null texts, match nothing. An item
with fewer words than a seed is its own seed. Ties between equally long runs go to the earliest place in
the item, then in the document. Where words repeat so often that places in common are many (PLACES), runs
are found row by row, in memory of the size of the text. Repeated rows, of documents and of items, give
repeated results; extra columns don't matter.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SEED = common.SHINGLE
#: Characters of a benchmark that is broadcast, at most.
BLOCK_CHARS = 20_000_000
#: Bits of the first look at a seed; of that at the seeds of a benchmark that isn't broadcast.
LOOK, WIDE_LOOK = 20, 24
#: Places in common of an item and a text that are listed at most.
PLACES = 200_000


def tiles(item: np.ndarray, doc: np.ndarray, places: list[tuple[int, int]], seed: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two sequences of word hashes: (place in item, place in doc, words), longest first.

    places: all (i, j) at which seed words agree by their rolling hash.
    """
    n, m = len(item), len(doc)
    heap, ended = [], {}
    for i, j in sorted(places):  # a diagonal's runs come in order; a run covers its later seeds
        if ended.get(i - j, -1) > i:
            continue
        k = 0
        while i + k < n and j + k < m and item[i + k] == doc[j + k]:
            k += 1
        ended[i - j] = i + k - seed + 1
        if k >= seed:
            heap.append((-k, i, j))
    heapq.heapify(heap)
    in_item, in_doc, out = np.zeros(n, bool), np.zeros(m, bool), []
    while heap:
        k, i, j = heapq.heappop(heap)
        k = -k
        taken = in_item[i : i + k] | in_doc[j : j + k]
        if not taken.any():
            in_item[i : i + k] = in_doc[j : j + k] = True
            out.append((i, j, k))
            continue
        edges = np.flatnonzero(np.diff(np.r_[True, taken, True].astype(np.int8)))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):  # what is left between marked words
            if b - a >= seed:
                heapq.heappush(heap, (a - b, i + a, j + a))
    return out


def tiles_by_rows(item: np.ndarray, doc: np.ndarray, seed: int) -> list[tuple[int, int, int]]:
    """The same tiles as tiles(), without a list of places: each sweep over the item's words holds a row of the text's length."""
    n, m = len(item), len(doc)
    in_item, in_doc, out = np.zeros(n, bool), np.zeros(m, bool), []

    def rows():
        run = np.zeros(m, np.int32)
        for i in range(n):
            before, run = run, np.zeros(m, np.int32)
            if not in_item[i]:
                at = np.flatnonzero((doc == item[i]) & ~in_doc)
                run[at] = 1
                run[at[at > 0]] += before[at[at > 0] - 1]
            yield i, run

    while True:
        most = max((int(run.max(initial=0)) for _, run in rows()), default=0)
        if most < seed:
            return out
        new_item, new_doc, before = in_item.copy(), in_doc.copy(), np.r_[0, np.cumsum(in_doc)]
        for i, run in rows():
            if most > i + 1 or new_item[i - most + 1 : i + 1].any():
                continue
            ends = np.flatnonzero(run == most)
            ends = ends[before[ends + 1] == before[ends - most + 1]]
            if len(ends):
                j = int(ends[0]) - most + 1
                new_item[i - most + 1 : i + 1] = new_doc[j : j + most] = True
                before = np.r_[0, np.cumsum(new_doc)]
                out.append((i - most + 1, j, most))
        in_item[:], in_doc[:] = new_item, new_doc  # what the sweep looked up stayed as it was at its beginning


def compared(item: np.ndarray, doc: np.ndarray, seed: int, percent: int, grams: tuple | None = None) -> tuple | None:
    """(words of the item, words marked, tiles, the tiles) if a text's words contain an item's; None if not.

    grams: the windows of seed words of the text, sorted, and their places, if they are known.
    """
    n = len(item)
    if n < seed:
        at = np.flatnonzero(common.windows(doc, n) == common.windows(item, n)[0]) if n and len(doc) >= n else ()
        return (n, n, 1, [(0, int(at[0]), n)]) if len(at) else None
    if len(doc) < seed:
        return None
    if grams is None:
        grams = _sorted(doc, seed)
    mine = common.windows(item, seed)
    lo, hi = np.searchsorted(grams[0], mine), np.searchsorted(grams[0], mine, "right")
    hit = np.flatnonzero(hi > lo)
    might = np.zeros(n, bool)
    for i in range(seed):
        might[hit + i] = True
    if 100 * int(might.sum()) < percent * n:
        return None
    count = (hi - lo)[hit]
    if count.sum() > PLACES:
        found = tiles_by_rows(item, doc, seed)
    else:
        j = grams[1][np.repeat(lo[hit], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
        found = tiles(item, doc, list(zip(np.repeat(hit, count).tolist(), j.tolist())), seed)
    marked = sum(k for _, _, k in found)
    return (n, marked, len(found), found) if 100 * marked >= percent * n else None


def _sorted(doc: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    grams = common.windows(doc, seed)
    order = np.argsort(grams, kind="stable")
    return grams[order], order


class Block:
    """The seeds of some items."""

    def __init__(self, items: list[tuple[int, str]], seed: int, percent: int):
        self.seed, self.percent = seed, percent
        self.ids, self.words = [], []
        seeds, item, count = [], [], []
        short: dict[int, list[int]] = {}
        for i, text in items:
            h = common.word_hashes(common.words_of(text))
            if not len(h):
                continue
            if len(h) < seed:
                short.setdefault(len(h), []).append(len(self.ids))
            else:
                s, c = np.unique(common.windows(h, seed), return_counts=True)
                seeds.append(s)
                count.append(c)
                item.append(np.full(len(s), len(self.ids)))
            self.ids.append(i)
            self.words.append(h)
        self.short = short
        self.seeds, self.item, self.count = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((seeds, np.uint64), (item, np.int64), (count, np.int64)))
        order = np.argsort(self.seeds, kind="stable")
        self.seeds, self.item, self.count = self.seeds[order], self.item[order], self.count[order]
        self.n = np.array(list(map(len, self.words)), np.int64)
        self.look = np.zeros(1 << LOOK, bool)
        self.look[(self.seeds & np.uint64((1 << LOOK) - 1)).astype(np.int64)] = True

    def matches(self, text: str | None) -> list[tuple[int, int, int, int, list]]:
        """(item id, words of the item, words marked, tiles, the tiles) of the items that a text contains."""
        doc = common.word_hashes(common.words_of(text))
        who: list[int] = []
        for k, ones in self.short.items():
            if len(doc) >= k:
                grams = np.unique(common.windows(doc, k))
                who += [w for w in ones if common.windows(self.words[w], k)[0] in grams]
        grams = None
        if len(doc) >= self.seed and len(self.seeds):
            all_ = common.windows(doc, self.seed)
            some = np.unique(all_[self.look[(all_ & np.uint64((1 << LOOK) - 1)).astype(np.int64)]])
            lo, hi = np.searchsorted(self.seeds, some), np.searchsorted(self.seeds, some, "right")
            n = hi - lo  # no more in all than the block has seeds
            if n.sum():
                at = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                met, of = np.unique(self.item[at], return_inverse=True)
                # Every seed that is met covers `seed` words of the item at most, at each of its places.
                who += met[100 * self.seed * np.bincount(of, self.count[at]) >= self.percent * self.n[met]].tolist()
                grams = _sorted(doc, self.seed)
        out = []
        for w in who:
            if found := compared(self.words[w], doc, self.seed, self.percent, grams):
                out.append((self.ids[w], *found))
        return out


_BLOCKS: dict[int, Block] = {}
common.CACHES["blocks"] = _BLOCKS


def _block(sent, seed: int, percent: int) -> Block:
    if sent.id not in _BLOCKS:
        _BLOCKS.clear()
        _BLOCKS[sent.id] = Block(sent.value, seed, percent)
    return _BLOCKS[sent.id]


class _Sent:
    """A broadcast with a name that workers can keep a block by."""

    def __init__(self, spark, rows):
        self.sent = spark.sparkContext.broadcast(rows)
        self.id = self.sent._jbroadcast.id()

    def __getstate__(self):
        return {"sent": self.sent, "id": self.id}

    @property
    def value(self):
        return self.sent.value


_TILE = pa.list_(pa.struct([("item_at", pa.int32()), ("doc_at", pa.int32()), ("words", pa.int32())]))
_FOUND = "item_words long, marked_words long, n_tiles long, tiles array<struct<item_at:int,doc_at:int,words:int>>"


def _cells(found: list) -> list[dict]:
    return [{"item_at": x, "doc_at": y, "words": k} for x, y, k in found]


def _fits(items: DataFrame, limit: int) -> bool:
    return int(items.agg(F.sum(F.length("text"))).first()[0] or 0) <= limit


def contained(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, percent: int = common.PERCENT, limit: int = BLOCK_CHARS) -> DataFrame:
    """A row for each document and item it contains: doc_id, item_id, item_words, marked_words, n_tiles, coverage, tiles."""
    spark = docs.sparkSession
    common.prepare(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if _fits(items, limit):
        sent = _Sent(spark, [tuple(r) for r in items.collect()])  # at most `limit` characters
        schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("item_words", pa.int64()), ("marked_words", pa.int64()), ("n_tiles", pa.int64()), ("tiles", _TILE)])

        def run(batches):
            b = _block(sent, seed, percent)
            for batch in batches:
                rows = [(i, *m[:4], _cells(m[4])) for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for m in b.matches(text)]
                common.HASHES.trim()
                yield from common.batches(iter(rows), schema)

        out = texts.mapInArrow(common.in_worker("words", "blocks")(run), f"doc_id long, item_id long, {_FOUND}")
    else:
        found = _joined(texts, items, seed, percent)
        named = items.select("item_id", _key_of("text").alias("item"))
        rows = _keyed(texts, "t").select("doc_id", "t")
        out = rows.join(found, "t").join(named, "item").select("doc_id", "item_id", "item_words", "marked_words", "n_tiles", "tiles")
    return out.withColumn("coverage", F.col("marked_words") / F.col("item_words"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, percent: int = common.PERCENT, limit: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs that contain no item, with docs' columns. One pass and no shuffle for a benchmark of at most limit characters."""
    spark = docs.sparkSession
    common.prepare(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL")
    if not _fits(items, limit):
        found = common.stored(_joined(docs.select("text"), items, seed, percent).select("t").distinct())
        (t, gone) = common.fresh(docs, "_t", "_gone")
        some, safe = common.split_by_bitmap(_keyed(docs, t), F.col(t), found, F.col("t"))
        left = some.join(found.select(F.col("t").alias(gone)).hint("merge"), F.col(t) == F.col(gone), "left_anti")
        return left.unionByName(safe).drop(t)
    sent = _Sent(spark, [tuple(r) for r in items.collect()])  # at most `limit` characters

    def run(batches):
        b = _block(sent, seed, percent)
        for batch in batches:
            yield batch.filter(pa.array([not b.matches(t) for t in common.texts_of(batch)], pa.bool_()))
            common.HASHES.trim()

    return docs.mapInArrow(common.in_worker("words", "blocks")(run), docs.schema)


# --- the shuffled join, for benchmarks of any size ---------------------------------------------------


def _key_of(column: str):
    """A name of a text, by its contents (256 bits)."""
    return F.unhex(F.sha2(F.coalesce(F.col(column), F.lit("")), 256))


def _keyed(docs: DataFrame, name: str) -> DataFrame:
    return docs.withColumn(name, _key_of("text"))


def _joined(docs: DataFrame, items: DataFrame, seed: int, percent: int) -> DataFrame:
    """(t, item, item_words, ...): the names of texts and of items that they contain, each pair once. Stored."""
    spark = docs.sparkSession
    items = common.stored(items.select("text").distinct().select("text", _key_of("text").alias("item")))

    def windows_of(text: str, lengths) -> np.ndarray:
        h = common.word_hashes(common.words_of(text))
        return np.concatenate([common.windows(h, k) for k in lengths if len(h) >= k] or [np.zeros(0, np.uint64)])

    def seeds(batches):
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n = len(common.words_of(text))
                if n:
                    s, c = np.unique(windows_of(text, [min(n, seed)]), return_counts=True)
                    rows += [(x, item, y, n) for x, y in zip(s.view(np.int64).tolist(), c.tolist())]
            common.HASHES.trim()
            yield from common.batches(iter(rows), pa.schema([("s", pa.int64()), ("item", pa.binary()), ("c", pa.int64()), ("n", pa.int64())]), 20_000)

    of_items = common.stored(items.select("item", "text").mapInArrow(common.in_worker("words", "blocks")(seeds), "s long, item binary, c long, n long"))
    lengths = sorted(min(r["n"], seed) for r in of_items.select(F.least("n", F.lit(seed)).alias("n")).distinct().collect())  # seed numbers at most
    size = 1 << WIDE_LOOK
    word = F.shiftright(F.col("s").bitwiseAND(F.lit(size - 1)), 6)
    bits = of_items.groupBy(word.alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(s & 63 AS INT))")).alias("b")).collect()  # size / 64 rows at most
    look = np.zeros(size // 64, np.int64)
    look[[r["w"] for r in bits]] = [r["b"] for r in bits]
    sent = spark.sparkContext.broadcast(look)

    def meet(batches):
        table = sent.value.view(np.uint64)
        for batch in batches:
            rows = []
            for t, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = np.unique(windows_of(text, lengths)) if text else np.zeros(0, np.uint64)
                s = s[(table[((s & np.uint64(size - 1)) >> np.uint64(6)).astype(np.int64)] >> (s & np.uint64(63))) & np.uint64(1) == 1]
                rows += [(x, t) for x in s.view(np.int64).tolist()]
            common.HASHES.trim()
            yield from common.batches(iter(rows), pa.schema([("s", pa.int64()), ("t", pa.binary())]), 20_000)

    keyed = _keyed(docs, "t")
    shared = keyed.select("t", "text").mapInArrow(common.in_worker("words", "blocks")(meet), "s long, t binary").distinct().join(of_items, "s")
    # Every seed that is met covers `seed` words of the item at most, at each of its places.
    pairs = shared.groupBy("t", "item").agg(F.sum("c").alias("c"), F.first("n").alias("n")).where(f"100 * c * {seed} >= {percent} * n").select("t", "item")
    pairs = common.stored(pairs)
    wanted = common.stored(pairs.select("t").distinct())
    texts, _ = common.split_by_bitmap(keyed.select("t", "text"), F.col("t"), wanted, F.col("t"))
    whole = texts.join(wanted, "t", "left_semi").dropDuplicates(["t"])

    def tile(batches):
        schema = pa.schema([("t", pa.binary()), ("item", pa.binary()), ("item_words", pa.int64()), ("marked_words", pa.int64()), ("n_tiles", pa.int64()), ("tiles", _TILE)])
        for batch in batches:
            t, item, text, of_item = (batch.column(i).to_pylist() for i in range(4))
            rows = []
            for a, b, x, y in zip(t, item, text, of_item):
                if found := compared(common.word_hashes(common.words_of(y)), common.word_hashes(common.words_of(x)), seed, percent):
                    rows.append((a, b, *found[:3], _cells(found[3])))
            common.HASHES.trim()
            yield from common.batches(iter(rows), schema)

    met = pairs.join(whole, "t").join(items.withColumnRenamed("text", "of_item"), "item").select("t", "item", "text", "of_item")
    return common.stored(met.mapInArrow(common.in_worker("words", "blocks")(tile), f"t binary, item binary, {_FOUND}"))
