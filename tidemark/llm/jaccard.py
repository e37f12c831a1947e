"""N-gram Jaccard self-join, size-aware, with light and heavy sets and lists (operator 8).

Every document becomes the set of its distinct word shingles; equal sets are one node. Two nodes link
when 100 * intersection >= PERCENT * union. For sizes n <= m that needs an overlap of
need(n, m) = ceil(PERCENT (n + m) / (100 + PERCENT)), and n >= PERCENT/100 * m.

Small sets (at most `boundary` shingles) are joined by enumeration: for each size a partner can have,
a set puts forth a key for each of its subsets of exactly need(n, m) shingles. Two sets share a key of
(n, m) if and only if they link, so that the sets of a key are linked to its smallest set of size n,
and no pairs are made; the members of sets that small are kept from the first pass. Large sets are joined by inverted lists over the part of each set that any
partner must meet: its first n - need_least(n) + 1 shingles, rarest first. The boundary is where the
cost of the subsets begins to exceed the cost of the lists, from the counts of sizes and from the mean
list length of a sketch over all shingles.

The sketch (2**SKETCH_BITS counters over all documents) also orders shingles by rarity. An inverted
list as long as its counter allows, LIGHT at most, is light and meets in one task. A longer list is
dealt out by salt into parts of about LIGHT members, and the parts are tied by their first members.
Lists are shuffled and sorted by the JVM, which spills; Python holds one batch of texts.

Lists give links in two steps, neither of which makes all pairs of a group of copies. First each set is
checked against TRIES sets: of those that stand before it in its lists (each in an order of its own), the ones that do
so most often; and connected components are formed. Then all pairs across components in one list that pass
the size and the position filter are checked; a long list is dealt into blocks, and pairs of blocks into tasks. A pair within one component needs no check, as components
are the result; nothing else is passed over, so the components are those of all links.

A check compares parity bitmaps of about n bits first (the distance of two bitmaps never exceeds the
symmetric difference of the sets) and then the whole sets. The last step compares parity bitmaps of a
fixed width as it joins, so that pairs of sets that are clearly apart aren't written.

Shingles are 64-bit hashes of words, sets are named by 64-bit hashes of all their shingles.

Null, empty and blank texts have no shingles, n_shingles 0, and are linked with nothing: component_id
is their own doc_id. A text with fewer words than a shingle is one shingle, the whole sequence.
Repeated rows (one doc_id, one text) each come back, with one component. A null doc_id stays null, and
passes on no name: its component is the least doc_id among the others, if any. Only doc_id and text
are read.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import comb
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import common

SKETCH_BITS = 23
#: Counters of a chunk of the sketch.
CHUNK_BITS = 16
#: Longest list that meets in one task.
LIGHT = 4096
#: Largest size for which subsets are considered at all.
MOST_ENUMERATED = 16
#: Postings of an Arrow batch, and names of sets that a task remembers to have sent.
POSTINGS, REMEMBERED = 100_000, 200_000
#: Members of a block of a list, when pairs across components are looked for.
BLOCK = 1024
#: Partners that a set is tried with first; the last step leaves none out.
TRIES = 16

#: Words of 64 bits of the bitmaps that the last step joins by: they tell sets of up to about 100 * SIGNATURE members apart.
SIGNATURE = 8

_SALT = np.uint64(0x9FB21C651E98DF25)


# --- sizes -----------------------------------------------------------------------------------------


def need(n, m, percent: int = common.PERCENT):
    """The least overlap of linked sets of n and m members."""
    return -((-percent * (n + m)) // (100 + percent))


def fits(n, m, percent: int = common.PERCENT):
    """Whether sets of n and m members can link at all."""
    return (100 * n >= percent * m) & (100 * m >= percent * n)


def prefix_length(n, percent: int = common.PERCENT):
    """So many first shingles of a set of n meet those of every partner."""
    return n + (-percent * n) // 100 + 1


def partner_sizes(n: int, percent: int = common.PERCENT) -> range:
    return range(-((-percent * n) // 100), 100 * n // percent + 1)


def subset_keys(n: int, most: int, percent: int = common.PERCENT) -> int:
    """Keys that enumeration makes for a set of n members."""
    return sum(comb(n, need(n, m, percent)) for m in partner_sizes(n, percent) if m <= most)


def boundary(counts: dict[int, int], list_length: float, percent: int = common.PERCENT) -> int:
    """The size up to which subsets cost less than lists. counts: sets by size."""

    def cost(x: int) -> float:
        light = sum(c * subset_keys(n, x, percent) for n, c in counts.items() if n <= x)
        heavy = sum(c * prefix_length(n, percent) * (1 + list_length) for n, c in counts.items() if 100 * n > percent * x)
        return light + heavy

    return min(range(MOST_ENUMERATED + 1), key=lambda x: (cost(x), -x))


# --- passes over the texts ---------------------------------------------------------------------------


def _name(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63


def bitmap(s: np.ndarray) -> np.ndarray:
    """Parity of the members at each of about len(s) bits, as bytes."""
    bits = max(64, 1 << (len(s) - 1).bit_length())
    at = (s >> np.uint64(20)) & np.uint64(bits - 1)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=bits) & 1)


def signature(s: np.ndarray) -> list[int]:
    """Parity of the members at each of 64 * SIGNATURE bits, as signed words."""
    at = (s >> np.uint64(20)) % np.uint64(64 * SIGNATURE)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=64 * SIGNATURE) & 1).view(np.int64).tolist()


def apart(a: np.ndarray, b: np.ndarray) -> int:
    """A lower bound of the symmetric difference of the sets of two bitmaps."""
    if len(a) < len(b):
        a, b = b, a
    while len(a) > len(b):  # the high half of the bit numbers falls onto the low half
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _survey(docs: DataFrame, k: int) -> DataFrame:
    """A row for each document (doc_id, n, sid, bits, sig, and the members of a set of at most MOST_ENUMERATED), and the partial sketches (chunk, counters)."""
    size = 1 << SKETCH_BITS

    def run(batches):
        sketch, press = np.zeros(size, np.int32), zstandard.ZstdCompressor(level=1)
        mask, seen = np.uint64(size - 1), False
        for batch in batches:
            rows, all_sets = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = common.shingle_set(text, k)
                if len(s):
                    all_sets.append(s)
                    members = s.view(np.int64).tolist() if len(s) <= MOST_ENUMERATED else None
                    rows.append((i, len(s), _name(s), bitmap(s).tobytes(), signature(s), members, None, None))
                else:
                    rows.append((i, 0, None, None, None, None, None, None))
            common.HASHES.trim()
            if all_sets:
                seen = True
                at, c = np.unique((np.concatenate(all_sets) & mask).astype(np.int64), return_counts=True)
                sketch[at] += c.astype(np.int32)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=names)
        if seen:
            step = 1 << CHUNK_BITS
            for c in range(size // step):
                blob = press.compress(sketch[c * step : (c + 1) * step].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((None, None, None, None, None, None, c, blob), types)], names=names)

    names = ["doc_id", "n", "sid", "bits", "sig", "members", "chunk", "counters"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.binary()]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(common.in_worker("words")(run), "doc_id long, n int, sid long, bits binary, sig array<long>, members array<long>, chunk int, counters binary")


def _sketch(survey: DataFrame) -> np.ndarray:
    """All counters (int64). What reaches the driver is 2**SKETCH_BITS counters, whatever the input."""
    step = 1 << CHUNK_BITS

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            for c, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(open_.decompress(blob, max_output_size=4 * step), np.int32)
                sums[c] = sums[c] + part if c in sums else part.astype(np.int64)
        press = zstandard.ZstdCompressor(level=1)
        for c, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([press.compress(x.tobytes())], pa.binary())], names=["chunk", "counters"])

    parts = survey.where("chunk IS NOT NULL").select("chunk", "counters").repartition(16, "chunk").mapInArrow(common.in_worker("words")(add), "chunk int, counters binary").collect()
    out, open_ = np.zeros(1 << SKETCH_BITS, np.int64), zstandard.ZstdDecompressor()
    for c, blob in parts:
        out[c * step : (c + 1) * step] = np.frombuffer(open_.decompress(blob), np.int64)
    return out


def _levels(sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each counter: its rank of rarity (0: ordinary), and the log2 of the parts its lists are dealt into."""
    mean = max(1.0, sketch.sum() / len(sketch))
    level = np.floor(np.log2(np.maximum(sketch, 1) / (2 * mean))).clip(0, 63).astype(np.uint8)
    salts = np.ceil(np.log2(np.maximum(sketch, 1) / LIGHT)).clip(0, 40).astype(np.uint8)
    return level, salts


def _postings(docs: DataFrame, levels, x: int, k: int, percent: int) -> DataFrame:
    """(h, part, sid, at): the first shingles of large sets, each set once a task. at holds n and the shingle's place."""
    mask = np.uint64((1 << SKETCH_BITS) - 1)
    names, types = ["h", "part", "sid", "at"], [pa.int64(), pa.int32(), pa.int64(), pa.int64()]

    def flush(held):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(zip(*held), types)], names=names)

    def run(batches):
        level, salts = levels.value
        done: set[int] = set()
        for batch in batches:
            held, rows = [], 0
            for text in batch.column(0).to_pylist():
                s = common.shingle_set(text, k)
                n = len(s)
                if 100 * n <= percent * x or (sid := _name(s)) in done:
                    continue
                done.add(sid)
                at = (s & mask).astype(np.int64)
                rank = level[at]
                first = np.argsort(rank, kind="stable")[: prefix_length(n, percent)] if rank.any() else np.arange(prefix_length(n, percent))
                dealt = salts[at[first]]
                part = np.zeros(len(first), np.int32)
                if dealt.any():
                    part = ((np.array([sid + 2**63], np.uint64) * _SALT) >> (np.uint64(64) - dealt.astype(np.uint64).clip(1))).astype(np.int32) * (dealt > 0)
                    part += dealt > 0  # 0: the list is whole
                held.append((s[first].view(np.int64), part, np.full(len(first), sid, np.int64), np.arange(len(first)) + (n << 32)))
                rows += len(first)
                if rows > POSTINGS:
                    yield flush(held)
                    held, rows = [], 0
            common.HASHES.trim()
            if len(done) > REMEMBERED:
                done.clear()
            if held:
                yield flush(held)

    return docs.select("text").mapInArrow(common.in_worker("words")(run), "h long, part int, sid long, at long")


def _lists(postings: DataFrame, percent: int) -> DataFrame:
    """The members of lists of two sets or more, each with the one before it. Lists are sorted in the JVM, which spills."""
    # Within a list the order is a hash of list and set, so that a set has other neighbours in each list.
    dealt = postings.repartition("h", "part").withColumn("o", F.xxhash64("sid", "h"))
    order = Window.partitionBy("h", "part").orderBy("o", "sid")
    ends = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = dealt.select("h", "part", "sid", "at", F.lag("sid").over(order).alias("before"), F.lag("at").over(order).alias("m"), (F.first("sid").over(ends) != F.last("sid").over(ends)).alias("several"))
    # Copies of a set from several tasks stand side by side; the first one counts.
    seen = seen.where("(several OR part > 0) AND NOT (before <=> sid)")
    n, m = F.shiftright("at", 32), F.shiftright("m", 32)
    near = (100 * n >= percent * m) & (100 * m >= percent * n)
    return seen.select("h", "part", "sid", n.cast("int").alias("n"), F.col("at").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias("pos"), F.when(near, F.col("before")).alias("before"), F.col("before").isNull().alias("leads"))


def _keys(nodes: DataFrame, x: int, percent: int) -> DataFrame:
    """(key, sid, n, low): the subset keys of the sets of at most x shingles, by their members. How long a text is says nothing of its set: words may repeat."""

    def run(batches):
        for batch in batches:
            rows = []
            for sid, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = np.array(members, np.int64).view(np.uint64).tolist()
                n = len(s)
                for m in partner_sizes(n, percent):
                    if m <= x:
                        salt = (min(n, m) * 256 + max(n, m)).to_bytes(4, "little")
                        rows += [(xxhash.xxh3_64_intdigest(salt + np.array(c, np.uint64).tobytes()) - 2**63, sid, n, min(n, m)) for c in combinations(s, need(n, m, percent))]
            yield from common.batches(iter(rows), schema, 20_000)

    schema = pa.schema([("key", pa.int64()), ("sid", pa.int64()), ("n", pa.int32()), ("low", pa.int32())])
    return nodes.where(F.col("n") <= x).select("sid", "members").mapInArrow(common.in_worker("words")(run), "key long, sid long, n int, low int")


# --- checks ------------------------------------------------------------------------------------------


def _checked(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (u, v) of names of sets that link: bitmaps first, then whole sets of those that are left."""

    def near(batches):
        for batch in batches:
            u, v, n, m, a, b = (batch.column(i).to_pylist() for i in range(6))
            ok = [apart(np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)) <= i + j - 2 * need(i, j, percent) for i, j, x, y in zip(n, m, a, b)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(ok, pa.bool_()))

    left, right = (nodes.select(F.col("sid").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}")) for c in "uv")
    some = stored_if_any(pairs.join(left, "u").join(right, "v").select("u", "v", "n_u", "n_v", "bits_u", "bits_v").mapInArrow(common.in_worker("words")(near), "u long, v long"))
    if some is None:
        return pairs.select("u", "v").limit(0)
    wanted = stored(some.select(F.col("u").alias("sid")).union(some.select("v")).distinct())

    def sets(batches):
        for batch in batches:
            found = [(_name(s), s.tobytes()) for s in (common.shingle_set(t, k) for t in batch.column(0).to_pylist()) if len(s)]
            common.HASHES.trim()
            yield from common.batches(iter(found), schema, 100)

    schema = pa.schema([("sid", pa.int64()), ("members", pa.binary())])
    # Texts stay where they are: a bitmap of fixed size says which may hold a set that is wanted.
    ids = nodes.join(wanted, "sid").select("doc_id")
    texts, _ = common.split_by_bitmap(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), F.col("doc_id"), ids, F.col("doc_id"))
    found, _ = common.split_by_bitmap(texts.select("text").mapInArrow(common.in_worker("words")(sets), "sid long, members binary"), F.col("sid"), wanted, F.col("sid"))
    whole = stored(found.join(wanted, "sid", "left_semi").dropDuplicates(["sid"]))

    def link(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(a) + len(b) - len(np.union1d(a, b))
                ok.append(100 * both >= percent * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(ok, pa.bool_()))

    left, right = (whole.select(F.col("sid").alias(c), F.col("members").alias(f"s_{c}")) for c in "uv")
    links = stored(some.join(left, "u").join(right, "v").select("u", "v", "s_u", "s_v").mapInArrow(common.in_worker("words")(link), "u long, v long"))
    common.discard(whole, some, wanted)
    return links


stored, discard = common.stored, common.discard


def stored_if_any(df: DataFrame) -> DataFrame | None:
    out = common.stored(df)
    return None if out.isEmpty() else out


def _across(members: DataFrame, of: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of sets of different components that share a list and pass the size, the position and the bitmap filter.

    Lists that lie within one component make no pairs. The members of a list are dealt into blocks of about
    BLOCK, and each pair of blocks meets by a key of its own, so that no list gathers in one task.
    """
    placed = members.select("h", "sid", "n", "pos").join(of, "sid", "left").withColumn("of", F.coalesce("of", "sid"))
    placed = stored(placed)
    mixed = common.with_groups(placed, ["h"], F.min("of").alias("least"), F.max("of").alias("most"), F.count("*").alias("c"), where="least <> most")
    left = mixed.join(nodes.select("sid", "sig"), "sid").withColumn("blocks", F.ceil(F.col("c") / BLOCK).cast("int"))
    left = left.withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j")))
    left = stored(left.select("h", "sid", "n", "pos", "of", "sig", "block", F.explode(cells).alias("x")).select("*", F.col("x.i").alias("i"), F.col("x.j").alias("j")).drop("x"))
    a, b = left.alias("a"), left.alias("b")
    # The first shingle that two linked sets have in common lies early enough in both for the overlap to be had.
    early = F.least(F.col("a.n") - F.col("a.pos"), F.col("b.n") - F.col("b.pos")) * (100 + percent) >= percent * (F.col("a.n") + F.col("b.n"))
    fit = (F.col("a.n") * 100 >= F.col("b.n") * percent) & (F.col("b.n") * 100 >= F.col("a.n") * percent)
    both = F.col("a.n") + F.col("b.n")
    bits = reduce(add, (F.bit_count(F.col("a.sig")[i].bitwiseXOR(F.col("b.sig")[i])) for i in range(SIGNATURE)))
    alike = bits <= both - 2 * F.ceil(both * percent / (100 + percent))
    meet = (F.col("a.h") == F.col("b.h")) & (F.col("a.i") == F.col("b.i")) & (F.col("a.j") == F.col("b.j"))
    once = (F.col("a.block") != F.col("b.block")) | (F.col("a.i") == F.col("a.j"))  # a pair of one block meets on the diagonal
    found = a.join(b, meet & once & (F.col("a.of") < F.col("b.of")) & fit & early & alike)
    out = stored(found.select(F.least("a.sid", "b.sid").alias("u"), F.greatest("a.sid", "b.sid").alias("v")).distinct())
    discard(placed, left)
    return out


# --- the operator ------------------------------------------------------------------------------------


def similar(docs: DataFrame, k: int = common.SHINGLE, percent: int = common.PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id integer, text)."""
    return _named(docs, k, percent).drop("sid")


def _named(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """What similar() gives, and sid, the name of the row's set (null without shingles)."""
    spark = docs.sparkSession
    common.prepare(spark)
    survey = stored(_survey(docs, k))
    rows = survey.where("chunk IS NULL").select("doc_id", "n", "sid")
    whole = survey.where("sid IS NOT NULL")
    nodes = stored(whole.groupBy("sid").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), *(F.first(c).alias(c) for c in ("bits", "sig", "members"))))
    sketch = _sketch(survey)
    level, salts = _levels(sketch)
    sizes = {r["n"]: r["c"] for r in rows.where(f"n BETWEEN 1 AND {2 * MOST_ENUMERATED}").groupBy("n").agg(F.count("*").alias("c")).collect()}
    x = boundary(sizes, float((sketch.astype(float) ** 2).sum() / max(1, sketch.sum()) / 2), percent)
    levels = spark.sparkContext.broadcast((level, salts))
    members = stored(_lists(_postings(docs, levels, x, k, percent), percent))
    ordered = lambda a, b: (F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))

    # Sets that share a key of subsets link with the smallest of the lower size among them.
    small = None
    if x:
        keyed = stored(_keys(nodes, x, percent))
        hubs = common.with_groups(keyed, ["key"], F.min(F.when(F.col("n") == F.col("low"), F.col("sid"))).alias("hub"), where="hub IS NOT NULL")
        small = stored(hubs.where("sid <> hub").select(*ordered("sid", "hub")).distinct())
        discard(keyed)

    # The parts of a list that is dealt out are tied by their first members, in the order of the parts.
    over = Window.partitionBy("h").orderBy("part")
    heads = members.where("part > 0 AND leads").select("h", "sid", "n", F.lag("sid").over(over).alias("before"), F.lag("n").over(over).alias("m"))
    heads = heads.where(f"before IS NOT NULL AND 100 * n >= {percent} * m AND 100 * m >= {percent} * n").select(*ordered("sid", "before"))
    # Of the members that stand before it in its lists, a set is tried with those that do so most often.
    rank = F.row_number().over(Window.partitionBy("sid").orderBy(F.desc("c"), "before"))  # at most a row for each list of a set
    often = members.where("before IS NOT NULL").groupBy("sid", "before").agg(F.count("*").alias("c")).withColumn("rank", rank).where(f"rank <= {TRIES}")
    tried = stored(often.select(*ordered("sid", "before")).unionByName(heads).where("u <> v").distinct())
    found = _checked(tried, nodes, docs, k, percent)
    links = stored(found.unionByName(small) if small is not None else found)

    of = stored(common.components(links).select(F.col("node").alias("sid"), F.col("component").alias("of")))
    pairs = _across(members, of, nodes, percent)
    across = stored_if_any(pairs.join(tried, ["u", "v"], "left_anti"))
    if across is not None and not (more := _checked(across, nodes, docs, k, percent)).isEmpty():
        of = stored(common.components(links.unionByName(more)).select(F.col("node").alias("sid"), F.col("component").alias("of")))
    discard(members, tried, across, pairs)

    # Equal sets are one node, and so linked, whether or not any other set is near.
    named = nodes.select("sid", "doc_id").join(of, "sid", "left").select("sid", "doc_id", F.coalesce("of", "sid").alias("of"))
    named = stored(named)
    by_set = common.with_groups(named, ["of"], F.min("doc_id").alias("component_id")).select("sid", "component_id")
    return _of_sets(rows, by_set)


def _of_sets(rows: DataFrame, by_set: DataFrame) -> DataFrame:
    """The result's rows: those of a set (of which there may be very many) with its component, those without a set with their own id.

    A heavy set's component is broadcast; so many sets are heavy at most as HEAVY.
    """
    by_set = stored(by_set)
    sets = rows.where("sid IS NOT NULL")
    total = sets.count()
    heavy = stored(sets.groupBy("sid").agg(F.count("*").alias("c")).where(F.col("c") * common.HEAVY > total).select("sid").join(by_set, "sid"))
    most = sets.join(F.broadcast(heavy.select("sid")), "sid", "left_anti").join(by_set, "sid")
    met = sets.join(F.broadcast(heavy), "sid").unionByName(most)
    none = rows.where("sid IS NULL").withColumn("component_id", F.col("doc_id"))
    return met.unionByName(none).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", "sid")


def one_of_each(docs: DataFrame, k: int = common.SHINGLE, percent: int = common.PERCENT) -> DataFrame:
    """The rows of docs that stay when of each component one document stays, that with the least doc_id.

    Rows are judged by doc_id and set: where a doc_id has several texts, or is null, each text stays or
    goes with its own component. Repeated rows of the least doc_id stay together; documents without words,
    and rows without a doc_id that link with no numbered document, all stay.
    """
    found = _named(docs, k, percent)
    goes = F.coalesce(F.col("doc_id") != F.col("component_id"), F.col("doc_id").isNull() & F.col("component_id").isNotNull())
    found = stored(found.select("doc_id", "sid", goes.alias("goes")))
    gone, one, sid = common.fresh(docs, "_gone", "_set", "_sid")
    key = F.col("doc_id").cast("long")
    # An id of which all rows go needs no set to go by; null never counts as one document.
    by_id = stored(found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("goes").alias("all"), F.max("goes").alias("any")).where("any"))
    whole = by_id.where("all").select(F.col("doc_id").alias(gone))
    some, safe = common.split_by_bitmap(docs, key, whole, F.col(gone))
    left = safe.unionByName(some.join(whole.hint("merge"), key == F.col(gone), "left_anti"))
    mixed = found.join(by_id.where("NOT all").select("doc_id"), "doc_id", "left_semi").unionByName(found.where("doc_id IS NULL"))
    part = stored_if_any(mixed.where("goes").select(F.col("doc_id").alias(gone), F.col("sid").alias(one)).distinct())
    if part is None:
        return left

    def name(batches):
        for batch in batches:
            sets = (common.shingle_set(t, k) for t in common.texts_of(batch))
            sids = pa.array([_name(x) if len(x) else None for x in sets], pa.int64())
            common.HASHES.trim()
            yield pa.RecordBatch.from_arrays([*batch.columns, sids], names=[*batch.schema.names, sid])

    some, safe = common.split_by_bitmap(left, key, part, F.col(gone))
    rows = some.mapInArrow(common.in_worker("words")(name), StructType([*some.schema.fields, StructField(sid, LongType())]))
    return safe.unionByName(rows.join(part, (F.col(sid) == F.col(one)) & key.eqNullSafe(F.col(gone)), "left_anti").drop(sid))
