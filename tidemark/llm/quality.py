"""Quality rules with compression bands (operator 5).

The base counts come first; a text that passes them is compressed with zstandard, whole and in chunks
of a fixed size, and is rejected where a ratio (compressed bytes to bytes) leaves the band for its
length: below it the text repeats itself, above it it looks like noise. Chunks catch a text that is bad
in many of its parts though its whole ratio is ordinary.

The band of each length is fitted on the ratios of documents that are labelled good: a curve over the
logarithm of the length, and its spread; LOW_SIGMAS below it and HIGH_SIGMAS above it are the limits,
for whole texts and for chunks alike, as a chunk is a text of its length. At most SAMPLE labelled
documents are read for it, those with the least hash of doc_id (a bound on memory; every one can be among
them). Beyond the lengths that they have, and where fewer than FEWEST_SAMPLE are labelled, wide general
bands hold (BANDS, and for chunks CHUNK_LOW and NOISE).

A null text has no words and fails the base; an empty or blank one too. Repeated rows give repeated
results. Whole texts are judged, however long. A chunk is CHUNK bytes; for shorter texts half of that, and
half again, so that they have FEWEST_CHUNKS, but no less than LEAST_CHUNK; a shorter text is one chunk.
The last chunk is what is left, and is judged too; less than LEAST_LAST bytes go with the chunk before.
Under about 256 bytes noise and prose are too close to be told apart. kept is never null. Columns of docs
other than doc_id and text are not read by judged(), and pass through filtered() under any name.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LEVEL = 3
#: Bytes of a chunk, and of the least one; chunks of a text that is long enough; bytes of the least last chunk.
CHUNK, LEAST_CHUNK, FEWEST_CHUNKS, LEAST_LAST = 4096, 512, 4, 256
#: Lengths (bytes) at which the next band begins, and each band's least and greatest whole ratio.
#: Short texts compress little, so their bands lie high; long ones have seen their words before.
BAND_FROM = (0, 256, 512, 1024, 2048, 4096, 8192, 32768)
BANDS = ((0.30, 1.20), (0.30, 0.92), (0.33, 0.85), (0.30, 0.80), (0.28, 0.75), (0.26, 0.72), (0.24, 0.70), (0.20, 0.70))
#: The least ratio of a chunk; its greatest is NOISE[0] + NOISE[1] / bytes, which runs below words of random
#: letters and digits (0.737 + 50 / bytes as measured); and the share of chunks that may leave the band.
CHUNK_LOW = 0.20
NOISE = (0.66, 55)
CHUNKS_OUT = 0.25
#: Labelled documents that the bands are fitted on at most, and at least.
SAMPLE, FEWEST_SAMPLE = 4000, 200
#: Standard deviations (by the median of deviations) from the curve to the limits.
LOW_SIGMAS, HIGH_SIGMAS = 3.5, 5.0
#: Bends of the curve; documents that a spread is taken of, at least.
BENDS, SPREAD_OF = 8, 150
#: The base: fewest words, and the greatest percentage of words in repeated windows.
FEWEST_WORDS = 50
REPEAT_PERCENT = 50
WINDOW = 3
SYMBOLS = "#*$%&|<>"

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean,"
    " n_bytes long, whole_ratio double, n_chunks long, n_chunks_out long, kept boolean"
)


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, common.SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    dup = len(lines) - len(set(lines))
    repeat = 0
    if n >= WINDOW:
        grams = common.windows(common.word_hashes(words), WINDOW)
        order = np.argsort(grams, kind="stable")
        ranked = grams[order]
        same = ranked[1:] == ranked[:-1]
        if same.any():
            twice = np.zeros(len(grams) + 1, bool)
            twice[1:-1] |= same
            twice[:-2] |= same
            at = order[twice[:-1]]
            covered = np.zeros(n, bool)
            for i in range(WINDOW):
                covered[at + i] = True
            repeat = int(covered.sum())
    return n, chars, symbols, dup, repeat


def band(n_bytes: int) -> tuple[float, float]:
    return BANDS[bisect_right(BAND_FROM, n_bytes) - 1]


def chunks(n_bytes: int) -> list[int]:
    """Where the chunks of a text of so many bytes (some) begin, and its end."""
    size = CHUNK
    while size > LEAST_CHUNK and n_bytes < FEWEST_CHUNKS * size:
        size //= 2
    at = list(range(0, n_bytes, size))
    if len(at) > 1 and n_bytes - at[-1] < LEAST_LAST:
        at.pop()
    return [*at, n_bytes]


class Limits:
    """The band of each length: points (log2 of bytes, least ratio, greatest ratio), straight lines between them."""

    def __init__(self, points: list[tuple[float, float, float]]):
        self.points = points
        self.x, self.low, self.high = map(np.array, zip(*points))

    def __call__(self, n_bytes: int) -> tuple[float, float] | None:
        """The least and greatest ratio of a text of so many bytes; None beyond the lengths that were seen."""
        x = np.log2(n_bytes)
        if not self.x[0] <= x <= self.x[-1]:
            return None
        return float(np.interp(x, self.x, self.low)), float(np.interp(x, self.x, self.high))


def fitted(sizes: list[int], ratios: list[float]) -> Limits | None:
    """Limits from the bytes and ratios of good texts; None if there are too few."""
    if len(sizes) < FEWEST_SAMPLE:
        return None
    order = np.argsort(sizes, kind="stable")
    x, y = np.log2(np.array(sizes, float)[order]), np.array(ratios)[order]
    bends = np.unique(np.quantile(x, np.linspace(0, 1, BENDS + 1)))[1:-1]
    terms = lambda at: np.stack([np.ones_like(at), at, *(np.maximum(0, at - k) for k in bends)], 1)
    a, weight = terms(x), np.ones(len(x))
    for _ in range(6):  # deviations beyond twice the spread count less each time
        curve = np.linalg.lstsq(a * weight[:, None], y * weight, rcond=None)[0]
        off = np.abs(y - a @ curve)
        weight = np.sqrt(np.minimum(1, 2 * 1.4826 * max(np.median(off), 1e-6) / np.maximum(off, 1e-9)))
    rest, width = y - a @ curve, min(len(x), max(SPREAD_OF, len(x) // 16))
    at, spread = [], []
    for i in range(0, len(x) - width + 1, max(1, width // 2)):
        part = rest[i : i + width]
        at.append(x[i : i + width].mean())
        spread.append(1.4826 * np.median(np.abs(part - np.median(part))))
    grid = np.unique(np.r_[x[0], bends, at, x[-1]])
    middle, sigma = terms(grid) @ curve, np.interp(grid, at, spread)
    return Limits([(float(g), float(m - LOW_SIGMAS * s), float(m + HIGH_SIGMAS * s)) for g, m, s in zip(grid, middle, sigma)])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Limits | None:
    """Limits from documents (doc_id, text) labelled good (labels: doc_id, quality) that pass the base. What reaches the driver is two numbers for each of at most sample ids."""
    common.prepare(docs.sparkSession)
    good = labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("_id")).where("_id IS NOT NULL").distinct()
    good = good.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), "text").join(F.broadcast(good), "_id")  # at most sample rows

    def run(batches):
        press = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = base_counts(text)
                if not base_fails(counts):
                    raw = text.encode("utf-8", "surrogatepass")
                    rows.append((i, len(raw), len(press.compress(raw)) / len(raw)))
            common.HASHES.trim()
            yield from common.batches(iter(rows), pa.schema([("_id", pa.int64()), ("size", pa.int64()), ("ratio", pa.float64())]))

    found = texts.mapInArrow(common.in_worker("words")(run), "_id long, size long, ratio double").groupBy("_id").agg(F.min(F.struct("size", "ratio")).alias("x")).select("_id", "x.*")
    rows = sorted(map(tuple, found.collect()))
    return fitted([r[1] for r in rows], [r[2] for r in rows])


def ratios(raw: bytes, press: zstandard.ZstdCompressor, limits: Limits | None = None) -> tuple[float | None, int, int]:
    """The whole ratio, the number of chunks, and how many of them leave the chunk band."""
    if not raw:
        return None, 0, 0
    size = len(press.compress(raw))
    at = chunks(len(raw))
    if len(at) == 2:
        sizes = [size]
    else:
        sizes = [len(press.compress(raw[a:b])) for a, b in zip(at, at[1:])]
    out = 0
    for x, n in zip(sizes, (b - a for a, b in zip(at, at[1:]))):
        low, high = (limits and limits(n)) or (CHUNK_LOW, NOISE[0] + NOISE[1] / n)
        out += not low * n <= x <= high * n
    return size / len(raw), len(sizes), out


def base_fails(counts: tuple[int, int, int, int, int]) -> bool:
    return counts[0] < FEWEST_WORDS or 100 * counts[4] > REPEAT_PERCENT * counts[0]


def judge(text: str | None, press: zstandard.ZstdCompressor, limits: Limits | None = None) -> tuple:
    counts = base_counts(text)
    failed = base_fails(counts)
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    whole, n, out = ratios(raw, press, limits)
    low, high = (raw and limits and limits(len(raw))) or band(len(raw))
    kept = not failed and whole is not None and low <= whole <= high and out <= CHUNKS_OUT * n
    return (*counts, failed, len(raw), whole, n, out, kept)


def judged(docs: DataFrame, limits: Limits | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep, then SCHEMA, for every row of docs (which needs a text). limits: from fit(); None: the general bands."""
    common.prepare(docs.sparkSession)
    rows = docs.select(*keep, "text")
    fields = [f for f in rows.schema.fields if f.name in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", " + SCHEMA

    def run(batches):
        press = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            found = list(zip(*(judge(t, press, limits) for t in common.texts_of(batch)))) or [()] * 11
            common.HASHES.trim()
            types = [pa.int64()] * 5 + [pa.bool_(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.bool_()]
            names = [x.split()[0] for x in SCHEMA.split(",")]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + [pa.array(c, t) for c, t in zip(found, types)], names=[*keep, *names])

    return rows.mapInArrow(common.in_worker("words")(run), schema)


def filtered(docs: DataFrame, limits: Limits | None = None) -> DataFrame:
    """The rows of docs that the rules keep, with docs' columns. One pass, no shuffle.

    The verdicts travel beside every column of docs, so a column named like a count does no harm.
    """
    common.prepare(docs.sparkSession)

    def run(batches):
        press = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            yield batch.filter(pa.array([judge(t, press, limits)[-1] for t in common.texts_of(batch)], pa.bool_()))
            common.HASHES.trim()

    return docs.mapInArrow(common.in_worker("words")(run), docs.schema)
