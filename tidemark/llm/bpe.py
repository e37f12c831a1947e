"""Byte-level BPE encoding and decoding (operator 1).

Texts are cut at single spaces into chunks, and each distinct chunk is encoded once: its pattern
matches become rows of padded matrices, one matrix for each range of lengths. In every round each row
merges its leftmost pair of least rank, looked up in a hash table of token pairs, and the merged
position is closed up; rows with no pair left leave the matrix.

Null texts count as empty: no ids, and the decoded bytes are empty. Repeated rows give repeated
results; other columns of the input are not read, so clashing names do no harm. The vocabulary is a
parameter; the driver reads it and broadcasts it (its size is fixed, under a megabyte here).
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Pieces longer than this many bytes are merged with a heap instead of in a matrix.
LONGEST_ROW = 512
#: Cells of a matrix.
CELLS = 4_000_000
#: Chunks a worker remembers, and their characters in all.
REMEMBERED, REMEMBERED_CHARS = 200_000, 20_000_000
#: No pair.
NONE = np.int32(2**31 - 1)
#: Unicode white space, as the tiktoken library's patterns know it.
BLANK = r"\t-\r \x85\xa0  -     　"
#: Where a cut at a space could change the matches: a space between white space, or after it at the end.
RUN = re.compile(r"[\s\x85] (?:[\s\x85]|\Z)")


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a tiktoken file: a token in base64 and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PairTable:
    """(left id, right id) -> rank of the joined token: open addressing with linear steps."""

    def __init__(self, ranks: dict[bytes, int]):
        left, right, out = [], [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    out.append(rank)
        keys = (np.array(left, np.uint64) << np.uint64(32)) | np.array(right, np.uint64)
        bits = max(4, int(4 * max(1, len(keys))).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.ranks = np.full(1 << bits, 2**64 - 1, np.uint64), np.full(1 << bits, NONE, np.int32)
        todo, at, self.steps = np.arange(len(keys)), self._home(keys), 0
        values = np.array(out, np.int32)
        while len(todo):
            free = self.keys[at] == 2**64 - 1
            slots, first = np.unique(np.where(free, at, -1), return_index=True)
            won = first[slots >= 0]
            self.keys[at[won]], self.ranks[at[won]] = keys[todo[won]], values[todo[won]]
            stay = np.ones(len(todo), bool)
            stay[won] = False
            todo, at = todo[stay], (at[stay] + 1) & self.mask
            self.steps += 1

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs of ids; NONE for those that don't join and where an id is negative."""
        keys = (left.astype(np.int64).view(np.uint64) << np.uint64(32)) | (right.astype(np.int64).view(np.uint64) & np.uint64(0xFFFFFFFF))
        at = self._home(keys)
        found = np.where(self.keys[at] == keys, self.ranks[at], NONE)
        open_ = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] != np.uint64(2**64 - 1)))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            here = self.keys[at[open_]]
            hit = here == keys[open_]
            found[open_[hit]] = self.ranks[at[open_[hit]]]
            open_ = open_[~hit & (here != np.uint64(2**64 - 1))]
        found[(left < 0) | (right < 0)] = NONE
        return found


class Codec:
    """Encodes and decodes whole texts with one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern.replace(r"[^\s", "[^" + BLANK).replace(r"\S", f"[^{BLANK}]").replace(r"\s", f"[{BLANK}]"))
        self.pairs = PairTable(ranks)
        self.bytes_id = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.seen: dict[str, bytes] = {}
        self.seen_chars = 0

    # -- merging

    def _matrix(self, pieces: list[bytes], width: int) -> list[bytes]:
        out: list[bytes] = [b""] * len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = np.full((len(pieces), width), -1, np.int32)
        ids[np.arange(width) < lengths[:, None]] = self.bytes_id[np.frombuffer(b"".join(pieces), np.uint8)]
        rank = self.pairs.look(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(pieces), width - 1)
        row = np.arange(len(pieces))

        def hand_out(done: np.ndarray, rows: np.ndarray) -> None:
            real = done >= 0
            flat, ends = done[real].astype("<u4").tobytes(), (4 * np.cumsum(real.sum(1))).tolist()
            begin = 0
            for i, end in zip(rows.tolist(), ends):
                out[i] = flat[begin:end]
                begin = end

        while len(row):
            at = rank.argmin(1)
            best = rank[np.arange(len(row)), at]
            go = best != NONE
            hand_out(ids[~go], row[~go])
            row, at, best, ids, rank = row[go], at[go], best[go], ids[go], rank[go]
            if not len(row):
                break
            each, width = np.arange(len(row)), ids.shape[1]
            ids[each, at] = best
            ids = np.take_along_axis(ids, (c := np.arange(width - 1)) + (c > at[:, None]), 1)
            if width == 2:
                hand_out(ids, row)
                break
            rank = np.take_along_axis(rank, (c := np.arange(width - 2)) + (c >= at[:, None]), 1)
            inner = at > 0
            rank[each[inner], at[inner] - 1] = self.pairs.look(ids[each[inner], at[inner] - 1], ids[each[inner], at[inner]])
            inner = at < width - 2
            rank[each[inner], at[inner]] = self.pairs.look(ids[each[inner], at[inner]], ids[each[inner], at[inner] + 1])
        return out

    def _long(self, piece: bytes) -> bytes:
        """The same merges for one very long piece: a heap of (rank, position) over a linked list."""
        ids = self.bytes_id[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        found = self.pairs.look(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32)).tolist()
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(found) if r != NONE]
        heapq.heapify(heap)
        tokens, ranks = self.tokens, self.ranks
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = r, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] < n and (s := ranks.get(tokens[ids[x]] + tokens[ids[after[x]]])) is not None:
                    heapq.heappush(heap, (s, x, ids[x], ids[after[x]]))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def pieces(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """The ids of distinct pieces, as little-endian unsigned 32-bit integers."""
        out: dict[bytes, bytes] = {}
        rest: dict[int, list[bytes]] = {}
        for p in pieces:
            if (r := self.ranks.get(p)) is not None:
                out[p] = r.to_bytes(4, "little")
            elif len(p) > LONGEST_ROW:
                out[p] = self._long(p)
            else:
                rest.setdefault(max(4, 1 << (len(p) - 1).bit_length()), []).append(p)
        for width, group in rest.items():
            step = max(1, CELLS // width)
            for i in range(0, len(group), step):
                out.update(zip(group[i : i + step], self._matrix(group[i : i + step], width)))
        return out

    # -- texts

    def _learn(self, chunks: set[str]) -> None:
        findall = self.pattern.findall
        split = {c: (c,) if c.isascii() and c[1:].isalpha() and (c[0] == " " or c[0].isalpha()) else findall(c) for c in chunks}
        known = {p: p.encode("utf-8", "surrogatepass") for parts in split.values() for p in parts}
        ids = self.pieces(list(set(known.values())))
        self.seen_chars += sum(map(len, split))
        for c, parts in split.items():
            self.seen[c] = ids[known[parts[0]]] if len(parts) == 1 else b"".join([ids[known[p]] for p in parts])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, packed; a null is empty."""
        if len(self.seen) > REMEMBERED or self.seen_chars > REMEMBERED_CHARS:
            self.seen.clear()
            self.seen_chars = 0
        cut = []
        for text in texts:
            if not text:
                cut.append([])
            elif RUN.search(text):  # white space in runs: the pattern sees the text whole
                cut.append(self.pattern.findall(text))
            else:
                parts = text.split(" ")
                cut.append(([parts[0]] if parts[0] else []) + [" " + p for p in parts[1:]])
        seen = self.seen
        if new := {c for parts in cut for c in parts if c not in seen}:
            self._learn(new)
        get = seen.__getitem__
        return [b"".join(map(get, parts)) for parts in cut]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_CODECS: dict[str, Codec] = {}
common.CACHES["codecs"] = _CODECS


def codec(vocabulary) -> Codec:
    """The codec of a broadcast (key, ranks, pattern), made once in each worker."""
    key, ranks, pattern = vocabulary.value
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(ranks, pattern)
    return _CODECS[key]


def vocabulary(spark, path: str, pattern: str):
    """A broadcast of the vocabulary in a file of the driver; its size is that of the file."""
    ranks = load_ranks(path)
    key = hashlib.sha256(repr((sorted(ranks.items()), pattern)).encode()).hexdigest()
    return spark.sparkContext.broadcast((key, ranks, pattern))


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """docs with n_tokens (long) and ids (array of int). Columns of these names are replaced."""
    common.prepare(docs.sparkSession)
    voc = vocabulary(docs.sparkSession, path, pattern)

    @F.pandas_udf("array<int>")
    def ids_of(texts):
        return texts.__class__([np.frombuffer(x, "<u4").astype(np.int32) for x in codec(voc).encode([t if isinstance(t, str) else None for t in texts])])

    return docs.withColumn("ids", ids_of(F.col(text))).withColumn("n_tokens", F.size("ids").cast("long"))


def decode(rows: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """rows with decoded (binary), the bytes of the ids; a null list of ids is empty."""
    common.prepare(rows.sparkSession)
    voc = vocabulary(rows.sparkSession, path, pattern)

    @F.pandas_udf("binary")
    def bytes_of(lists):
        c = codec(voc)
        return lists.__class__([b"" if x is None else b"".join([c.tokens[i] for i in x]) for x in lists])

    return rows.withColumn("decoded", bytes_of(F.col(ids)))


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: encoded, then decoded from the ids, in one pass."""
    common.prepare(docs.sparkSession)
    voc = vocabulary(docs.sparkSession, path, pattern)

    def run(batches):
        c = codec(voc)
        for batch in batches:
            packed = c.encode(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x) // 4 for x in packed], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in packed], pa.string()),
                    pa.array([hashlib.sha256(c.decode(x)).hexdigest() for x in packed], pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(common.in_worker("codecs")(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
