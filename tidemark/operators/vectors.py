"""Vector search by clusters: a part of the vectors is read, scores are exact.

Vectors lie with the nearest of about sqrt(n) directions, which spherical k-means fits on a bounded sample; every
vector is assigned. A question reads the clusters nearest to it, as many as reach the asked-for recall on
questions of the sample, and scores their vectors by exact cosine. The exact scan is search.cosine().

Many questions go together (nearest): the driver holds a round of them, and each task scores its rows against all by
products of matrices and keeps the best of each question, so that a round reads the rows once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship, stored
from . import search

#: Vectors that directions are fitted on at most, those with the least hash of their key; directions; rounds; sample's questions.
SAMPLE, MOST_CLUSTERS, ROUNDS, QUESTIONS = 20_000, 2048, 12, 100
#: Questions of a round (the driver holds one round; there are as many as it takes); questions and rows of one product.
ROUND, TOGETHER, BLOCK = 32_768, 256, 8192
#: Similarities of many questions are whole numbers of such parts of 1: equal vectors are equal wherever they stand in a product.
PARTS = 1e9
#: Rows of a block that a question has at most, on the average, to sort them alone.
FEW = 64
_NONE = -(2**62)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-30)


def _matrix(column) -> np.ndarray:
    """An Arrow column of vectors of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.float32)


def rounds(asked: DataFrame, key: str, column: str) -> Iterator[np.ndarray]:
    """The vectors of all questions, in rounds of about ROUND."""
    held = stored(asked.where(F.col(column).isNotNull()).select(F.xxhash64(key).alias("h"), F.col(column).alias("vector")), "questions")
    n = -(-held.count() // ROUND)
    for i in range(n):
        some = held.where(F.pmod("h", F.lit(n)) == i).select("vector").toArrow().column(0).combine_chunks()
        for at in range(0, len(some), 2 * ROUND):  # more only where keys repeat
            yield _matrix(some.slice(at, 2 * ROUND))


def nearest(rows: DataFrame, asked: np.ndarray, top: int = 10, read: np.ndarray | None = None) -> DataFrame:
    """(question, doc, points): the best rows for each question by its number, by points (PARTS of similarity), the lower doc first.

    rows: (doc integer, vector), and cluster where `read` has the clusters that each question reads.
    """
    ship(rows.sparkSession)
    q = _unit(asked.astype(np.float64))
    lists = None
    if read is not None:  # the questions of each cluster, in one array
        order = np.argsort(read.ravel(), kind="stable")
        lists = ((order // read.shape[1]).astype(np.int32), np.searchsorted(read.ravel()[order], np.arange(read.max() + 2)))
    sent = rows.sparkSession.sparkContext.broadcast((q, lists))

    def run(batches):
        q, lists = sent.value
        points, docs = np.full((len(q), top), _NONE), np.full((len(q), top), np.iinfo(np.int64).max)
        all_, short = np.arange(len(q)), q.astype(np.float32)
        slack = q.shape[1] * 2.5e-7  # more than a product of unit vectors of floats may be off

        def meet(of, x, d):
            """The questions `of` and at most BLOCK rows in the order of their docs."""
            bad, rows = ~np.isfinite(x).all(1), x.astype(np.float32)
            for at in range(0, len(of), TOGETHER):
                some = of[at : at + TOGETHER]
                s = short[some] @ rows.T  # floats say which pairs may count; those are scored by doubles
                s[:, bad] = -2
                open_ = s >= ((points[some, -1] - 1) / PARTS - slack).astype(np.float32)[:, None]
                if not (n := np.count_nonzero(open_)):
                    continue
                if n > FEW * len(some):
                    some = some[open_.any(1)]
                    s = np.rint(q[some] @ x.T * PARTS)
                    s[:, bad] = -2 * PARTS
                    if len(d) > top:  # by points, then by place: whole numbers below 2**53
                        j = np.argpartition(np.arange(len(d)) - s * BLOCK, top - 1, axis=1)[:, :top]
                    else:
                        j = np.broadcast_to(np.arange(len(d)), s.shape)
                    p, k = np.take_along_axis(s, j, 1).astype(np.int64), d[j]
                else:
                    i, j = np.nonzero(open_)
                    r = np.where(bad[j], -2, np.einsum("ij,ij->i", q[some[i]], x[j]))
                    r = np.rint(r * PARTS).astype(np.int64)
                    order = np.lexsort((j, -r, i))
                    i, j, r = i[order], j[order], r[order]
                    rank = np.arange(len(i)) - np.searchsorted(i, i)
                    i, j, r, rank = (a[rank < top] for a in (i, j, r, rank))
                    p, k = np.full((len(some), top), _NONE), np.full((len(some), top), np.iinfo(np.int64).max)
                    p[i, rank], k[i, rank] = r, d[j]
                p, k = np.concatenate([points[some], p], 1), np.concatenate([docs[some], k], 1)
                best = np.lexsort((k, -p), axis=-1)[:, :top]
                points[some], docs[some] = np.take_along_axis(p, best, 1), np.take_along_axis(k, best, 1)

        for batch in batches:
            if not batch.num_rows:
                continue
            d, x = batch.column(0).to_numpy(zero_copy_only=False), _unit(_matrix(batch.column(1)).astype(np.float64))
            if lists is None:
                order, ends = np.argsort(d, kind="stable"), [0, len(d)]
            else:
                c = batch.column(2).to_numpy(zero_copy_only=False)
                order = np.lexsort((d, c))
                ends = [0, *(np.flatnonzero(np.diff(c[order])) + 1).tolist(), len(d)]
            for a, b in zip(ends, ends[1:]):
                of = all_
                if lists is not None:
                    cluster = int(c[order[a]])
                    of = lists[0][lists[1][cluster] : lists[1][cluster + 1]] if cluster + 1 < len(lists[1]) else all_[:0]
                for at in range(a, b, BLOCK):
                    some = order[at : min(b, at + BLOCK)]
                    meet(of, x[some], d[some])
        number, place = np.nonzero(points > _NONE)
        for at in range(0, len(number), 100_000):
            i, j = number[at : at + 100_000], place[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(docs[i, j]), pa.array(points[i, j])], names=["question", "doc", "points"])

    columns = [F.col("doc").cast("long").alias("doc"), "vector"] + (["cluster"] if read is not None else [])
    found = rows.select(*columns).mapInArrow(run, "question long, doc long, points long")
    order = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("points"), "doc"))  # `top` rows of each task
    return found.withColumn("_n", order).where(F.col("_n") <= top).drop("_n")


def directions(sample: np.ndarray, k: int) -> np.ndarray:
    """k unit vectors by spherical k-means, begun at evenly spaced vectors of the sample; an empty cluster takes the vector that fits worst."""
    x = _unit(sample.astype(np.float64))
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(ROUNDS):
        near = x @ c.T
        of = near.argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, of, x)
        empty = np.flatnonzero(np.bincount(of, minlength=k) == 0)
        if len(empty):
            sums[empty] = x[np.argsort(near.max(1), kind="stable")[: len(empty)]]
        c = _unit(sums)
    return c


@dataclass(frozen=True)
class Clusters:
    """Vectors (doc, vector, cluster), stored in the order of their clusters, and the directions."""

    rows: DataFrame
    centres: np.ndarray
    sample: np.ndarray

    @staticmethod
    def of_table(vectors: DataFrame, key: str, column: str, clusters: int | None = None) -> Clusters:
        ship(vectors.sparkSession)
        v = vectors.select(F.col(key).alias("doc"), F.col(column).alias("vector")).where("doc IS NOT NULL AND vector IS NOT NULL")
        picked = v.orderBy(F.xxhash64("doc"), "doc").limit(SAMPLE).select("vector").toArrow().column(0).to_pylist()
        if not picked:
            raise ValueError("no vectors")
        sample = np.array(picked, np.float32)
        k = clusters or max(1, min(round(v.count() ** 0.5), MOST_CLUSTERS, len(sample)))
        centres = directions(sample, k)
        sent = vectors.sparkSession.sparkContext.broadcast(centres.astype(np.float32))  # MOST_CLUSTERS vectors at most

        def assign(batches):
            c = sent.value
            for batch in batches:
                x = _unit(_matrix(batch.column(1)).astype(np.float32))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((x @ c.T).argmax(1) if len(x) else [], pa.int32())], names=["doc", "vector", "cluster"])

        kind = dict(v.dtypes)
        placed = v.mapInArrow(assign, f"doc {kind['doc']}, vector {kind['vector']}, cluster int")
        n = max(1, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        return Clusters(stored(placed.repartitionByRange(n, "cluster", "doc").sortWithinPartitions("cluster", "doc"), "clusters"), centres, sample)

    def probes(self, recall: float, top: int = 10) -> int:
        """The least number of clusters by which questions of the sample find so much of their best, as the sample has them."""
        x = _unit(self.sample.astype(np.float64))
        of = (x @ self.centres.T).argmax(1)
        asked = x[np.linspace(0, len(x) - 1, min(QUESTIONS, len(x))).astype(int)]
        best = np.argsort(-(asked @ x.T), axis=1, kind="stable")[:, :top]
        order = np.argsort(np.argsort(-(asked @ self.centres.T), axis=1, kind="stable"), axis=1)  # the place of each cluster
        places = np.sort(np.take_along_axis(order, of[best], 1).ravel())
        return int(places[min(len(places) - 1, int(np.ceil(recall * len(places))) - 1)]) + 1

    def near(self, asked: list[float], recall: float = 0.95) -> DataFrame:
        """(doc, similarity) of the vectors in the clusters nearest to a question; 1.0 reads them all."""
        q = _unit(np.array(asked, np.float64))
        n = len(self.centres) if recall >= 1 else self.probes(recall)
        some = np.argsort(-(self.centres @ q), kind="stable")[:n].tolist()
        return search.cosine(self.rows.where(F.col("cluster").isin(some)), "doc", "vector", asked)

    def nearest(self, asked: np.ndarray, recall: float = 0.95, top: int = 10) -> DataFrame:
        """As the function of that name, for many questions, of which each reads the clusters nearest to it."""
        q = _unit(asked.astype(np.float64))
        n = len(self.centres) if recall >= 1 else self.probes(recall, top)
        read = [np.argpartition(-(q[at : at + 1024] @ self.centres.T), n - 1, axis=1)[:, :n].astype(np.int32) for at in range(0, len(q), 1024)]
        return nearest(self.rows, asked, top, np.concatenate(read))
