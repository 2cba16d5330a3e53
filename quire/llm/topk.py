"""Exact top-k by inner product with a pivot-distance index.

Vectors v get one more component, sqrt(M^2 - |v|^2) (M the largest norm), queries get 0: the nearest vectors in that space are
those of largest inner product, so the triangle inequality applies. Pivots are spread over a bounded
sample; every vector is keyed by its nearest pivot and its distance to it. A pivot's vectors are sorted into annuli
(bounds from the sample's quantiles; at most `PIVOTS * RINGS` annuli in all), large annuli are dealt to chunks of bounded size.

A query first searches the annuli that it can be nearest to; its k-th score there is a bound. It then goes on over the
other annuli in order of the least distance that the triangle inequality allows, and stops at the first
whose best possible score is below the bound. Ties at the bound stay in. Queries are dealt to blocks, so that a task holds
one chunk of vectors and one block of queries.

Scores are integer inner products of floor(256 x), x as double; missing components of shorter vectors count as 0.

Defined cases: vectors that are null or hold null or non-finite components, and rows with a null id, take no part; a query
with fewer than k candidates gets them all; an empty vector scores 0; repeated rows are candidates each (never of their own
id); components from 2^45 on are outside the domain of exact scores (their sums are computed in floating point).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import written

K = 5
EVERY = 50
SCALE = 256
PIVOTS, RINGS = 64, 16
SAMPLE = 4096
CHUNK = 2048
QUERIES = 1024
NEAREST = 4


def quantised(embeddings: DataFrame) -> DataFrame:
    """vec_id, v (array of long) of the rows that take part."""
    x = F.col("embedding")
    good = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.col("vec_id").isNotNull()
    return embeddings.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * SCALE).cast("double")).alias("v"))


def _matrix(column, width: int) -> np.ndarray:
    """Rows of numbers, padded with 0 to `width`."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row, at] = flat
    return out


class Index:
    """Pivots (in the larger space) and, for each, the inner bounds of its annuli."""

    def __init__(self, sample: np.ndarray, norm2: float, pivots: int, rings: int):
        self.norm2, self.width = norm2, sample.shape[1]
        lifted = self.lift(sample)
        chosen = [0] if len(lifted) else []
        far = np.full(len(lifted), np.inf)
        for _ in range(min(pivots, len(lifted)) - 1):  # each next pivot is the vector farthest from all before
            far = np.minimum(far, ((lifted - lifted[chosen[-1]]) ** 2).sum(1))
            if far.max() <= 0:
                break
            chosen.append(int(far.argmax()))
        self.pivots = lifted[chosen] if chosen else np.zeros((1, self.width + 1))
        own, distance = self.nearest(lifted) if len(lifted) else (np.zeros(0, np.int64), np.zeros(0))
        self.edges = [np.unique(np.quantile(distance[own == p], np.arange(1, rings) / rings)) if (own == p).any() and rings > 1 else np.zeros(0) for p in range(len(self.pivots))]

    def lift(self, v: np.ndarray, query: bool = False) -> np.ndarray:
        more = np.zeros(len(v)) if query else np.sqrt(np.maximum(self.norm2 - (v * v).sum(1), 0))
        return np.column_stack([v, more])

    def distances(self, lifted: np.ndarray) -> np.ndarray:
        d2 = (lifted * lifted).sum(1)[:, None] + (self.pivots * self.pivots).sum(1)[None, :] - 2 * lifted @ self.pivots.T
        return np.sqrt(np.maximum(d2, 0))

    def nearest(self, lifted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = self.distances(lifted)
        own = d.argmin(1)
        return own, d[np.arange(len(d)), own]

    def annulus(self, own: np.ndarray, distance: np.ndarray) -> np.ndarray:
        out = np.empty(len(own), np.int64)
        for p in np.unique(own):
            out[own == p] = p * 1000 + np.searchsorted(self.edges[p], distance[own == p], "right")
        return out


def _top(q_id, q_block, chunk_id, chunk, k: int, width: int):
    """The k best of one chunk for each of a block of queries: query_id, vec_id, score; ties to the smaller id."""
    a, b = _matrix(q_block, width), _matrix(chunk, width)
    scores = a @ b.T
    limit = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * width
    scores = (a.astype(np.int64) @ b.astype(np.int64).T) if 2**53 <= limit < 2**63 else np.rint(np.clip(scores, -(2.0**63), 2.0**63 - 1024)).astype(np.int64)
    own = q_id[:, None] == chunk_id[None, :]
    order = np.argsort(chunk_id, kind="stable")
    scores, own, ids = scores[:, order], own[:, order], chunk_id[order]
    rows, columns = [], []
    for i in range(len(q_id)):
        good = np.flatnonzero(~own[i])
        s = scores[i, good]
        if len(s) > k:
            bar = np.partition(s, len(s) - k)[len(s) - k]
            good, s = good[s >= bar], s[s >= bar]
        best = good[np.lexsort((ids[good], -s))[:k]]
        rows.append(np.full(len(best), i))
        columns.append(best)
    rows, columns = np.concatenate(rows), np.concatenate(columns)
    return q_id[rows], ids[columns], scores[rows, columns]


def _searched(vectors: DataFrame, asked: DataFrame, k: int, width: int) -> DataFrame:
    """vectors: annulus, chunk, vec_id, v; asked: annulus, chunk, block, query_id, q. Candidates (query_id, vec_id, score)."""
    asked = written(asked)
    keys = asked.select(*[F.col(c).alias(f"to_{c}") for c in ("annulus", "chunk", "block")]).distinct()
    dealt = vectors.join(keys, (vectors.annulus == keys.to_annulus) & (vectors.chunk == keys.to_chunk)).select("to_annulus", "to_chunk", "to_block", "vec_id", "v")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        q, v, s = _top(right["query_id"].to_numpy(), right["q"], left["vec_id"].to_numpy(), left["v"], k, width)
        return pa.table({"query_id": q, "vec_id": v, "score": s})

    return dealt.groupBy("to_annulus", "to_chunk", "to_block").cogroup(asked.groupBy("annulus", "chunk", "block")).applyInArrow(search, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, pivots: int = PIVOTS, rings: int = RINGS, sample: int = SAMPLE, chunk: int = CHUNK) -> DataFrame:
    """query_id, rank, vec_id, score. vectors: vec_id, v; queries: query_id, q; v and q arrays of whole numbers as double."""
    vectors = written(vectors)
    queries = queries.groupBy("query_id").agg(F.min("q").alias("q"))
    norm2 = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    facts = vectors.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.max(norm2).alias("norm2")).first()
    n, width = facts["n"], max(facts["width"] or 0, queries.agg(F.max(F.size("q"))).first()[0] or 0, 1)
    taken = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toArrow()
    annuli = max(1, n // (chunk // 4))
    pivots = max(1, min(pivots, annuli))
    index = Index(_matrix(taken["v"], width) if taken.num_rows else np.zeros((0, width)), float(facts["norm2"] or 0), pivots, max(1, min(rings, annuli // pivots)))

    def keyed(batches):
        for batch in batches:
            own, distance = index.nearest(index.lift(_matrix(batch.column("v"), width)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(index.annulus(own, distance)), pa.array(distance)], ["vec_id", "v", "annulus", "distance"])

    placed = written(vectors.mapInArrow(keyed, "vec_id long, v array<double>, annulus long, distance double"))
    # the directory: at most PIVOTS * RINGS rows, whatever the number of vectors
    directory = placed.groupBy("annulus").agg(F.min("distance").alias("low"), F.max("distance").alias("high"), F.count("*").alias("n")).toPandas()
    ids, low, high = directory["annulus"].to_numpy(np.int64), directory["low"].to_numpy(float), directory["high"].to_numpy(float)
    chunks = dict(zip(ids.tolist(), (-(-directory["n"] // chunk)).tolist(), strict=True))
    of = F.element_at(F.create_map(*[F.lit(x) for a, c in chunks.items() for x in (int(a), int(c))]), F.col("annulus")) if chunks else F.lit(1)
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), of).cast("int")).select("annulus", "chunk", "vec_id", "v")

    def plan(first: bool):
        """The annuli of each query: those nearest by bound, or all others whose bound the k-th score doesn't exclude."""

        def go(batches):
            for batch in batches:
                q = _matrix(batch.column("q"), width)
                lifted = index.lift(q, True)
                d = index.distances(lifted)[:, ids // 1000] if len(ids) else np.zeros((len(q), 0))
                least = np.maximum(0, np.maximum(low[None, :] - d, d - high[None, :]))
                order = np.argsort(least, axis=1, kind="stable")
                here = np.zeros(least.shape, bool)
                np.put_along_axis(here, order[:, :NEAREST], True, 1)
                if first:
                    chosen = here
                else:
                    bar = batch.column("bar").to_numpy(zero_copy_only=False)  # NaN: fewer than k found so far
                    most = ((q * q).sum(1)[:, None] + index.norm2 - least * least) / 2
                    slack = 1e-6 * (1 + np.abs(most)) + 1e-6 * index.norm2
                    chosen = ~here & ~(most + slack < bar[:, None])
                row, which = np.nonzero(chosen)
                yield pa.RecordBatch.from_arrays([batch.column("query_id").take(pa.array(row)), batch.column("q").take(pa.array(row)), pa.array(ids[which])], ["query_id", "q", "annulus"])

        return go

    def search(asked: DataFrame, first: bool) -> DataFrame:
        asked = asked.mapInArrow(plan(first), "query_id long, q array<double>, annulus long")
        asked = asked.withColumn("block", F.pmod(F.xxhash64("query_id", F.lit(9)), F.lit(max(1, n // EVERY // QUERIES))))
        asked = asked.withColumn("chunk", F.explode(F.sequence(F.lit(0), of.cast("int") - 1)))
        return _searched(placed, asked, k, width)

    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = lambda found: found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    near = written(best(search(queries, True)))
    bars = near.where(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("bar"))
    rest = search(queries.join(bars, "query_id", "left"), False)
    return best(near.select("query_id", "vec_id", "score").unionByName(rest)).select("query_id", "rank", "vec_id", "score")


def nearest_of_every(embeddings: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """The k best of every row whose vec_id is divisible by `every`, among all rows but its own."""
    vectors = quantised(embeddings)
    return top_k(vectors, vectors.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), k)


#: DuckDB SQL for nearest_of_every() with its default parameters.
SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
