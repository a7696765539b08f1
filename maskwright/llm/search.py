"""Exact top-k search by inner product with MaxScore.

A vector is read as a text: each component that isn't zero is a term, its dimension with its sign,
and its size is the weight. The postings of a shard are, per term, the places of the vectors that
have it and their weights; a list that holds half of the shard's vectors or more is stored as a row of a
matrix, so the lists take at most twice the room of the components that aren't zero. The score of a candidate
is the sum over the dimensions; a term of the query with the same sign adds to it, one with the
other sign takes away, so the bound of a term is the query's weight times the highest weight in the
list of the same sign.

For each query the terms are put in order of their bounds. Those with the smallest bounds whose sum
stays below the k-th best score so far are non-essential: what occurs in no other list can't get
among the best. The lists of the others, the essential ones, are traversed and summed; the lists
left are probed only for candidates whose sum, with the bounds that remain, still reaches the k-th
best score. Pruning is strict, so ties are kept and go to the smaller id. Each shard gives its k best
per query and the shards are merged.

Queries go out in blocks of bounded size, and each block meets each shard once; rows are dealt in
turn, so no key can gather them. Memory of a task is one shard and one block, each of a bounded number
of vectors and of components.

Vectors with a component of LIMIT or more after scaling are scored apart, as sums of theirs could leave a
long: floating point with its error bound leaves the few that can be among the best, and these are
summed in whole numbers of any size.

Defined cases: vectors that are null or hold a null or a value that isn't finite take no part, all others do, of
any size; an empty vector scores 0 with everything; a result whose score doesn't fit a long is an error; vectors of unequal length are compared as if the shorter one ended in zeros; a row is never
a candidate of a query with its own id; repeated ids are candidates row by row, and as queries they
are asked once, with the smallest vector; rows with a null id take no part; fewer candidates than k
give fewer rows; extra columns are not used.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskwright.llm.common import floors, materialize, table, whole

#: Scale of a component, results per query, ids of the queries, rows of a shard and of a block.
SCALE, TOP, EVERY, SHARD_ROWS, BLOCK_ROWS = 256, 5, 50, 16_384, 2_048
#: Components of a shard and of a block.
SHARD_VALUES = 4_000_000
LIMIT = 1 << 24


def integer_vectors(rows: DataFrame) -> DataFrame:
    """vec_id and v (array of doubles, to be scaled and floored) of the rows that take part."""
    v = F.col("embedding")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    kept = rows.filter(F.col("vec_id").isNotNull() & v.isNotNull()).filter(fine)
    return kept.select(F.col("vec_id").cast("long"), v.cast("array<double>").alias("v"))


class Postings:
    """The lists of one shard: by dimension, the vectors that have it, their weights, and the best weight of each sign."""

    def __init__(self, ids: np.ndarray, vectors: list[np.ndarray]):
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        self.vectors = [np.asarray(vectors[place], dtype=np.int64) for place in order]
        lengths = [len(v) for v in self.vectors]
        n, width = len(lengths), max(lengths)
        values = np.concatenate(self.vectors)
        rows, dims = np.repeat(np.arange(n), lengths), np.concatenate([np.arange(k) for k in lengths])
        used = np.flatnonzero(values)
        by_list = used[np.lexsort((rows[used], dims[used]))]
        self.rows, dims, self.values = rows[by_list], dims[by_list], values[by_list]
        self.starts = np.searchsorted(dims, np.arange(width + 1))
        self.high, self.low = np.zeros(width, np.int64), np.zeros(width, np.int64)
        np.maximum.at(self.high, dims, self.values)
        np.minimum.at(self.low, dims, self.values)
        long = np.flatnonzero(2 * np.diff(self.starts) >= n)
        self.place = np.full(width, -1)
        self.place[long] = np.arange(len(long))
        self.matrix = np.zeros((len(long), n), dtype=np.int64)
        wide = self.place[dims] >= 0
        self.matrix[self.place[dims[wide]], self.rows[wide]] = self.values[wide]
        self.scratch = np.zeros(n, dtype=np.int64)

    def _list(self, d: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.starts[d], self.starts[d + 1])
        return self.rows[part], self.values[part]

    def _add(self, score: np.ndarray, d: int, weight: int) -> None:
        if self.place[d] >= 0:
            score += weight * self.matrix[self.place[d]]
        else:
            rows, values = self._list(d)
            score[rows] += weight * values

    def _probe(self, d: int, at: np.ndarray) -> np.ndarray:
        if self.place[d] >= 0:
            return self.matrix[self.place[d], at]
        rows, values = self._list(d)
        self.scratch[rows] = values
        found = self.scratch[at]
        self.scratch[rows] = 0
        return found

    def best(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best candidates, best first, ties by id."""
        query = query[: len(self.place)]
        bounds = np.where(query > 0, query * self.high[: len(query)], query * self.low[: len(query)])
        terms = np.flatnonzero((query != 0) & (np.diff(self.starts)[: len(query)] > 0))
        order = terms[np.argsort(-bounds[terms], kind="stable")]
        rest = np.r_[np.cumsum(bounds[order][::-1])[::-1], 0].astype(np.int64)
        others = self.ids != query_id
        score = np.zeros(len(self.ids), dtype=np.int64)
        lead = -(-len(order) // 8)
        for d in order[:lead]:
            self._add(score, d, query[d])
        # a first k-th best score: the full scores of those that lead in the dearest terms
        some = np.argpartition(score, -min(4 * k, len(score)))[-min(4 * k, len(score)) :]
        full = np.sort(np.array([self.vectors[at][: len(query)] @ query[: len(self.vectors[at])] for at in some[others[some]]], dtype=np.int64))
        reach = full[-k] if len(full) >= k else -(1 << 62)
        # from ``essential`` on, all bounds together stay below that score; at zero or less, no list can be left out
        essential = max(lead, min(int(np.searchsorted(-rest, -reach, side="right")), len(order)))
        for d in order[lead:essential]:
            self._add(score, d, query[d])
        # who is in no essential list has a sum of zero at most, and goes here
        alive = np.flatnonzero(others & (score + rest[essential] >= reach))
        score = score[alive]
        for at in range(essential, len(order)):
            keep = score + rest[at] >= reach
            alive, score = alive[keep], score[keep]
            score = score + query[order[at]] * self._probe(order[at], alive)
        top = np.lexsort((self.ids[alive], -score))[:k]
        return self.ids[alive[top]], score[top]


class Wide:
    """The vectors of a shard whose sums could leave a long, as they are and scaled to whole doubles, one after the other."""

    def __init__(self, ids: np.ndarray, raw: list[np.ndarray]):
        self.ids, self.raw = ids, raw
        lengths = np.array([len(v) for v in raw])
        self.starts = np.r_[0, np.cumsum(lengths)]
        self.values = floors(np.concatenate([np.zeros(0), *raw]), SCALE)
        self.dims = np.concatenate([np.zeros(0, np.int64), *[np.arange(n) for n in lengths]]).astype(np.int64)

    def _sums(self, products: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.raw))
        some = np.flatnonzero(np.diff(self.starts))
        if len(some):
            out[some] = np.add.reduceat(products, self.starts[some])
        return out

    def best(self, query_id: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """Id and score of the k best candidates, best first, ties by id; scores are of any size."""
        longest = int(self.dims.max(initial=-1)) + 1
        scaled = np.zeros(max(longest, len(query)))
        scaled[: len(query)] = floors(query, SCALE)
        others = np.flatnonzero(self.ids != query_id)
        with np.errstate(over="ignore", invalid="ignore"):
            products = self.values * scaled[self.dims]
            about = self._sums(products)[others]
            error = self._sums(np.abs(products))[others] * (longest + 2) * 2.0**-51
            low = np.nan_to_num(about - error, nan=-np.inf, posinf=-np.inf)
            reach = np.partition(low, -k)[-k] if len(low) >= k else -np.inf
            alive = others[~(about + error < reach)]
        numbers = whole(query, SCALE)
        scored = ((sum(x * y for x, y in zip(whole(self.raw[at], SCALE), numbers)), int(self.ids[at])) for at in alive)
        return [(i, s) for s, i in sorted(scored, key=lambda x: (-x[0], x[1]))[:k]]


def shard_best(ids: np.ndarray, vectors: list[np.ndarray], asked: list[tuple[int, np.ndarray]], k: int) -> list[tuple[int, int, int]]:
    """Query, id and score of the k best of a shard, for each query; the k best of both kinds of vectors where there are both."""
    highest = lambda v: float(np.abs(v).max(initial=0))
    vectors = [np.asarray(v, dtype=float) for v in vectors]
    scaled = [floors(v, SCALE) for v in vectors]
    wide = np.array([highest(v) >= LIMIT for v in scaled], dtype=bool)
    near_ids, near = ids[~wide], [scaled[at] for at in np.flatnonzero(~wide)]
    postings = Postings(near_ids, near) if near else None
    # all sums of a long's size and their bounds stay below 2^62
    room = (1 << 62) / max(max(map(highest, near), default=0) * max(map(len, near), default=0), 1)
    apart = Wide(ids[wide], [vectors[at] for at in np.flatnonzero(wide)]) if wide.any() else None
    all_near = None
    out = []
    for query_id, query in asked:
        query = np.asarray(query, dtype=float)
        floored = floors(query, SCALE)
        if postings and highest(floored) < min(room, 2.0**62):
            out += [(query_id, i, s) for i, s in zip(*(x.tolist() for x in postings.best(query_id, floored.astype(np.int64), k)))]
        elif postings:
            all_near = all_near or Wide(near_ids, [vectors[at] for at in np.flatnonzero(~wide)])
            out += [(query_id, i, s) for i, s in all_near.best(query_id, query, k)]
        if apart:
            out += [(query_id, i, s) for i, s in apart.best(query_id, query, k)]
    return out


def top_k(candidates: DataFrame, queries: DataFrame, k: int = TOP, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score of the k best candidates of each query (both vec_id, v)."""
    candidates = materialize(candidates, "candidates")
    queries = materialize(queries.groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    parts = lambda df, rows: max(
        -(-x // y) for x, y in zip((*df.agg(F.count("*"), F.coalesce(F.sum(F.size("v").cast("long")), F.lit(0))).first(), 1), (rows, SHARD_VALUES, 1)))
    shards, blocks = parts(candidates, shard_rows), parts(queries, block_rows)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: (F.monotonically_increasing_id() % n).cast("int")  # noqa: E731  in turn, whatever the rows are
    left = candidates.withColumn("shard", dealt(shards)).select("shard", each(blocks).alias("block"), "vec_id", "v")
    right = queries.withColumn("block", dealt(blocks)).select(each(shards).alias("shard"), "block", "vec_id", "v")

    def run(key, rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = shard_best(rows["vec_id"].to_numpy(dtype=np.int64), rows["v"].tolist(), list(zip(asked["vec_id"].tolist(), asked["v"])), k) if len(rows) else []
        least, most = -(1 << 63), (1 << 63) - 1
        return pd.DataFrame({
            "query_id": np.array([q for q, _, _ in out], dtype=np.int64), "vec_id": np.array([i for _, i, _ in out], dtype=np.int64),
            "score": np.array([min(max(s, least), most) for _, _, s in out], dtype=np.int64),
            "fits": np.array([least <= s <= most for _, _, s in out], dtype=bool),
        })

    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(run, "query_id long, vec_id long, score long, fits boolean")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("fits"), "vec_id"))
    score = F.when(F.col("fits"), F.col("score")).otherwise(F.raise_error(F.lit("a score does not fit a long")).cast("long"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", score.alias("score"))


def op1_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = integer_vectors(table(spark, sf_dir, "embeddings"))
    return top_k(rows, rows.filter(F.col("vec_id") % EVERY == 0))


OP1_SQL = f"""
WITH parts AS (
  SELECT vec_id, list_transform(embedding, lambda x: TRY_CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(coalesce(list_sum(list_transform(generate_series(1, least(len(q.v), len(c.v))), lambda i: q.v[i] * c.v[i])), 0) AS BIGINT) AS score
  FROM parts q JOIN parts c ON q.vec_id <> c.vec_id WHERE q.vec_id % {EVERY} = 0
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= {TOP}
"""
