"""Hard negatives by threshold joins over an inverted index with norm bounds (after L2AP).

A component is floor(scale * x); the score of a row for an anchor is their integer inner product.
An anchor's positives are its best rows of the same label. For each positive there is a window of
scores, from LOW to HIGH percent of the positive's, and the negatives are the best rows of other
labels inside it.

Rows are dealt into shards, anchors into blocks, and every block meets every shard once, so a task
holds one shard and one block, and no label or vector gathers anything. In a shard the dimensions are
put in one order. Of each row, from every dimension on, the norm of the rest of the row is kept. The
list of a dimension holds its entries by that norm, the highest first. For an anchor and a threshold
an entry is left out of the index where the rest of its row times the norm of the anchor stays below
the threshold: from there on the row can't reach it alone. So every threshold is a prefix of each
list, and one index serves them all. The lists are traversed for a group of anchors at a time and the
partial scores are accumulated; leading dimensions whose lists hold half of the rows or more are accumulated in
one product of matrices; a row goes where its partial score and the norms of what remains of
both stay below the threshold, and the rows left are summed up exactly from what was left out.

Thresholds start near the top and are lowered, for the anchors whose windows aren't full yet, until
they are full or the foot of the window is reached. Each shard gives its best rows of every window,
and the shards are merged: positives first, as the windows are known from the positives of all shards.

Bounds are floating point, widened by more than their error, and scores are whole numbers held exactly in
doubles below 2^52. A shard and block with larger norms are scored in whole numbers of any size, all rows.

Defined cases: rows with a null id, a null label or vector, or a component that is null or not finite
take no part; an empty vector scores 0; vectors of unequal length are compared as if the shorter one
ended in zeros; rows with the anchor's own id are neither its positives nor its negatives; an id of
several rows is one anchor, with the smallest label and vector, and as many candidates as rows; ties go to the
smaller id; where an anchor has no positive, or a window no row, there are no rows; a negative
positive score has an empty window; a score that doesn't fit a long is an error; extra columns are not used.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskwright.llm.common import floors, materialize, table, whole

#: Scale, ids of the anchors, ids whose label moves on and the number of labels, positives, negatives, the window in percent.
SCALE, EVERY, MOVED, LABELS, POSITIVES, NEGATIVES, LOW, HIGH = 256, 50, 7, 10, 5, 3, 50, 95
#: Rows and components of a shard, anchors of a block, anchors that are accumulated together.
SHARD_ROWS, SHARD_VALUES, BLOCK_ROWS, GROUP = 16_384, 4_000_000, 1_024, 32
#: Thresholds for positives, as shares of the highest score that norms allow; the last takes all rows.
STEPS = (0.6, 0.3, 0.1, -math.inf)
#: Thresholds for a window, as shares of its height from the foot.
FEET = (0.75, 0.4, 0.0)
#: Norms are widened by this share, sums below this bound are exact in doubles.
WIDER, EXACT = 1 + 1e-9, float(1 << 52)


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, label and v (array of doubles) of the rows that take part, labels moved on."""
    v = F.col("embedding")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    moved = F.when(F.col("vec_id") % MOVED == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    kept = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull()).filter(fine)
    return kept.select(F.col("vec_id").cast("long"), moved.cast("long").alias("label"), v.cast("array<double>").alias("v"))


class Index:
    """The entries of a shard by dimension, each list by the norm of the rest of the row."""

    def __init__(self, vectors: list[np.ndarray]):
        self.size = len(vectors)
        lengths = np.array([len(v) for v in vectors], dtype=np.int64)
        values = np.concatenate([np.zeros(0), *vectors])
        rows = np.repeat(np.arange(self.size), lengths)
        dims = np.concatenate([np.zeros(0, np.int64), *[np.arange(n) for n in lengths]]).astype(np.int64)
        used = values != 0
        rows, dims, values = rows[used], dims[used], values[used]
        # dearest dimensions first, so that the rest of a row falls early
        with np.errstate(over="ignore"):
            weight = np.zeros(int(lengths.max(initial=0)))
            np.add.at(weight, dims, values * values)
        self.order = np.argsort(-weight, kind="stable")
        place = np.empty(len(self.order), np.int64)
        place[self.order] = np.arange(len(self.order))
        at = place[dims]
        by_row = np.lexsort((at, rows))
        self.rows, self.at, self.values = rows[by_row], at[by_row], values[by_row]
        self.starts = np.searchsorted(self.rows, np.arange(self.size + 1))
        # the norm of a row from each of its entries on: one sum backwards per row
        with np.errstate(over="ignore", invalid="ignore"):
            rest = np.zeros(len(self.values))
            for a, b in zip(self.starts[:-1], self.starts[1:]):
                rest[a:b] = np.sqrt(np.cumsum((self.values[a:b] ** 2)[::-1])[::-1])
        self.rest = np.nan_to_num(rest, nan=np.inf, posinf=np.inf) * WIDER
        self.norm = float(self.rest.max(initial=0.0))
        by_list = np.lexsort((-self.rest, self.at))
        self.list_rows, self.list_values, self.list_rest = self.rows[by_list], self.values[by_list], self.rest[by_list]
        self.lists = np.searchsorted(self.at[by_list], np.arange(len(self.order) + 1))
        # leading dimensions with long lists as a matrix, at most twice as large as their entries
        long = np.flatnonzero(2 * np.diff(self.lists) < self.size)
        self.wide = int(long[0]) if len(long) else len(self.order)
        self.matrix = np.zeros((self.size, self.wide))
        early = self.at < self.wide
        self.matrix[self.rows[early], self.at[early]] = self.values[early]

    def arranged(self, anchors: list[np.ndarray]) -> np.ndarray:
        """Anchors as a matrix in the order of the dimensions; what the shard has no entry for is zero."""
        out = np.zeros((len(anchors), len(self.order)))
        for k, anchor in enumerate(anchors):
            part = np.zeros(len(self.order))
            part[: min(len(anchor), len(part))] = anchor[: len(part)]
            out[k] = part[self.order]
        return out

    def _listed(self, d: int, bound: float) -> int:
        """Entries of a list whose rest is at least ``bound``."""
        a, b = self.lists[d], self.lists[d + 1]
        return int(np.searchsorted(-self.list_rest[a:b], -bound, side="right"))

    def reaching(self, anchors: np.ndarray, thresholds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each anchor (a row in the order of the dimensions): the rows that score its threshold or more, and their scores."""
        tails = np.sqrt(np.cumsum((anchors**2)[:, ::-1], axis=1)[:, ::-1]) * WIDER
        tails = np.c_[tails, np.zeros(len(anchors))]
        norms = tails[:, 0]
        # an entry counts where its rest times the norm of some anchor of the group reaches that anchor's threshold
        with np.errstate(divide="ignore", invalid="ignore"):
            need = np.where(norms > 0, thresholds / norms, np.where(thresholds > 0, np.inf, -np.inf))
        bound = float(need.min())
        lead = 0
        while lead < self.wide and 2 * self._listed(lead, bound) >= self.size:
            lead += 1
        partial = self.matrix[:, :lead] @ anchors[:, :lead].T
        for d in lead + np.flatnonzero(anchors[:, lead:].any(axis=0)):
            a = self.lists[d]
            b = a + self._listed(d, bound)
            if b > a:
                partial[self.list_rows[a:b]] += self.list_values[a:b, None] * anchors[:, d]
        # where the left-out end of each row starts, its norm, and the anchors' norm from there on
        listed = np.r_[0, np.cumsum((self.rest >= bound) | (self.at < lead))]
        cut = self.starts[:-1] + listed[self.starts[1:]] - listed[self.starts[:-1]]
        ended = cut >= self.starts[1:]
        safe = np.minimum(cut, max(len(self.rest) - 1, 0))
        left = np.where(ended, 0.0, self.rest[safe]) if len(self.rest) else np.zeros(self.size)
        dim = np.where(ended, len(self.order), self.at[safe]) if len(self.rest) else np.zeros(self.size, np.int64)
        for k, (anchor, threshold) in enumerate(zip(anchors, thresholds)):
            alive = np.flatnonzero(partial[:, k] + left * tails[k, dim] >= threshold)
            score = partial[alive, k]
            counts = self.starts[alive + 1] - cut[alive]
            if counts.any():
                owner = np.repeat(np.arange(len(alive)), counts)
                entry = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(cut[alive], counts)
                score = score + np.bincount(owner, weights=self.values[entry] * anchor[self.at[entry]], minlength=len(alive))
            keep = score >= threshold
            yield alive[keep], score[keep]


class Shard:
    """Rows of a shard in the order of their ids, with their index, or without one where sums are too large."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: list[np.ndarray], anchors: list[np.ndarray]):
        order = np.lexsort((labels, ids))
        self.ids, self.labels = ids[order], labels[order]
        self.raw = [vectors[k] for k in order]
        floored = [floors(v, SCALE) for v in self.raw]
        self.anchors = [floors(a, SCALE) for a in anchors]
        with np.errstate(over="ignore"):
            norm = lambda vs: max((float(np.sqrt(np.sum(v * v))) for v in vs), default=0.0)
            self.exact = norm(floored) * max(norm(self.anchors), 1.0) < EXACT
        self.raw_anchors = anchors
        if self.exact:
            self.index = Index(floored)
            self.arranged = self.index.arranged(self.anchors)
            self.norms = np.sqrt((self.arranged**2).sum(axis=1))

    def reaching(self, which: list[int], thresholds: np.ndarray) -> Iterator[tuple[np.ndarray, list[int] | np.ndarray]]:
        if self.exact:
            for start in range(0, len(which), GROUP):
                part = slice(start, start + GROUP)
                yield from self.index.reaching(self.arranged[which[part]], thresholds[part])
        else:
            self.whole_rows = getattr(self, "whole_rows", None) or [whole(v, SCALE) for v in self.raw]
            for k in which:
                anchor = whole(self.raw_anchors[k], SCALE)
                yield np.arange(len(self.ids)), np.array([sum(map(int.__mul__, anchor, v)) for v in self.whole_rows], dtype=object)

    def highest(self, which: list[int]) -> np.ndarray:
        """No row scores more for these anchors."""
        return self.norms[which] * self.index.norm * WIDER if self.exact else np.full(len(which), np.inf)


def best(rows: np.ndarray, scores: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The k best, by score and then by place; places are in the order of the ids."""
    if len(rows) > 64 and scores.dtype != object:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        rows, scores = rows[scores >= least], scores[scores >= least]
    return sorted(((int(r), int(s)) for r, s in zip(rows, scores)), key=lambda x: (-x[1], x[0]))[:k]


def shard_positives(shard: Shard, anchor_ids: list[int], anchor_labels: list[int], k: int) -> Iterator[tuple[int, int, int]]:
    """Anchor, row and score of the k best rows of the anchor's label."""
    open_, found = list(range(len(anchor_ids))), {}
    for step in STEPS:
        if not open_:
            break
        # in groups of like norms one bound fits all
        open_.sort(key=lambda a: float(shard.norms[a]) if shard.exact else 0.0)
        limits = shard.highest(open_) * step if shard.exact and step > -math.inf else np.full(len(open_), -math.inf)
        still = []
        for a, (rows, scores) in zip(open_, shard.reaching(open_, limits)):
            same = (shard.labels[rows] == anchor_labels[a]) & (shard.ids[rows] != anchor_ids[a])
            if same.sum() >= k or step == -math.inf or not shard.exact:
                found[a] = best(rows[same], scores[same], k)
            else:
                still.append(a)
        open_ = still
    for a, rows in found.items():
        yield from ((a, r, s) for r, s in rows)


def shard_negatives(shard: Shard, anchor_ids: list[int], anchor_labels: list[int], windows: list[list[tuple[int, int]]], k: int) -> Iterator[tuple[int, int, int, int]]:
    """Anchor, place of the window, row and score of the k best rows of other labels inside each window (lowest, highest score)."""
    open_ = [a for a, w in enumerate(windows) if w]
    for step in FEET:
        if not open_:
            break
        feet = [min(lo + (hi - lo) * step for lo, hi in windows[a]) for a in open_]
        order = sorted(range(len(open_)), key=lambda x: feet[x] / max(float(shard.norms[open_[x]]), 1e-300) if shard.exact else 0.0)
        open_, feet = [open_[x] for x in order], [feet[x] for x in order]
        # as floating point a foot may be rounded up; the windows are tested with whole numbers below
        limits = np.array([math.nextafter(float(f), -math.inf) for f in feet]) if shard.exact else np.zeros(len(feet))
        still = []
        for a, foot, (rows, scores) in zip(open_, feet, shard.reaching(open_, limits)):
            other = (shard.labels[rows] != anchor_labels[a]) & (shard.ids[rows] != anchor_ids[a])
            rows, scores = rows[other], scores[other]
            full = []
            for lo, hi in windows[a]:
                inside = (scores >= lo) & (scores <= hi)
                full.append((int((inside & (scores >= foot)).sum()) >= k, rows[inside], scores[inside]))
            if step == FEET[-1] or not shard.exact or all(f for f, _, _ in full):
                for w, (_, r, s) in enumerate(full):
                    yield from ((a, w, at, x) for at, x in best(r, s, k))
            else:
                still.append(a)
        open_ = still


_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def _clipped(scores: list[int]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([min(max(s, _LEAST), _MOST) for s in scores], dtype=np.int64), np.array([_LEAST <= s <= _MOST for s in scores], dtype=bool)


def _fitting(name: str) -> Column:
    return F.when(F.col("fits"), F.col(name)).otherwise(F.raise_error(F.lit("a score does not fit a long")).cast("long")).alias(name)


def window_of(score: int, low: int = LOW, high: int = HIGH) -> tuple[int, int]:
    """Lowest and highest whole score with low * score <= 100 * x <= high * score."""
    return -(-low * score // 100), high * score // 100


def mine(
    rows: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
    every: int = EVERY, shard_rows: int = SHARD_ROWS, shard_values: int = SHARD_VALUES, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score over ``rows`` (vec_id, label, v)."""
    rows = materialize(rows, "rows")
    size = rows.agg(F.count("*"), F.sum(F.size("v").cast("long")), F.max(F.size("v"))).first()
    shards = max(-(-size[0] // shard_rows), -(-(size[1] or 0) // shard_values), 1)
    anchors = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("a"))
    anchors = materialize(anchors.select(F.col("vec_id").alias("anchor_id"), F.col("a.label").alias("anchor_label"), F.col("a.v").alias("a")), "anchors")
    # a block holds a bounded number of components as well
    blocks = max(-(-anchors.count() // max(min(block_rows, shard_values // max(size[2] or 1, 1)), 1)), 1)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: (F.monotonically_increasing_id() % n).cast("int")
    left = rows.withColumn("shard", dealt(shards)).select("shard", each(blocks).alias("block"), "vec_id", "label", "v").groupBy("shard", "block")

    def shard_of(part: pd.DataFrame, asked: pd.DataFrame) -> Shard:
        vectors = [np.asarray(v, dtype=float) for v in part["v"]]
        return Shard(part["vec_id"].to_numpy(dtype=np.int64), part["label"].to_numpy(dtype=np.int64), vectors, [np.asarray(a, dtype=float) for a in asked["a"]])

    def find_positives(key, part: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out, shard = [], None
        if len(part) and len(asked):
            shard = shard_of(part, asked)
            out = list(shard_positives(shard, asked["anchor_id"].tolist(), asked["anchor_label"].tolist(), positives))
        scores, fits = _clipped([s for _, _, s in out])
        return pd.DataFrame({
            "anchor_id": asked["anchor_id"].to_numpy(dtype=np.int64)[[a for a, _, _ in out]] if out else np.zeros(0, np.int64),
            "positive_id": shard.ids[[r for _, r, _ in out]] if out else np.zeros(0, np.int64), "positive_score": scores, "fits": fits,
        })

    asked = anchors.withColumn("block", dealt(blocks)).select(each(shards).alias("shard"), "block", "anchor_id", "anchor_label", "a")
    near = left.cogroup(asked.groupBy("shard", "block")).applyInPandas(find_positives, "anchor_id long, positive_id long, positive_score long, fits boolean")
    place = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), F.desc("fits"), "positive_id"))
    near = near.withColumn("place", place).filter(F.col("place") <= positives).select("anchor_id", "place", "positive_id", _fitting("positive_score"))
    # the windows of an anchor travel with it: at most ``positives`` of them
    listed = near.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("p"))
    wanted = materialize(anchors.join(listed, "anchor_id").select(
        "anchor_id", "anchor_label", "a", F.col("p.positive_id").alias("positive_ids"), F.col("p.positive_score").alias("positive_scores")
    ), "wanted")

    def find_negatives(key, part: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out, shard, ids = [], None, asked["anchor_id"].tolist()
        if len(part) and len(asked):
            shard = shard_of(part, asked)
            windows = [[window_of(int(s), low, high) for s in scores] for scores in asked["positive_scores"]]
            out = list(shard_negatives(shard, ids, asked["anchor_label"].tolist(), windows, negatives))
        pids, pscores = asked["positive_ids"].tolist(), asked["positive_scores"].tolist()
        return pd.DataFrame({
            "anchor_id": np.array([ids[a] for a, _, _, _ in out], dtype=np.int64), "place": np.array([w for _, w, _, _ in out], dtype=np.int32),
            "positive_id": np.array([pids[a][w] for a, w, _, _ in out], dtype=np.int64),
            "negative_id": np.array([shard.ids[r] for _, _, r, _ in out], dtype=np.int64),
            "positive_score": np.array([pscores[a][w] for a, w, _, _ in out], dtype=np.int64),
            "negative_score": np.array([s for _, _, _, s in out], dtype=np.int64),
        })

    asked = wanted.withColumn("block", dealt(blocks)).select(each(shards).alias("shard"), "block", *wanted.columns)
    far = left.cogroup(asked.groupBy("shard", "block")).applyInPandas(
        find_negatives, "anchor_id long, place int, positive_id long, negative_id long, positive_score long, negative_score long"
    )
    rank = F.row_number().over(Window.partitionBy("anchor_id", "place").orderBy(F.desc("negative_score"), "negative_id"))
    return far.withColumn("rank", rank).filter(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(usable(table(spark, sf_dir, "embeddings")))


OP13_SQL = f"""
WITH parts AS (
  SELECT vec_id, CASE WHEN vec_id % {MOVED} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
),
scored AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, c.vec_id, c.label,
    CAST(coalesce(list_sum(list_transform(generate_series(1, least(len(a.v), len(c.v))), lambda i: a.v[i] * c.v[i])), 0) AS BIGINT) AS score
  FROM parts a JOIN parts c ON a.vec_id <> c.vec_id WHERE a.vec_id % {EVERY} = 0
),
pos AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place
  FROM scored WHERE label = anchor_label
),
neg AS (
  SELECT p.anchor_id, p.place, p.positive_id, p.positive_score, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.place ORDER BY s.score DESC, s.vec_id) AS rank
  FROM pos p JOIN scored s ON s.anchor_id = p.anchor_id AND s.label <> s.anchor_label
    AND {LOW} * p.positive_score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.positive_score
  WHERE p.place <= {POSITIVES}
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= {NEGATIVES}
"""
