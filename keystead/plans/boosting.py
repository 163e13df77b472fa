"""Boosted trees for all folds of a comparison at once (A-M3, A-M6).

Boosting is a long chain of small steps. As a job each, nearly all of their time
goes into starting jobs. Rows are put into bins once (``bins``); while a task can
hold them, every fit walks its chain in a task of its own, in one stage for all.

Larger tables take a step for all folds together:
every row knows in which folds it trains, and one job a level adds up the
histograms of all folds. Sums meet by fold on the executors, which choose the
splits; only these come to the driver. The rows with their scores are kept in
blocks and written to the checkpoint folder every few trees, so a lost executor
repeats a few trees.

Squared error, shrunken leaves with a penalty on their size, a share of the rows
and of the features for every tree; both are drawn from hashes, so the result
does not depend on how rows are dealt, but for the last digits of sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
from pyspark import RDD, StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystead.plans.bins import Layout, Rows, gathered, layout, measures, outcome, packed, to_every
from keystead.storage import new_path

REFRESH = 10  # trees between two written states


@dataclass(frozen=True)
class Boosting:
    trees: int = 500
    depth: int = 6
    rate: float = 0.05
    rows: float = 0.8
    columns: float = 0.8
    seed: int = 42
    penalty: float = 1.0
    bins: int = 32


@dataclass
class Tree:
    """Splits (feature or -1, last bin on the left) by level, and the values of the leaves."""

    levels: list[tuple[np.ndarray, np.ndarray]]
    values: np.ndarray | None = None

    def leaves(self, codes: np.ndarray) -> np.ndarray:
        """The node of every row behind the levels so far."""
        node, row = np.zeros(len(codes), np.int64), np.arange(len(codes))
        for feature, last in self.levels:
            f = feature[node]
            node = 2 * node + ((f >= 0) & (codes[row, f] > last[node]))
        return node


@dataclass
class Block:
    """Rows of one partition: bins, ids, labels, the fits in which a row trains, and its scores so far.

    filled: row and place in a histogram of every value that is not in the first bin of its feature. Most values
    are zeros of codes, whose sums are what the others leave of a node's.
    """

    codes: np.ndarray
    filled: tuple[np.ndarray, np.ndarray]
    ids: np.ndarray
    label: np.ndarray
    trains: np.ndarray
    score: np.ndarray

    def with_trees(self, trees: list[list[Tree]]) -> Block:
        score = self.score.copy()
        for step in trees:
            for k, tree in enumerate(step):
                score[:, k] += tree.values[tree.leaves(self.codes)]
        return replace(self, score=score)

    def sums(self, tree: Tree, weight: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
        """``weight`` added up by node and bin of every feature."""
        node, nodes = tree.leaves(self.codes), 1 << len(tree.levels)
        row, place = self.filled
        out = np.bincount(node[row] * width + place, weight[row], nodes * width).reshape(nodes, width)
        whole = np.bincount(node, weight, nodes)
        out[:, starts] = whole[:, None] - np.add.reduceat(out, starts, axis=1)
        return out


def cut_points(rows: DataFrame, bins: int) -> list[np.ndarray]:
    """For every feature the values that end its bins but the last."""
    cells = rows.select(F.posexplode(vector_to_array("features")).alias("at", "x"))
    shares = [k / bins for k in range(bins)]
    found = cells.groupBy("at").agg(F.percentile_approx("x", shares, 10_000).alias("cuts"), F.max("x").alias("most"))
    ordered = sorted(found.collect(), key=lambda row: row["at"])  # a row for every feature
    return [np.unique([x for x in row["cuts"] if x < row["most"]]) for row in ordered]


def drawn(ids: np.ndarray, seed: int, fit: int, tree: int) -> np.ndarray:
    """A number from 0 to 1 for every row, from its id, the fit and the tree."""
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64) + np.uint64((seed * 1_000_003 + fit) * 1_000_003 + tree) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x >> np.uint64(11)).astype(np.float64) / (1 << 53)


def best_splits(sums: np.ndarray, starts: np.ndarray, allowed: np.ndarray, penalty: float) -> tuple[np.ndarray, ...]:
    """Feature, last bin on the left, and value of either side for every node of a fit.

    sums: (gradient or count, node, bin of all features one after the other); starts: first bin of every feature.
    """
    g, n = np.cumsum(sums[0], axis=1), np.cumsum(sums[1], axis=1)
    sizes = np.diff(np.append(starts, g.shape[1]))
    before = np.repeat(starts - 1, sizes)
    base_g, base_n = (np.where(before >= 0, x[:, before], 0) for x in (g, n))
    left_g, left_n = g - base_g, n - base_n
    all_g, all_n = left_g[:, sizes[0] - 1][:, None], left_n[:, sizes[0] - 1][:, None]
    right_g, right_n = all_g - left_g, all_n - left_n
    gain = left_g**2 / (left_n + penalty) + right_g**2 / (right_n + penalty) - all_g**2 / (all_n + penalty)
    gain[(left_n < 1) | (right_n < 1) | ~np.repeat(allowed, sizes)[None, :]] = -np.inf
    at, node = np.argmax(gain, axis=1), np.arange(len(gain))
    split = gain[node, at] > 1e-9
    feature = np.where(split, np.repeat(np.arange(len(starts)), sizes)[at], -1)
    last = at - starts[np.maximum(feature, 0)]
    sides = [np.where(split, x[node, at], y) for x, y in ((left_g, all_g[:, 0]), (left_n, all_n[:, 0]), (right_g, 0), (right_n, 0))]
    return feature, last, sides[0] / (sides[1] + penalty), sides[2] / (sides[3] + penalty)


def boosted_scores(rows: DataFrame, fits: list, how: Boosting = Boosting()) -> tuple[RDD, list[list[Tree]]]:
    """Blocks with the scores of every fit for every row, and the trees of every step.

    rows: listing_id, label, features. fits: for each, the condition on the rows it trains on.
    """
    spark, sc = rows.sparkSession, rows.sparkSession.sparkContext
    sc.setCheckpointDir(new_path(spark, "boosting"))
    cuts = cut_points(rows, how.bins)
    starts = np.concatenate(([0], np.cumsum([len(c) + 1 for c in cuts])))
    width, starts = int(starts[-1]), starts[:-1]
    trains = rows.select(*[c.alias(f"fit {k}") for k, c in enumerate(fits)], "label")
    first = trains.agg(*[F.avg(F.when(F.col(f"fit {k}"), F.col("label"))).alias(str(k)) for k in range(len(fits))]).first()
    base = np.array([x or 0.0 for x in first])

    def block(part: Iterator) -> Iterator[Block]:
        got = list(part)
        if got:
            x = np.array([row["features"] for row in got])
            codes = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1).astype(np.int32)
            row, f = np.nonzero(codes)
            filled = row, starts[f] + codes[row, f]
            ids, label = np.array([row["listing_id"] for row in got]), np.array([row["label"] for row in got])
            yield Block(codes, filled, ids, label, np.array([row["trains"] for row in got]), np.tile(base, (len(got), 1)))

    chosen = rows.select("listing_id", "label", F.array(*fits).alias("trains"), vector_to_array("features").alias("features"))
    state = chosen.rdd.mapPartitions(block).persist(StorageLevel.MEMORY_AND_DISK)
    done: list[list[Tree]] = []
    pending: list[list[Tree]] = []
    for tree in range(how.trees):
        step = [Tree([]) for _ in fits]
        for _ in range(how.depth):

            def sums(part: Iterator[Block], step=step, pending=tuple(pending), tree=tree) -> Iterator:
                for one in part:
                    now = one.with_trees(list(pending))
                    for k, grown in enumerate(step):
                        taken = (now.trains[:, k] & (drawn(now.ids, how.seed, k, tree) < how.rows)).astype(float)
                        rest = taken * (now.label - now.score[:, k])
                        yield k, np.stack([now.sums(grown, w, starts, width) for w in (rest, taken)])

            def split(k_sums: tuple, tree=tree) -> tuple:
                k, both = k_sums
                order = np.random.default_rng((how.seed, k, tree)).permutation(len(starts))
                allowed = np.zeros(len(starts), bool)
                allowed[order[: max(1, round(how.columns * len(starts)))]] = True
                return k, best_splits(both, starts, allowed, how.penalty)

            parts = state.mapPartitions(sums)
            if state.getNumPartitions() > 1:
                parts = parts.reduceByKey(np.add, min(len(fits), state.getNumPartitions()))
            for k, (feature, last, left, right) in parts.map(split).collect():
                step[k].levels.append((feature, last))
                step[k].values = how.rate * np.stack([left, right], axis=1).ravel()
        done.append(step)
        pending.append(step)
        if len(pending) == REFRESH or tree == how.trees - 1:
            newer = state.map(lambda one, trees=tuple(pending): one.with_trees(list(trees))).persist(StorageLevel.MEMORY_AND_DISK)
            newer.checkpoint()
            newer.count()
            state.unpersist()
            state, pending = newer, []
    return state, done


def scores(own: Rows, coded: Layout, trains: np.ndarray, fit: int, how: Boosting) -> np.ndarray:
    """What ``boosted_scores`` gives one fit, by a task that has all rows."""
    sizes = coded.places + 1
    starts, width = np.cumsum(sizes) - sizes, int(sizes.sum())
    columns, n = np.ascontiguousarray(own.codes.T), len(own.ids)
    bins = []  # of every value of a column but 0, the place in a histogram
    for c in range(len(columns)):
        feature = coded.features(c)[1:]
        bins.append(starts[feature] + np.arange(1, len(feature) + 1) - coded.first[feature] + 1)
    row, score = np.arange(n), np.full(n, own.label[trains].mean() if trains.any() else 0.0)
    for tree in range(how.trees):
        on = np.flatnonzero(trains & (drawn(own.ids, how.seed, fit, tree) < how.rows))
        seen, rest, node = columns[:, on], own.label[on] - score[on], np.zeros(n, np.int64)
        allowed = np.zeros(len(starts), bool)
        allowed[np.random.default_rng((how.seed, fit, tree)).permutation(len(starts))[: max(1, round(how.columns * len(starts)))]] = True
        for level in range(how.depth):
            here, nodes = node[on], 1 << level
            sums = np.zeros((2, nodes, width))
            for c, places in enumerate(bins):
                size = len(places) + 1
                key = here * size + seen[c]
                for out, weight in zip(sums, (rest, None), strict=True):
                    out[:, places] = np.bincount(key, weight, nodes * size).reshape(nodes, size)[:, 1:]
            whole = np.stack([np.bincount(here, weight, nodes) for weight in (rest, None)])
            sums[:, :, starts] = whole[:, :, None] - np.add.reduceat(sums, starts, axis=2)
            feature, last, left, right = best_splits(sums, starts, allowed, how.penalty)
            low = np.where(feature >= 0, coded.first[feature] + last, 1)[node]
            high = np.where(feature >= 0, coded.first[feature] + coded.places[feature] - 1, 0)[node]
            value = columns.ravel()[coded.column[feature][node] * n + row]
            node = 2 * node + ((value >= low) & (value <= high))
        score = score + (how.rate * np.stack([left, right], axis=1).ravel())[node]
    return score


def fold_outcomes(rows: DataFrame, tests: list, how: Boosting = Boosting(), groups: list[range] = ()) -> list[tuple[float, float, float]]:
    """For every test condition: R² of the log price, R² of the price and mean absolute error of the price on its rows,
    of trees trained on all others. groups: see ``bins.layout``."""
    fits, coded = len(tests), layout(cut_points(rows, how.bins), groups)
    if coded.fits(rows.count()):

        def trained(k: int, part: Iterator) -> Iterator:
            own = gathered(part)
            if own is not None:
                rest = own.tests[:, k]
                yield k, measures(own.label[rest], scores(own, coded, own.trains[:, k], k, how)[rest])

        batches = packed(rows, coded, F.col("listing_id"), F.col("label"), [~t for t in tests], tests)
        sums = dict(to_every(batches, fits).mapPartitionsWithIndex(trained).collect())
        return [outcome(sums[k]) for k in range(fits)]
    state, _ = boosted_scores(rows, [~t for t in tests], how)

    def measure(part: Iterator[Block]) -> Iterator:
        for one in part:
            for k in range(fits):
                rest = ~one.trains[:, k]
                yield k, measures(one.label[rest], one.score[rest, k])

    sums = dict(state.mapPartitions(measure).reduceByKey(np.add).collect())
    state.unpersist()
    return [outcome(sums[k]) for k in range(fits)]
