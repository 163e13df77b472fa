"""A forest grown tree by tree, each in one task (A-M2).

Trees do not depend on each other, but grown level by level for all trees at once every node of every tree passes
the driver, and a forest of depth 30 takes thousands of jobs. Here the rows go as bins (``bins``) to every task, and
a task grows its share of the trees, a level at a time. The trees are a table; rows are scored where the trees are,
and a row's scores add up. Nothing of the rows or the trees passes the driver.

As in MLlib a row is drawn by a Poisson number of times, a node is split by the best of √features drawn for it, and
is a leaf if none of them gains. Draws come from hashes and seeds, so the result does not depend on how rows are
dealt, but for the last digits of sums.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
from pyspark import RDD
from pyspark.ml import Model
from pyspark.ml.param.shared import HasFeaturesCol
from pyspark.ml.regression import RandomForestRegressor
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystead.plans.bins import Layout, Rows, cut_points, gathered, layout, measures, outcome, packed, to_every
from keystead.plans.boosting import drawn
from keystead.storage import materialise

LOOKUP_CELLS = 1 << 21  # of the table of drawn features that is searched at once
LARGE_NODE = 1500  # rows from which a node is split by itself
EQUAL = 1e-9  # gains that differ by less do so by rounding; the first feature and bin count
FEW_ROWS = 400  # below which rows of a node are scored each by itself
ROWS_A_GROUP = 500_000  # rows that one task scores
SCORES_A_RECORD = 100_000


@dataclass(frozen=True)
class Forest:
    trees: int = 500
    depth: int = 30
    rows: float = 0.75
    seed: int = 42
    bins: int = 32


def forest_of(estimator: RandomForestRegressor) -> Forest | None:
    """The same sizes for trees grown in tasks, or None if it asks for what these do not have."""
    plain = RandomForestRegressor(featureSubsetStrategy="sqrt")
    asked = ("featureSubsetStrategy", "minInstancesPerNode", "minInfoGain", "minWeightFractionPerNode", "bootstrap", "impurity", "weightCol", "thresholds")
    if any(estimator.isDefined(p) and estimator.getOrDefault(p) != plain.getOrDefault(p) for p in asked if estimator.hasParam(p) and plain.isDefined(p)) or estimator.isSet("weightCol"):
        return None
    return Forest(estimator.getNumTrees(), estimator.getMaxDepth(), estimator.getSubsamplingRate(), estimator.getSeed(), estimator.getMaxBins())


@dataclass
class Tree:
    """Of every node: column and the values there that go to the right, the left child (the right one is behind it; a
    leaf is its own child), and the mean label."""

    column: np.ndarray
    low: np.ndarray
    high: np.ndarray
    child: np.ndarray
    value: np.ndarray

    def scores(self, columns: np.ndarray) -> np.ndarray:
        """The value of every row's leaf. Rows of a node go on together while they are many, then each by itself."""
        out = np.empty(columns.shape[1])
        left, few = [(0, np.arange(columns.shape[1]))], []
        while left:
            node, rows = left.pop()
            child = self.child[node]
            if child == node:
                out[rows] = self.value[node]
            elif len(rows) < FEW_ROWS:
                few.append((node, rows))
            else:
                seen = columns[self.column[node]][rows]
                right = (seen >= self.low[node]) & (seen <= self.high[node])
                left += [(child, rows[~right]), (child + 1, rows[right])]
        if few:
            row = np.concatenate([rows for _, rows in few])
            here = np.repeat([node for node, _ in few], [len(rows) for _, rows in few])
            flat, n = columns.ravel(), columns.shape[1]
            while len(row):
                seen = flat[self.column[here].astype(np.int64) * n + row]
                here = self.child[here] + ((seen >= self.low[here]) & (seen <= self.high[here]))
                inner = self.child[here] != here
                if not inner.all():
                    out[row[~inner]] = self.value[here[~inner]]
                    row, here = row[inner], here[inner]
        return out

    def to_bytes(self) -> list[bytes]:
        return [x.tobytes() for x in (self.column, self.low, self.high, self.child, self.value)]

    @staticmethod
    def from_bytes(column: bytes, low: bytes, high: bytes, child: bytes, value: bytes) -> Tree:
        return Tree(*[np.frombuffer(x, np.int32) for x in (column, low, high, child)], np.frombuffer(value))


TREES = "tree int, column binary, low binary, high binary, child binary, value binary"


def poisson(u: np.ndarray, rate: float) -> np.ndarray:
    """Poisson numbers of evenly drawn ones."""
    terms = [math.exp(-rate)]
    for k in range(1, 40):
        terms.append(terms[-1] * rate / k)
    return np.searchsorted(np.cumsum(terms), u, "right")


def subsets(draw: np.random.Generator, n: int, features: int, size: int) -> np.ndarray:
    """For each of n nodes so many different features, in order (Floyd's way)."""
    out = np.empty((n, size), np.int64)
    for j in range(size):
        one = draw.integers(0, features - size + j + 1, n)
        out[:, j] = np.where((out[:, :j] == one[:, None]).any(axis=1), features - size + j, one)
    return np.sort(out, axis=1)


@dataclass
class Nodes:
    """Nodes of one level by their place in it, and their rows in the same order; bins are held by column."""

    at: np.ndarray
    counts: np.ndarray
    codes: np.ndarray
    y: np.ndarray
    w: np.ndarray

    def only(self, some: np.ndarray) -> Nodes | None:
        if some.all():
            return self
        if not some.any():
            return None
        rows = np.flatnonzero(np.repeat(some, self.counts))
        return Nodes(self.at[some], self.counts[some], self.codes[:, rows], self.y[rows], self.w[rows])

    def children(self, column: np.ndarray, low: np.ndarray, high: np.ndarray, left: np.ndarray) -> Nodes:
        """The nodes of the next level: of each node the rows on the left, then those on the right."""
        at, index, ends = np.repeat(self.at, self.counts), np.arange(len(self.y)), np.cumsum(self.counts)
        seen = self.codes.ravel()[column[at] * len(index) + index]
        right = (seen >= low[at]) & (seen <= high[at])
        so_far = np.cumsum(right)
        before = np.append(0, so_far[ends - 1])
        rights = np.diff(before)
        so_far -= np.repeat(before[:-1], self.counts)
        order = np.empty(len(index), np.int64)
        order[np.where(right, np.repeat(ends - rights - 1, self.counts) + so_far, index - so_far)] = index
        places = np.stack([left[self.at], left[self.at] + 1], axis=1).ravel()
        counts = np.stack([self.counts - rights, rights], axis=1).ravel()
        return Nodes(places, counts, np.ascontiguousarray(self.codes[:, order]), self.y[order], self.w[order])


class Grower:
    """Grows trees on rows of one layout, given by column."""

    def __init__(self, how: Layout, depth: int, codes: np.ndarray):
        self.how, self.depth, self.columns = how, depth, np.ascontiguousarray(codes.T)
        self.features = len(how.cuts)
        self.places = how.places
        self.drawn = math.ceil(math.sqrt(self.features))
        self.feature = [how.features(c) for c in range(len(how.sizes))]

    def split(self, codes: np.ndarray, w: np.ndarray, g: np.ndarray, counts: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, ...]:
        """Feature (-1 for none) and first place on its right for each node; rows are in the order of the nodes.

        w, g: how often a row counts, and its label so often; counts: rows of a node; chosen: the features it may use.
        """
        nodes, p = len(counts), self.features
        at = np.repeat(np.arange(nodes), counts)
        starts = np.cumsum(counts) - counts
        all_w, all_g = np.add.reduceat(w, starts), np.add.reduceat(g, starts)
        sizes = self.places[chosen]
        ends = np.cumsum(sizes.ravel()).reshape(sizes.shape)
        begins, total = ends - sizes, int(ends[-1, -1])
        feature, place = np.full(nodes, -1), np.zeros(nodes, np.int64)
        if not total:
            return feature, place
        # Where the second bin of a feature would be, had it the place 0 in its column; far below 0 if it may not be used.
        none = -(1 << 30)
        table = np.full((nodes, p + 1), none, np.int32)
        table[np.arange(nodes)[:, None], chosen] = begins - self.how.first[chosen]
        table, base = table.ravel(), at * (p + 1)
        found, rows = [], []
        for c, of in enumerate(self.feature):
            value = codes[c]
            spot = table[base + of[value]]
            hit = np.flatnonzero(spot > none)
            found.append(spot[hit] + value[hit].astype(np.int64))
            rows.append(hit)
        found, rows = np.concatenate(found), np.concatenate(rows)
        sums = [np.append(0.0, np.cumsum(np.bincount(found, x[rows], total))) for x in (w, g)]
        whole = np.repeat(ends.ravel(), sizes.ravel())
        node = np.repeat(np.arange(nodes), sizes.sum(axis=1))
        right_w, right_g = (x[whole] - x[:-1] for x in sums)
        left_w, left_g = all_w[node] - right_w, all_g[node] - right_g
        ok = (right_w > 0) & (left_w > 0)
        gain = np.full(total, -1.0)
        gain[ok] = right_g[ok] ** 2 / right_w[ok] + left_g[ok] ** 2 / left_w[ok] - (all_g**2 / all_w)[node[ok]]
        some = np.flatnonzero(sizes.sum(axis=1))
        best = np.full(nodes, -1.0)
        best[some] = np.maximum.reduceat(gain, begins[some, 0])
        top = np.flatnonzero((gain > best[node] - EQUAL) & (gain > EQUAL))
        top = top[np.append(True, node[top][1:] != node[top][:-1])] if len(top) else top
        slot = np.searchsorted(ends.ravel(), top, "right")  # of the drawn features of all nodes
        feature[node[top]] = chosen.ravel()[slot]
        place[node[top]] = top - begins.ravel()[slot]
        return feature, place

    def split_one(self, rows: np.ndarray, w: np.ndarray, g: np.ndarray, chosen: np.ndarray) -> tuple[int, int]:
        """The same for one node of many rows, by the columns of its features."""
        all_w, all_g = w.sum(), g.sum()
        most, best = 0.0, (-1, 0)
        column = self.how.column[chosen]
        for c in np.unique(column):
            sums = None
            for f in self._alike(chosen[column == c]):
                if sums is None:
                    value = self.columns[c][rows]
                    sums = [np.bincount(value, x, self.how.sizes[c]) for x in (w, g)]
                if self.places[f[0]] == 1:
                    right_w, right_g = (x[self.how.first[f]] for x in sums)
                else:
                    own = slice(self.how.first[f[0]], self.how.first[f[0]] + self.places[f[0]])
                    right_w, right_g = (np.cumsum(x[own][::-1])[::-1] for x in sums)
                ok = np.flatnonzero((right_w > 0) & (right_w < all_w))
                if len(ok):
                    right_w, right_g = right_w[ok], right_g[ok]
                    gain = right_g**2 / right_w + (all_g - right_g) ** 2 / (all_w - right_w) - all_g**2 / all_w
                    at = np.argmax(gain > gain.max() - EQUAL)
                    if gain[at] > most + EQUAL:
                        most, best = gain[at], (f[ok[at]], 0) if self.places[f[0]] == 1 else (f[0], ok[at])
        return best

    def _alike(self, features: np.ndarray) -> list[np.ndarray]:
        """Features with two bins together, those with more alone, those with one left out."""
        two = features[self.places[features] == 1]
        return [*([two] if len(two) else []), *(features[k : k + 1] for k in np.flatnonzero(self.places[features] > 1))]

    def splits(self, small: Nodes, g: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, ...]:
        """The same for any number of small nodes, some at a time."""
        ends, step = np.cumsum(small.counts), max(1, LOOKUP_CELLS // (self.features + 1))
        parts = []
        for k in range(0, len(ends), step):
            own = slice(k, k + step)
            rows = slice(ends[k] - small.counts[k], ends[own][-1])
            parts.append(self.split(small.codes[:, rows], small.w[rows], g[rows], small.counts[own], chosen[own]))
        return np.concatenate([f for f, _ in parts]), np.concatenate([p for _, p in parts])

    def grow(self, label: np.ndarray, weight: np.ndarray, draw: np.random.Generator) -> Tree:
        """A tree on the rows as often as ``weight`` says."""
        on = np.flatnonzero(weight)
        if not len(on):  # as of no row
            return Tree(*[np.zeros(1, np.int32), np.ones(1, np.int32), np.zeros(1, np.int32), np.zeros(1, np.int32)], np.zeros(1))
        y, w = label[on], weight[on].astype(float)
        mean = (w * y).sum() / w.sum()
        large, small = self._sorted_out([(0, on, y - mean, w)], None)
        size, nodes, levels = 1, 0, []
        for level in range(self.depth + 1):
            value, feature, place = np.zeros(size), np.full(size, -1), np.zeros(size, np.int64)
            chosen = subsets(draw, size, self.features, self.drawn)
            for at, rows, y, w in large:
                g = w * y
                value[at] = g.sum() / w.sum()
                if level < self.depth and y.min() < y.max():
                    feature[at], place[at] = self.split_one(rows, w, g, chosen[at])
            if small is not None:
                starts, g = np.cumsum(small.counts) - small.counts, small.w * small.y
                value[small.at] = np.add.reduceat(g, starts) / np.add.reduceat(small.w, starts)
                mixed = np.minimum.reduceat(small.y, starts) < np.maximum.reduceat(small.y, starts)
                if level == self.depth or not mixed.any():
                    small = None
                else:
                    small, g = small.only(mixed), g if mixed.all() else g[np.repeat(mixed, small.counts)]
                    feature[small.at], place[small.at] = self.splits(small, g, chosen[small.at])
            inner = feature >= 0
            low = np.where(inner, self.how.first[feature] + place, 1)
            high = np.where(inner, self.how.first[feature] + self.places[feature] - 1, 0)
            column = np.where(inner, self.how.column[feature], 0)
            left = 2 * (np.cumsum(inner) - 1)
            levels.append([column, low, high, np.where(inner, nodes + size + left, nodes + np.arange(size)), mean + value])
            nodes, size = nodes + size, 2 * int(inner.sum())
            if not size:
                break
            parts = []
            for at, rows, y, w in large:
                if inner[at]:
                    seen = self.columns[column[at]][rows]
                    right = (seen >= low[at]) & (seen <= high[at])
                    parts += [(left[at] + k, rows[side], y[side], w[side]) for k, side in enumerate((~right, right))]
            if small is not None:
                small = small.only(inner[small.at])
            large, small = self._sorted_out(parts, small and small.children(column, low, high, left))
        column, low, high, child, value = (np.concatenate(x) for x in zip(*levels, strict=True))
        return Tree(column.astype(np.int32), low.astype(np.int32), high.astype(np.int32), child.astype(np.int32), value)

    def _sorted_out(self, parts: list[tuple], small: Nodes | None) -> tuple[list[tuple], Nodes | None]:
        """Nodes with many rows one by one, and those with few, with what there is already, together."""
        few = [p for p in parts if len(p[1]) < LARGE_NODE]
        if few:
            rows, y, w = (np.concatenate([p[k] for p in few]) for k in (1, 2, 3))
            more = Nodes(np.array([p[0] for p in few]), np.array([len(p[1]) for p in few]), self.columns[:, rows], y, w)
            small = more if small is None else Nodes(*[np.concatenate([getattr(x, n) for x in (small, more)], axis=-1) for n in ("at", "counts", "codes", "y", "w")])
        return [p for p in parts if len(p[1]) >= LARGE_NODE], small


def _tree(grower: Grower, rows: Rows, trains: np.ndarray, how: Forest, fit: int, tree: int) -> Tree:
    weight = poisson(drawn(rows.ids, how.seed, fit, tree), how.rows) * trains
    return grower.grow(rows.label, weight, np.random.default_rng((how.seed, fit, tree)))


def shares(trees: int, cores: int, fits: int = 1) -> int:
    """In how many parts the trees of a fit are grown, so that all fits together have two tasks a core."""
    return max(1, min(trees, -(-2 * cores // fits)))


def fit(rows: DataFrame, how: Forest, groups: list[range] = ()) -> ForestModel | None:
    """The forest on ``label`` and ``features``, or None if the rows are more than a task can hold.

    groups: see ``bins.layout``.
    """
    coded = layout(cut_points(rows, how.bins), groups)
    if not coded.fits(rows.count()):
        return None
    spark = rows.sparkSession
    tasks = shares(how.trees, spark.sparkContext.defaultParallelism)
    ids = F.col("listing_id") if "listing_id" in rows.columns else F.lit(0)

    def grown(task: int, part: Iterator) -> Iterator[tuple]:
        own = gathered(part)
        if own is not None:
            grower, every = Grower(coded, how.depth, own.codes), np.ones(len(own.ids), bool)
            for tree in range(task, how.trees, tasks):
                yield tree, *_tree(grower, own, every, how, 0, tree).to_bytes()

    trees = to_every(packed(rows, coded, ids, F.col("label")), tasks).mapPartitionsWithIndex(grown)
    return ForestModel(coded, materialise(spark.createDataFrame(trees, TREES, verifySchema=False), "trees"))


def fold_outcomes(rows: DataFrame, tests: list, how: Forest, groups: list[range] = ()) -> list[tuple[float, float, float]] | None:
    """For every test condition R² of the log price, R² of the price and mean absolute error of the price on its rows, of
    a forest grown on all others; None if the rows are more than a task can hold."""
    coded = layout(cut_points(rows, how.bins), groups)
    if not coded.fits(rows.count()):
        return None
    fits = len(tests)
    parts = shares(how.trees, rows.sparkSession.sparkContext.defaultParallelism, fits)

    def scored(task: int, part: Iterator) -> Iterator[tuple]:
        own, k, share = gathered(part), task // parts, task % parts
        if own is not None:
            grower, test = Grower(coded, how.depth, own.codes), np.flatnonzero(own.tests[:, k])
            total, columns = np.zeros(len(test)), grower.columns[:, test]
            for tree in range(share, how.trees, parts):
                total += _tree(grower, own, own.trains[:, k], how, k, tree).scores(columns)
            for at in range(0, len(test), SCORES_A_RECORD):
                some = slice(at, at + SCORES_A_RECORD)
                yield (k, at), (own.label[test[some]], total[some])

    batches = packed(rows, coded, F.col("listing_id"), F.col("label"), [~t for t in tests], tests)
    sums = to_every(batches, fits * parts).mapPartitionsWithIndex(scored).reduceByKey(lambda a, b: (a[0], a[1] + b[1]), fits)
    found = sums.map(lambda one: (one[0][0], measures(one[1][0], one[1][1] / how.trees))).reduceByKey(np.add, 1).collectAsMap()
    return [outcome(found.get(k, np.zeros(8))) for k in range(fits)]


class ForestModel(Model, HasFeaturesCol, MLReadable, MLWritable):
    """A fitted forest; adds ``prediction``."""

    def __init__(self, how: Layout | None = None, trees: DataFrame | None = None):
        super().__init__()
        self.how, self.trees = how, trees
        self._setDefault(featuresCol="features")

    def copy(self, extra=None) -> ForestModel:
        out = super().copy(extra)
        out.how, out.trees = self.how, self.trees
        return out

    def _transform(self, dataset: DataFrame) -> DataFrame:
        spark = dataset.sparkSession
        rows = materialise(dataset.withColumn("row of the table", F.monotonically_increasing_id()), "to_score")
        features = rows.withColumn("features", F.col(self.getFeaturesCol()))
        batches = packed(features, self.how, F.col("row of the table"), F.lit(0.0))
        pairs = self.scores(batches, rows.count()).flatMap(lambda one: zip(one[0].tolist(), one[1].tolist(), strict=True))
        scored = materialise(spark.createDataFrame(pairs, "`row of the table` long, prediction double", verifySchema=False), "scores")
        return rows.join(scored, "row of the table").drop("row of the table")

    def scores(self, batches: RDD, rows: int) -> RDD:
        """Numbers and scores of the rows of every batch. A task scores a group of batches by a share of the trees."""
        trees, how = self.trees, self.how
        number = trees.count()
        groups = -(-rows // ROWS_A_GROUP) or 1
        parts = shares(number, trees.sparkSession.sparkContext.defaultParallelism, groups)
        tasks = groups * parts
        dealt_trees = trees.rdd.flatMap(lambda t: [(g * parts + t[0] % parts, (None, tuple(t))) for g in range(groups)])
        dealt_rows = batches.flatMap(lambda one: [((one[0][0] * 31 + one[0][1]) % groups * parts + k, one) for k in range(parts)])

        def score(part: Iterator) -> Iterator[tuple]:
            got = [one for _, one in part]
            own = [Tree.from_bytes(*t[1:]) for key, t in sorted((x for x in got if x[0] is None), key=lambda x: x[1][0])]
            left = sorted((x for x in got if x[0] is not None), key=lambda x: x[0])  # the same in every task of a group
            while left:
                k = int(np.searchsorted(np.cumsum([len(one.ids) for _, one in left]), SCORES_A_RECORD)) + 1
                some, left = left[:k], left[k:]
                columns = np.concatenate([one.codes.T for _, one in some], axis=1)
                yield some[0][0], (np.concatenate([one.ids for _, one in some]), sum((t.scores(columns) for t in own), np.zeros(columns.shape[1])))

        sums = dealt_trees.union(dealt_rows).partitionBy(tasks, int).mapPartitions(score)
        return sums.reduceByKey(lambda a, b: (a[0], a[1] + b[1])).map(lambda one: (one[1][0], one[1][1] / number))

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: ForestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        spark, kept = self.sparkSession, {k: [x.tolist() for x in v] if k == "cuts" else v.tolist() for k, v in asdict(self.model.how).items()}
        DefaultParamsWriter.saveMetadata(self.model, path, spark, extraMetadata={"layout": kept})
        self.model.trees.write.parquet(f"{path}/trees")


class _Reader(MLReader):
    def load(self, path: str) -> ForestModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        kept = metadata["layout"]
        how = Layout([np.array(c, float) for c in kept["cuts"]], *[np.array(kept[k], np.int64) for k in ("column", "first", "sizes")])
        model = ForestModel(how, self.sparkSession.read.schema(TREES).parquet(f"{path}/trees"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
