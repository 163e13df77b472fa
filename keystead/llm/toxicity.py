"""Operator 3, toxicity by subword embeddings averaged into a linear softmax.

A word is the mean of the embeddings of its character n-grams and of itself, so
unseen misspellings share vectors with the words they come from. A window of a
few distinct words is the mean of its words and goes through a softmax of two classes;
embeddings and softmax are trained together in numpy. Only documents are
labelled, and few of a toxic document's windows are toxic: training starts with
all windows under their document's label and goes on with only the likeliest
windows of toxic documents. A document's score is that of its likeliest window,
brought to a probability by a logistic fit on sampled documents kept from training, so a long text hides nothing.

Training uses at most ``documents`` labelled rows, half of them toxic if there
are so many, and at most ``windows`` evenly spaced windows of each.

Defined cases: null, empty and wordless texts get the score of a window without
words; a null label is no label, and a document labelled both ways counts as
toxic; without labels of both kinds every score is 0; repeated rows are scored
each; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystead.llm.common import batched, texts

WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class Settings:
    documents: int = 6000
    windows: int = 100
    window_words: int = 12
    buckets: int = 1 << 18
    least_documents: int = 4
    apart_from: int = 200
    dimensions: int = 8
    rounds: int = 8
    batch: int = 128
    steps: int = 400
    rate: float = 0.5
    seed: int = 7


def grams(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The whole of every word and its n-grams of 3 and 4 characters: index of the word, bucket."""
    sizes = np.fromiter((len(word) + 2 for word in words), np.int64, len(words))
    signs = "".join(f"<{word}>" for word in words).encode("utf-32-le", "surrogatepass")
    signs = np.frombuffer(signs, "<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), sizes)
    ends = np.cumsum(sizes)
    inside = np.arange(len(signs)) - np.repeat(ends - sizes, sizes)
    prime, spread = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
    powers = np.cumprod(np.full(int(sizes.max(initial=1)), prime))
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    owners, hashes = [np.arange(len(words))], [np.add.reduceat(signs * powers[inside], ends - sizes)]
    for n in (3, 4):
        at = np.flatnonzero(inside + n <= sizes[owner])
        value = np.full(len(at), n, np.uint64)
        for k in range(n):
            value = value * prime + signs[at + k]
        owners.append(owner[at])
        hashes.append(value)
    mixed = np.concatenate(hashes) * spread
    return np.concatenate(owners), ((mixed >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)


def windows(text: str, size: int) -> list[list[str]]:
    """The distinct words of a text, in order of first use, in windows."""
    words = list(dict.fromkeys(WORD.findall(text.lower())))
    return [words[i : i + size] for i in range(0, len(words), size)]


@dataclass
class Model:
    """What scoring needs: the share of each bucket in the logit, the bias, and the fit to a probability."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float


class Bags:
    """Words of many windows, and the buckets of each distinct word, laid end to end."""

    def __init__(self, rows: Iterable[tuple[int, list[str]]], buckets: int, size: int):
        vocabulary: dict[str, int] = {}
        words, lengths, owner, labels = array("i"), array("i"), array("i"), []
        for label, found in rows:
            for window in found:
                own = window.split(" ")
                words.extend([vocabulary.setdefault(word, len(vocabulary)) for word in own])
                lengths.append(len(own))
                owner.append(len(labels))
            if found:
                labels.append(label)
        self.size, self.labels = size, np.array(labels)
        self.words, self.lengths, self.owner = (np.array(x, np.int64) for x in (words, lengths, owner))
        self.firsts = np.cumsum(self.lengths) - self.lengths
        distinct, flats, sizes = list(vocabulary), [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for at in range(0, len(distinct), 20_000):
            of, flat = grams(distinct[at : at + 20_000], buckets)
            flats.append(flat[np.argsort(of, kind="stable")])
            sizes.append(np.bincount(of))
        self.flat, self.sizes = np.concatenate(flats), np.concatenate(sizes)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def spread(self, buckets: int) -> np.ndarray:
        """In how many documents each bucket occurs."""
        out = np.zeros(buckets, np.int64)
        each = np.repeat(self.owner, self.lengths)
        for first in range(0, len(self.labels), 50):
            lo, hi = np.searchsorted(each, [first, first + 50])
            held = np.unique((each[lo:hi] - first) * len(self.sizes) + self.words[lo:hi])
            word = held % len(self.sizes)
            document = np.repeat(held // len(self.sizes), self.sizes[word])
            used = self.flat[spans(self.starts[word], self.sizes[word])]
            out += np.bincount(np.unique(document * buckets + used) % buckets, minlength=buckets)
        return out

    def means(self, weights: np.ndarray) -> np.ndarray:
        """Mean weight of every window; words that a short window lacks weigh nothing."""
        words = np.add.reduceat(weights[self.flat], self.starts) / self.sizes
        return np.add.reduceat(words[self.words], self.firsts) / self.size


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1 ... of every span, end to end."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1]) + np.repeat(starts - ends + lengths, lengths)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Trainer:
    """Embeddings and softmax, moved together by stochastic gradients of adaptive size."""

    def __init__(self, bags: Bags, settings: Settings, usable: np.ndarray):
        self.bags, self.s, self.usable = bags, settings, usable
        self.random = np.random.default_rng(settings.seed)
        # what is never trained stays zero and weighs nothing
        self.table = np.zeros((settings.buckets, settings.dimensions), np.float32)
        self.softmax = np.zeros((settings.dimensions, 2), np.float32)
        self.softmax[:, 1] = self.random.normal(0, 0.5, settings.dimensions)
        self.bias = np.zeros(2, np.float32)
        self.seen = np.full(settings.buckets, 1e-8)

    def weights(self) -> np.ndarray:
        """What each bucket adds to the logit of the toxic class."""
        return self.table @ (self.softmax[:, 1] - self.softmax[:, 0])

    def logits(self) -> np.ndarray:
        return self.bags.means(self.weights()) + self.bias[1] - self.bias[0]

    def step(self, chosen: np.ndarray, target: np.ndarray, weight: np.ndarray) -> None:
        bags, lengths = self.bags, self.bags.lengths[chosen]
        words, place = np.unique(bags.words[spans(bags.firsts[chosen], lengths)], return_inverse=True)
        sizes = bags.sizes[words]
        buckets = bags.flat[spans(bags.starts[words], sizes)]
        word_starts, starts = np.cumsum(sizes) - sizes, np.cumsum(lengths) - lengths
        vectors = np.add.reduceat(self.table[buckets], word_starts) / sizes[:, None]
        means = np.add.reduceat(vectors[place], starts) / bags.size
        scores = means @ self.softmax + self.bias
        scores = np.exp(scores - scores.max(axis=1, keepdims=True))
        error = scores / scores.sum(axis=1, keepdims=True)
        error[np.arange(len(chosen)), target] -= 1
        error *= weight[:, None]
        down = (error @ self.softmax.T) / bags.size
        self.softmax -= (self.s.rate * means.T @ error / len(chosen)).astype(np.float32)
        self.bias -= (self.s.rate * error.mean(axis=0)).astype(np.float32)
        window = np.repeat(np.arange(len(chosen)), lengths)
        used, where = np.unique(buckets, return_inverse=True)
        owner = np.repeat(np.arange(len(words)), sizes)
        summed = np.empty((len(used), down.shape[1]))
        for d in range(down.shape[1]):
            word = np.bincount(place, down[window, d], len(words)) / sizes
            summed[:, d] = np.bincount(where, word[owner], len(used))
        summed *= self.usable[used, None]
        self.seen[used] += (summed * summed).mean(axis=1)
        self.table[used] -= (self.s.rate * summed / np.sqrt(self.seen[used])[:, None]).astype(np.float32)

    def run(self, chosen: np.ndarray, target: np.ndarray) -> None:
        weight = np.where(target == 1, 0.5 / max(target.mean(), 1e-6), 0.5 / max(1 - target.mean(), 1e-6))
        batch = min(self.s.batch, max(16, len(chosen) // 40))
        # few windows are gone through more often, so that they make as many steps
        for _ in range(max(1, round(self.s.steps * batch / len(chosen)))):
            order = self.random.permutation(len(chosen))
            for at in range(0, len(order), batch):
                now = order[at : at + batch]
                self.step(chosen[now], target[now], weight[now])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a one-feature logistic regression by Newton's method, lightly ridged."""
    middle, spread = x.mean(), x.std() + 1e-9
    z, a, b = (x - middle) / spread, 1.0, 0.0
    for _ in range(30):
        p = sigmoid(a * z + b)
        gradient = np.array([((p - y) * weight * z).sum() + 0.5 * a, ((p - y) * weight).sum()])
        v = p * (1 - p) * weight
        curve = np.array([[(v * z * z).sum() + 0.5, (v * z).sum()], [(v * z).sum(), v.sum() + 1e-6]])
        a, b = np.array([a, b]) - np.linalg.solve(curve, gradient)
    return float(a / spread), float(b - a * middle / spread)


def fit(rows: Iterable[tuple[int, list[str]]], toxic_share: float, settings: Settings) -> Model | None:
    """rows: label and windows, words joined by spaces, of each sampled document. toxic_share: of all labelled rows."""
    bags = Bags(rows, settings.buckets, settings.window_words)
    labels, owner = bags.labels, bags.owner
    if len(set(labels.tolist())) < 2:
        return None
    trainer = Trainer(bags, settings, bags.spread(settings.buckets) >= settings.least_documents)
    target = labels[owner]
    # every fourth document of either label is kept from training, for the fit to probabilities; with few, none
    apart = np.zeros(len(labels), bool)
    for label in (0, 1):
        if labels.sum() >= settings.apart_from:
            apart[np.flatnonzero(labels == label)[3::4]] = True
    firsts = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1])
    some = trainer.random.random(len(owner)) < 10 / np.bincount(owner)[owner]
    for round_ in range(settings.rounds):
        # at first every window of a toxic document, then its likeliest tenth; of others, their likeliest and a few
        place = np.lexsort((-trainer.logits(), owner))
        rank = np.empty(len(owner), int)
        rank[place] = np.arange(len(owner)) - np.repeat(firsts, np.bincount(owner))
        likely = rank < np.maximum(1, np.bincount(owner)[owner] // 10)
        chosen = np.where(target == 1, likely | (round_ < 2), some | (likely & (round_ > 1)))
        chosen = np.flatnonzero(chosen & ~apart[owner])
        trainer.run(chosen, target[chosen])
    best = np.maximum.reduceat(trainer.logits(), firsts)
    fitted = apart if len(set(labels[apart].tolist())) == 2 else np.ones(len(labels), bool)
    best, labels = best[fitted], labels[fitted]
    weight = np.where(labels == 1, toxic_share / labels.mean(), (1 - toxic_share) / (1 - labels.mean()))
    slope, shift = logistic(best, labels, weight)
    return Model(trainer.weights(), float(trainer.bias[1] - trainer.bias[0]), slope, shift)


def train(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> Model | None:
    """The model from labelled rows (doc_id, toxic). Ids are chosen by a hash, so equal tables give equal models."""
    settings = settings or Settings()
    marked = labels.where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marked = marked.where("doc_id is not null")
    total = {row["toxic"]: row["count"] for row in marked.groupBy("toxic").count().collect()}
    half = settings.documents // 2
    wanted = min(half, total.get(1, 0))
    order = F.xxhash64("doc_id")
    sample = marked.where("toxic = 1").orderBy(order, "doc_id").limit(wanted)
    sample = sample.unionByName(
        marked.where("toxic = 0").orderBy(order, "doc_id").limit(settings.documents - wanted)
    )
    size, most = settings.window_words, settings.windows

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in texts(batch):
                found = windows(text, size)
                step = max(1, -(-len(found) // most))
                out.append([" ".join(window) for window in found[::step]])
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.string())]
            named = [batch.column("doc_id"), batch.column("toxic").cast(pa.int64()), out]
            yield batched(["doc_id", "toxic", "windows"], kinds, named)

    # the sample has at most settings.documents rows of two numbers
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    rows = chosen.mapInArrow(cut, "doc_id long, toxic long, windows array<string>").collect()
    rows = sorted(((r["doc_id"], r["toxic"], r["windows"]) for r in rows), key=lambda r: (r[0], r[2]))
    share = total.get(1, 0) / max(1, sum(total.values()))
    return fit(((toxic, found) for _, toxic, found in rows), share, settings)


def scorer(model: Model | None, settings: Settings):
    """A function from texts to scores, with a bounded memory of word weights."""
    size, buckets = settings.window_words, settings.buckets
    known: dict[str, float] = {}

    def learn(words: set[str]) -> None:
        new = words - known.keys()
        if len(known) + len(new) > 400_000:
            known.clear()
            new = words
        owner, flat = grams(list(new), buckets)
        sums = np.bincount(owner, model.weights[flat], len(new)) / np.bincount(owner, minlength=len(new))
        known.update(zip(new, sums.tolist(), strict=True))

    def scores(many: list[str]) -> list[float]:
        if model is None:
            return [0.0] * len(many)
        found = [windows(text, size) for text in many]
        learn({word for own in found for window in own for word in window})
        best = [max([sum(map(known.__getitem__, window)) for window in own], default=0.0) for own in found]
        logit = np.array(best) / size + model.bias
        return sigmoid(model.slope * logit + model.shift).tolist()

    def in_parts(many: list[str]) -> list[float]:
        return [x for at in range(0, len(many), 256) for x in scores(many[at : at + 256])]

    return in_parts


def score(docs: DataFrame, model: Model | None, settings: Settings | None = None) -> DataFrame:
    """doc_id and score (0 to 1) of every document, from all its words."""
    settings = settings or Settings()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = scorer(model, settings)
        for batch in batches:
            found = scores(texts(batch))
            yield batched(["doc_id", "score"], [pa.int64(), pa.float64()], [batch.column("doc_id"), found])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def drop_toxic(
    docs: DataFrame, model: Model | None, threshold: float = 0.7, settings: Settings | None = None
) -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    settings = settings or Settings()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = scorer(model, settings)
        for batch in batches:
            yield batch.filter(pa.array([x < threshold for x in scores(texts(batch))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
