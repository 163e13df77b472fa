"""What the language model leaves on disk."""

import random
import time

import numpy as np

from keystead.llm import lm_score
from keystead.llm.common import held_out
from keystead.storage import names_in, new_path


def shuffled(spark) -> set[str]:
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = {files.apply(k).getName() for k in range(files.size())}
    return {name for name in names if name.startswith("shuffle_") and name.endswith(".data")}


def test_only_scores_stay_on_disk(spark):
    draw = random.Random(5)
    rows = [(k, " ".join(draw.choice("abcdefghij") for _ in range(30))) for k in range(60)] + [(None, None), (7, "a b"), (7, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    folder = new_path(spark, "x").rsplit("/", 1)[0]
    tables, files = set(names_in(spark, folder)), shuffled(spark)
    scores = lm_score.score(docs, held_out("doc_id", 7, 2), lm_score.Settings(block_tokens=300, parts=4))
    left = set(names_in(spark, folder)) - tables
    assert left and all(name.startswith("lm-scores-") for name in left)
    until = time.time() + 10  # files go in the background
    while shuffled(spark) - files and time.time() < until:
        time.sleep(0.2)
    assert len(shuffled(spark) - files) <= 8  # those of the sums, a few numbers each, may stay
    got = sorted((str(r.doc_id), r.n_tokens) for r in scores.collect())
    assert got == sorted((str(k), len((text or "").split()) + 1) for k, text in rows)


def test_order_by_pair_is_that_of_two_keys():
    draw = np.random.default_rng(3)
    hashes = draw.integers(0, 1 << 63, 50, dtype=np.uint64)[draw.integers(0, 50, 2000)] * np.uint64(2)
    context = draw.integers(0, 1 << lm_score.CONTEXT_BITS, 30, dtype=np.uint64)[draw.integers(0, 30, 2000)]
    context[::9] = lm_score.ONCE
    got, want = lm_score.by_pair(hashes, context), np.lexsort((context, hashes))
    assert (hashes[got] == hashes[want]).all() and (context[got] == context[want]).all()
    assert len(lm_score.by_pair(hashes[:0], context[:0])) == 0
