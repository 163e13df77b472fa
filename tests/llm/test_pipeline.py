"""The pipeline and the registered queries on the smallest tables, against brute force."""

import inspect

import pytest

import __spark_entry__ as contract
import corpus_pipeline
from keystead.llm import toxicity
from keystead.llm.common import table

FOLDER = "/root/testdata/sf0.001"


def shingles(text):
    own = text.lower().split()
    return {tuple(own[k : k + 5]) for k in range(max(1, len(own) - 4))} if own else set()


def test_run_against_brute_force(spark):
    docs = table(spark, FOLDER, "documents")
    model = toxicity.train(docs, table(spark, FOLDER, "labels"))
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    left = {r.doc_id: r.text or "" for r in docs.collect() if scores[r.doc_id] < 0.7}
    first = {}
    for i in sorted(left):
        first.setdefault(left[i], i)
    left = {i: t for t, i in first.items()}
    sets = {i: shingles(t) for i, t in left.items()}
    root = {i: i for i in sets}
    for _ in range(len(sets)):
        before = dict(root)
        for i in sets:
            for j in sets:
                if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    root[i] = min(root[i], root[j])
        if root == before:
            break
    left = {i: t for i, t in left.items() if root[i] == i}
    spoken = lambda t: "".join(c if c.isalpha() else " " for c in t.lower()).split()
    items = []
    for r in table(spark, FOLDER, "benchmark").collect():
        own = spoken(r.text)
        items.append({tuple(own[k : k + 8]) for k in range(max(1, len(own) - 7))})
    clean = set()
    for i, t in left.items():
        own = spoken(t)
        found = {tuple(own[k : k + 8]) for k in range(len(own) - 7)}
        if all(len(item & found) < 0.3 * len(item) for item in items):
            clean.add(i)
    got = {r.doc_id for r in corpus_pipeline.run(spark, FOLDER).select("doc_id").distinct().collect()}
    assert got == clean and len(got) < docs.count()


def test_stages_keep_the_columns_and_extra_ones(spark):
    docs = table(spark, FOLDER, "documents").selectExpr("*", "source as host", "n_chars as rep", "lang as label", "lang as kept")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, FOLDER).columns == docs.columns, name
        assert stage(spark, docs.limit(0), FOLDER).collect() == [], name
    assert len(inspect.signature(corpus_pipeline.STAGES[0][1]).parameters) == 3


@pytest.mark.parametrize("n", range(1, 11))
def test_every_operator_is_registered_once(n):
    assert len([name for name in contract.queries() if name.startswith(f"op{n}_")]) == 1
