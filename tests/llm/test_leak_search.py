"""How operator 5 finds the windows of a text: texts read once, no function on arrays for every token."""

from keystead.llm import decontaminate


def test_windows_are_searched_in_compiled_steps(spark, monkeypatch):
    item = "red green blue black white brown amber olive coral ivory"
    docs = spark.createDataFrame([(1, f"so {item} it is"), (2, f"So {item}"), (3, "red"), (4, None), (5, "")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, "red"), (3, "Compute 12, 15, 18, 21, 24")], "item_id long, text string")
    plans, write = [], decontaminate.materialise

    def watched(df, name):
        if name == "hits":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(decontaminate, "materialise", watched)
    plain = bench.where("item_id < 3")
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, plain).collect()}
    assert found == {(1, 1), (2, 1), (1, 2), (2, 2), (3, 2)}
    assert plans[0].count("regexp_extract_all") == 1
    assert "filter(sequence" not in plans[0] and "posexplode" in plans[0]
    # items with heavy windows are found beside the others
    more = docs.unionByName(spark.createDataFrame([(6, "now Compute 12, 15, 18, 21, 24 red")], docs.schema))
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(more, bench).collect()}
    assert found == {(1, 1), (2, 1), (1, 2), (2, 2), (3, 2), (6, 2), (6, 3)}
