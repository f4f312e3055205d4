from test_decontaminate import DOCS, ITEMS

from sedge.llm import decontaminate as d


def test_items_without_an_id_contaminate(spark):
    text, other = "one two three four five six seven eight", "red green blue cyan black white grey pink"
    docs = spark.createDataFrame([(1, "so " + text, 0, ""), (2, other, 0, ""), (3, text + " " + other, 0, ""), (4, "none of it", 0, "")], DOCS)
    items = spark.createDataFrame([(None, text, 0), (None, "one two three four and all the rest", 0), (5, other, 0)], ITEMS)
    got = {r.doc_id: (r.contaminated, r.coverage, list(r.items)) for r in d.decontaminate(docs, items).collect()}
    assert got == {1: (True, 1.0, []), 2: (True, 1.0, [5]), 3: (True, 1.0, [5]), 4: (False, 0.0, [])}
    assert [r.doc_id for r in d.clean(docs, items).collect()] == [4]
