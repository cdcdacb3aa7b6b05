"""op7 on passages that the edge of a text cuts."""

from qaspark.llm import decontamination

DOCS = "doc_id long, text string"


def test_passages_cut_at_the_edges_of_a_text(spark):
    item = [f"i{k}" for k in range(30)]
    lead = [f"x{k}" for k in range(40)]
    cut, short = " ".join(item[1:]), " ".join(item[:-1])
    docs = [(1, cut + " " + " ".join(lead)), (2, " ".join(lead) + " " + short), (3, cut), (4, " ".join(item[:20])), (5, " ".join(lead))]
    docs.append((6, " ".join(item) + " " + " ".join(lead) + " " + short))  # once whole, once cut
    got = decontamination.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")).collect()
    assert {(r.doc_id, r.start) for r in got if r.doc_id < 6} >= {(1, 0), (2, 39), (3, 0)}
    assert {r.doc_id for r in got} == {1, 2, 3, 6} and {(6, 0), (6, 69)} <= {(r.doc_id, r.start) for r in got}
