"""Where the models of the toxicity chain are fitted."""
import pytest

from corvid.llm import toxicity


def test_models_are_fitted_in_tasks(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "fit_linear", lambda *a: pytest.fail("fitted on the driver"))
    docs = spark.createDataFrame([(i, "a rotten text of idiots" if i % 3 == 0 else f"a kind text {i % 7}") for i in range(120)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0), None if i % 5 == 0 else int(i % 2 == 0)) for i in range(120)], "doc_id long, a int, b int")
    chain = toxicity.train(docs, labels, ["a", "b"])
    assert [len(w) for w in chain.weights] == [len(chain.features) + 1, len(chain.features) + 2]
    got = {r.doc_id: r.p_a for r in toxicity.score(docs, chain).collect()}
    assert all((p > 0.5) == (i % 3 == 0) for i, p in got.items())
