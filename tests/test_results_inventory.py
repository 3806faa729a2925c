import pytest

from corpusrank.plans import q_models

SF001 = "/root/testdata/sf0.001"


def test_inventory_runs_the_whole_experiment_on_the_texts(spark, monkeypatch):
    class Called(Exception):
        pass

    def run(corpus, opts):
        assert {"doc_id", "text", "y"} <= set(corpus.columns) and corpus.limit(1).count() == 1
        raise Called

    monkeypatch.setattr(q_models, "run_benchmark", run)
    with pytest.raises(Called):
        q_models.results_inventory(spark, SF001)
