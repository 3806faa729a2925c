from corpusrank.config import Options
from corpusrank.plans.common import TD


def test_registered_queries_run_the_full_iterations():
    for name in ("gbt_max_iter", "svm_max_iter", "logreg_max_iter"):
        assert getattr(TD, name) == getattr(Options(), name)
