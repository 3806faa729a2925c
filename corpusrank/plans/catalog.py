"""Import every query module so the registry is complete."""

from corpusrank.plans import q_corpus, q_extra, q_metrics, q_models, q_retrieval, q_selection, q_streaming, q_text, q_tfidf  # noqa: F401
from corpusrank.plans.registry import ORACLES, QUERIES

__all__ = ["QUERIES", "ORACLES"]
