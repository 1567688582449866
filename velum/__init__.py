"""velum: find, resolve and mask sensitive spans in Italian free text on Spark,
prepare gold annotations and score predictions against them."""

from velum.config import DeidConfig
from velum.plans.deidentify import deidentify, find_spans, remask
from velum.plans.evaluate import evaluate, evaluate_all
from velum.plans.gold import gold_corpus, gold_from_corpora

__all__ = [
    "DeidConfig",
    "deidentify",
    "evaluate",
    "evaluate_all",
    "find_spans",
    "gold_corpus",
    "gold_from_corpora",
    "remask",
]
