"""All registered queries."""

from . import features, negatives, prep, prompts, ranking, sequences, serving, vectors  # noqa: F401
from .common import QUERIES, oracles

__all__ = ["QUERIES", "oracles"]
