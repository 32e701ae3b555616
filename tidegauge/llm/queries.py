"""Imports every operator, so that its query is registered."""

from tidegauge.llm import bpe, jaccard_join, knn, minhash, mixing, passages, quality, repair, secret_scan, token_counts, token_output, toxicity, whitening  # noqa: F401
from tidegauge.llm.registry import QUERIES, SQL  # noqa: F401
