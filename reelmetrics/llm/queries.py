"""All queries of the subpackage; importing a module registers its query."""

from . import bpe, byte_bpe, exact_dedup, merkle, mixing, ngram_join, periodic_runs, pii, quality_embed, quality_rules, suffix_dedup, toxicity, url_filter  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
