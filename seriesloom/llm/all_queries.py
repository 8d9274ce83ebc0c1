"""Imports every query module of this subpackage, which fills its registry."""

from seriesloom.llm import (alignment, language, leaks, lines, near, negatives, packing, search, sharding, substrings, token_files,  # noqa: F401
                            vector_links, warc)
from seriesloom.llm.registry import ORACLES, QUERIES  # noqa: F401
