"""All queries of this subpackage."""

from tarmac.llm import bpe, codes, decontaminate, egojoin, graph, katz, langid, pagetext, quality, shards, simhash, tokenfile, trie  # noqa: F401
from tarmac.llm.common import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
