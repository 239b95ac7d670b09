"""Imports every module that registers queries."""

from tidemark.llm import bpe, language, mixing, neighbours, paragraphs, periodic, phrases, quality, simhash, substrings, topk, urls, warc  # noqa: F401
from tidemark.llm.registry import QUERIES, SQL  # noqa: F401
