"""Importing the query modules fills the registry."""

from lexweave.queries import front, lexicon, lists, reference, rules, series, text_core, vocab  # noqa: F401
from lexweave.queries.base import ORACLE, QUERIES  # noqa: F401
