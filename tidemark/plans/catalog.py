"""All registered queries."""

from . import boards, cards, claims, evidence, flows, measures, more, selection, sequence
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "boards", "cards", "claims", "evidence", "flows", "measures", "more", "selection", "sequence"]
