"""A ledger of hypotheses with gates."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .select import QueryError


@dataclass
class Hypothesis:
    id: int
    text: str
    metric: str
    op: str
    target: float
    status: str = "registered"
    value: float | None = None
    met: bool | None = None
    evidence: list[dict[str, Any]] = field(default_factory=list)
    verdict: str | None = None


class Ledger:
    """registered -> measured -> investigated -> judged. A failed measurement can't be judged supported."""

    OPS = {">": lambda v, t: v > t, ">=": lambda v, t: v >= t, "<": lambda v, t: v < t, "<=": lambda v, t: v <= t, "==": lambda v, t: v == t, "!=": lambda v, t: v != t}

    def __init__(self) -> None:
        self.rows: dict[int, Hypothesis] = {}

    def propose(self, text: str, metric: str, op: str, target: float) -> Hypothesis:
        if op not in self.OPS:
            raise QueryError(f"unknown op {op!r}")
        h = Hypothesis(len(self.rows) + 1, text, metric, op, target)
        self.rows[h.id] = h
        return h

    def _at(self, id_: int, *states: str) -> Hypothesis:
        h = self.rows.get(id_)
        if h is None:
            raise QueryError(f"no hypothesis {id_}")
        if h.status not in states:
            raise QueryError(f"hypothesis {id_} is {h.status}")
        return h

    def measure(self, id_: int, value: float | None) -> Hypothesis:
        h = self._at(id_, "registered")
        h.value, h.met, h.status = value, None if value is None else bool(self.OPS[h.op](value, h.target)), "measured"
        return h

    def add_evidence(self, id_: int, event_ids: list, known: DataFrame, supports: bool, note: str = "") -> Hypothesis:
        """Ids that known (a column id) doesn't hold are stored as unverified."""
        h = self._at(id_, "measured", "investigated")
        found = {r["id"] for r in known.filter(F.col("id").isin(list(event_ids))).select("id").distinct().collect()} if event_ids else set()
        h.evidence += [{"id": e, "verified": e in found, "supports": supports, "note": note} for e in event_ids]
        h.status = "investigated"
        return h

    def judge(self, id_: int, decision: str) -> Hypothesis:
        h = self._at(id_, "investigated")
        if decision not in ("supported", "rejected", "undecided"):
            raise QueryError(f"unknown verdict {decision!r}")
        if decision == "supported" and (not h.met or not any(e["verified"] and e["supports"] for e in h.evidence)):
            raise QueryError("a claim is supported only if its measurement met the expectation and verified evidence supports it")
        h.verdict, h.status = decision, "judged"
        return h
