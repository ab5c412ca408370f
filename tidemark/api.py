"""Named tools over a canonical log: a schema of arguments and a handler that returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import boards, cards, chunks, claims, evidence, metrics, ranges, relations, reuse, select, sequences
from .operators.select import QueryError


@dataclass
class Tool:
    name: str
    text: str
    arguments: dict[str, type]
    run: Callable[..., DataFrame]


class Session:
    """Tools over events (id, t, actor, kind, channel, text, meta, reply_to) and actors (id, label)."""

    def __init__(self, events: DataFrame, actors: DataFrame | None = None):
        self.events, self.actors = events, actors
        e = lambda a: select.window(events, a.get("since"), a.get("until"))
        edges = lambda: relations.reply_edges(events)
        made = [
            Tool("overview", "Counts by kind", {}, lambda **a: select.group_events(e(a), F.col("kind"), "kind")),
            Tool("actors", "Counts by actor with rank", {}, lambda **a: metrics.volume_rank(e(a))),
            Tool("actor_card", "One actor's counts by kind", {"actor": str}, lambda **a: select.group_events(e(a).filter(F.col("actor") == a["actor"]), F.col("kind"), "kind")),
            Tool("select_events", "Rows that meet conditions", {"kind": str, "actor": str, "channel": str, "contains": str, "limit": int}, self._select),
            Tool("event_fields", "Fields of the metadata", {}, lambda **a: select.field_profile(e(a))),
            Tool("search", "Full-text search", {"query": str}, lambda **a: reuse.search(e(a), a["query"])),
            Tool("grep", "Regular expressions", {"patterns": list}, lambda **a: select.grep(e(a), a["patterns"])),
            Tool("context", "Neighbours of an event in its channel", {"id": str, "k": int}, lambda **a: sequences.context(events, "channel", events.filter(F.col("id") == a["id"]).select("id"), a.get("k", 3))),
            Tool("timeline", "An actor's events in order", {"actor": str}, lambda **a: e(a).filter(F.col("actor") == a["actor"]).orderBy("t", "id")),
            Tool("interactions", "Pairs and their reciprocity", {}, lambda **a: relations.reciprocity(edges())),
            Tool("get_event", "One event", {"id": str}, lambda **a: events.filter(F.col("id") == a["id"])),
            Tool("signals", "Labels that stand out for an actor", {}, lambda **a: metrics.outliers(e(a))),
            Tool("quality", "Dominant kinds", {}, lambda **a: metrics.dominant(e(a))),
            Tool("behaviour_changes", "Labels over their usual share by day", {}, lambda **a: metrics.distinctive(e(a), F.floor(F.col("t") / 86400))),
            Tool("calendar", "Days, new actors and spikes", {}, lambda **a: chunks.calendar(e(a))),
            Tool("metric_catalog", "Names of the metrics", {}, lambda **a: events.sparkSession.createDataFrame([(m,) for m in sorted(self.metrics)], "metric string")),
            Tool("run_metric", "One metric", {"metric": str, "params": dict}, self._metric),
            Tool("test_claim", "How often B follows A against a baseline", {"a": str, "b": str, "width": int}, lambda **a: ranges.rates(ranges.reaction(e(a), F.col("kind") == a["a"], F.col("kind") == a["b"], a.get("width", 3600)))),
            Tool("claim", "Whether B follows A, with groups, halves, a resampled gap and a verdict", {"a": str, "b": str, "width": int, "scope": str}, self._claim),
            Tool("co_occurs", "Whether actors with A have B more than others, with a verdict", {"a": str, "b": str}, lambda **a: claims.co_occurrence(e(a), F.col("kind") == a["a"], F.col("kind") == a["b"]).withColumn("verdict", claims.co_occurrence_verdict())),
            Tool("spread", "Whether users of a kind had contact with earlier ones, against others", {"kind": str}, lambda **a: claims.spread(e(a), edges(), F.col("kind") == a["kind"])),
            Tool("reactions", "All pairs of kinds that follow each other", {"width": int}, lambda **a: ranges.after_pairs(e(a), a.get("width", 3600), off=ranges.OFF)),
            Tool("map", "Actors with their links", {}, lambda **a: cards.node_view(e(a), edges())),
            Tool("node", "One actor with its links", {"actor": str}, lambda **a: cards.node_view(e(a), edges()).filter(F.col("actor") == a["actor"])),
            Tool("neighbourhood", "Events around some events", {"ids": list}, lambda **a: boards.neighbourhood(events, events.filter(F.col("id").isin(a["ids"])).select("id"))),
            Tool("before", "The last events of others in the place, for each event", {"within": int, "keep": int}, lambda **a: boards.before_context(e(a), "channel", a.get("within", 3600), a.get("keep", 3))),
            Tool("started_stopped", "Kinds that an actor took up or gave up", {"days": int}, lambda **a: boards.started_and_stopped(e(a), "kind", a.get("days", 5))),
            Tool("first_changes", "Kinds that become usual in a channel", {}, lambda **a: boards.first_changes(e(a), ["channel"], "kind")),
            Tool("turning_points", "How much the mix of kinds changes at each event of a channel", {"width": int}, lambda **a: boards.mix_changes(e(a), ["channel"], "kind", a.get("width", 12))),
            Tool("periods", "Events by day, or by part of a busy day", {}, lambda **a: boards.calendar_buckets(e(a))),
            Tool("grain", "Whether days or hours suit the record", {}, lambda **a: boards.grain(e(a))),
            Tool("leads", "Who leads a channel", {"share": float}, lambda **a: boards.lead_profile(e(a), "channel", a.get("share", 0.8))),
            Tool("stretches", "Sizes and burstiness of each actor's days", {}, lambda **a: cards.stretch_features(e(a).withColumn("unit", F.concat_ws(":", "actor", F.floor(F.col("t") / 86400))), "unit")),
            Tool("lines", "Numbered lines of a channel's record", {"channel": str}, lambda **a: evidence.rendered(e(a).filter(F.col("channel") == a["channel"]), "channel", "kind")),
            Tool("ends", "First and last events of each channel", {"first": int, "last": int}, lambda **a: cards.ends(e(a), "channel", a.get("first", 40), a.get("last", 40))),
            Tool("sample", "Events spread evenly over time, actors not seen before preferred", {"k": int}, lambda **a: cards.evenly_spaced(e(a), "kind", a.get("k", 10))),
        ]
        self.tools = {t.name: t for t in made}
        self.metrics: dict[str, Callable[..., DataFrame]] = {
            "rate": lambda kind: metrics.rate_vs_others(events, F.col("kind") == kind),
            "volume_rank": lambda: metrics.volume_rank(events),
            "before_after": lambda at, days=7: metrics.before_after(events, at, days),
            "burst": lambda width=600: sequences.burst(events, ["actor"], width),
            "reaction": lambda trigger, response, width=3600: ranges.rates(ranges.reaction(events, F.col("kind") == trigger, F.col("kind") == response, width)),
            "reciprocity": lambda: relations.reciprocity(edges()),
            "spread": lambda kind: ranges.contact_spread(events, edges(), F.col("kind") == kind),
            "daily_bursts": lambda: metrics.daily_bursts(events, ["actor"]),
            "median_gap": lambda: sequences.median_gap(events, ["actor"]),
            "after_then": lambda a, b, width=5400, scope="same_actor": self._claim(a=a, b=b, width=width, scope=scope),
            "co_occurs": lambda a, b: claims.co_occurrence(events, F.col("kind") == a, F.col("kind") == b),
            "spread_with_base": lambda kind: claims.spread(events, edges(), F.col("kind") == kind),
            "channel_reaction": lambda trigger, response, width=3600: ranges.rates(ranges.reaction(events, F.col("kind") == trigger, F.col("kind") == response, width, ["channel"], True)),
            "outliers": lambda least=8, factor=2.0, margin=0.2: metrics.outliers(events, "kind", "actor", least, factor, margin),
            "answered": lambda tolerance=900: cards.reciprocal_rates(relations.answered(edges(), tolerance)),
        }

    def _select(self, **a: Any) -> DataFrame:
        limit = a.pop("limit", 50)
        rows = select.select_events(select.window(self.events, a.pop("since", None), a.pop("until", None)), **a)
        return select.first_rows(rows, limit, "t", "id")

    def _claim(self, a: str, b: str, width: int = 5400, scope: str = "same_actor", since: int | None = None, until: int | None = None) -> DataFrame:
        if scope not in ("same_actor", "target", "others_same_place"):
            raise QueryError(f"unknown scope {scope!r}")
        events = select.window(self.events, since, until)
        targets = relations.reply_edges(self.events).select(F.col("event_id").alias("id"), F.col("dst").alias("target")) if scope == "target" else None
        cases = claims.after_then_cases(events, F.col("kind") == a, F.col("kind") == b, width, scope, targets)
        return claims.after_then(cases).withColumn("verdict", claims.after_then_verdict())

    def _metric(self, metric: str, params: dict | None = None) -> DataFrame:
        if metric not in self.metrics:
            raise QueryError(f"unknown metric {metric!r}; there are {', '.join(sorted(self.metrics))}")
        try:
            return self.metrics[metric](**(params or {}))
        except TypeError as error:
            raise QueryError(f"bad parameters for {metric}: {error}") from error

    def call(self, name: str, **arguments: Any) -> DataFrame:
        if name not in self.tools:
            raise QueryError(f"unknown tool {name!r}")
        unknown = set(arguments) - set(self.tools[name].arguments) - {"since", "until"}
        if unknown:
            raise QueryError(f"{name} has no argument {', '.join(sorted(unknown))}")
        return self.tools[name].run(**arguments)

    def describe(self) -> list[dict]:
        return [{"name": t.name, "text": t.text, "arguments": {k: v.__name__ for k, v in t.arguments.items()}} for t in self.tools.values()]
