"""Extension points: rules and feeds a user may add without touching the engine.

A rule is `fn(c, prof) -> Column`, where `c("name")` is a column of the stage it joins:

    relevance_gate    -> reason string, null when the gate has no objection
    eligibility_gate  -> verdict struct (see operators.arrangement), null to pass on
    score             -> struct<points double, reasons array<string>, concerns array<string>>
    factor            -> struct<factor double, reason string>, null when it does not apply
    gap               -> string, null when there is no gap

Rules run in ascending order number; the engine's own are spaced by ten.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

KINDS = ("relevance_gate", "eligibility_gate", "score", "factor", "gap")


@dataclass(frozen=True)
class Rule:
    kind: str
    order: float
    name: str
    fn: Callable


_rules: dict[str, dict[str, Rule]] = {kind: {} for kind in KINDS}
_feeds: dict[str, object] = {}


def register_rule(kind: str, order: float, fn: Callable, name: str | None = None) -> None:
    if kind not in _rules:
        raise ValueError(f"unknown rule kind {kind!r}; expected one of {KINDS}")
    name = name or fn.__name__
    _rules[kind][name] = Rule(kind, order, name, fn)


def remove_rule(kind: str, name: str) -> None:
    _rules[kind].pop(name, None)


def rule(kind: str, order: float):
    """Decorator form of `register_rule`."""
    def add(fn):
        register_rule(kind, order, fn)
        return fn
    return add


def rules(kind: str) -> list[Rule]:
    return sorted(_rules[kind].values(), key=lambda r: (r.order, r.name))


def register_feed(name: str, field_map) -> None:
    _feeds[name] = field_map


def feed(name: str):
    return _feeds[name]


def feed_names() -> list[str]:
    return sorted(_feeds)
