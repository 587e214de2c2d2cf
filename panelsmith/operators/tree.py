"""Typed operator trees: parsing, printing, complexity, and compiling to a lazy plan."""

from __future__ import annotations

import json
import random
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from panelsmith.operators import intraday, rolling
from panelsmith.sources.panel import calendar, with_date_idx

MINUTE_NUM, MINUTE_MASK, DAILY = "MINUTE_NUM", "MINUTE_MASK", "DAILY"


@dataclass(frozen=True)
class Node:
    operator: str = ""
    params: tuple[tuple[str, object], ...] = ()
    children: tuple["Node", ...] = ()
    leaf: str = ""


@dataclass(frozen=True)
class Rule:
    takes: tuple[str, ...]
    gives: str
    defaults: dict = field(default_factory=dict)


RULES = {
    "close_minute_log_return": Rule((MINUTE_NUM,), MINUTE_NUM, {"horizon": 5}),
    "forward_window_std": Rule((MINUTE_NUM,), MINUTE_NUM, {"window": 5, "ddof": 1}),
    "topk_separated_events": Rule((MINUTE_NUM,), MINUTE_MASK, {"k": 10, "exclude_before": 15, "min_gap": 5}),
    "masked_daily_mean_signal": Rule((MINUTE_NUM, MINUTE_MASK), DAILY),
    "seed_ts_std_daily": Rule((DAILY,), DAILY, {"window": 60, "ddof": 1}),
    "ts_mean_daily": Rule((DAILY,), DAILY, {"days": 10}),
}
LEAVES = {"minute_close": "close", "minute_volume": "volume"}


def parse(record: str | dict) -> Node:
    """A node of nested ``operator, params, children`` or ``leaf`` records."""
    r = json.loads(record) if isinstance(record, str) else record
    if r.get("leaf"):
        return Node(leaf=r["type"] if r.get("type") in LEAVES else r["leaf"])
    return Node(r["operator"], tuple(sorted((r.get("params") or {}).items())), tuple(parse(c) for c in r.get("children", ())))


def kind(node: Node, daily: dict[str, DataFrame] | None = None) -> str:
    """The type of a node; raises ValueError where a child's type does not fit."""
    if node.leaf:
        if node.leaf in LEAVES:
            return MINUTE_NUM
        if node.leaf in (daily or {}):
            return DAILY
        raise ValueError(f"unknown leaf {node.leaf}")
    rule = RULES.get(node.operator)
    if rule is None:
        raise ValueError(f"unknown operator {node.operator}")
    given = tuple(kind(c, daily) for c in node.children)
    unknown = {k for k, _ in node.params} - set(rule.defaults)
    if given != rule.takes or unknown:
        raise ValueError(f"{node.operator} takes {rule.takes}, not {given}" + f", and no {sorted(unknown)}" * bool(unknown))
    return rule.gives


def text(node: Node) -> str:
    """One line with sorted parameters; equal trees have equal text. Minute leaves go by their column."""
    if node.leaf:
        return LEAVES.get(node.leaf, node.leaf)
    return f"{node.operator}({', '.join([*map(text, node.children), *(f'{k}={v}' for k, v in node.params)])})"


def complexity(node: Node) -> int:
    """Operators in the tree, leaves left out."""
    return 0 if node.leaf else 1 + sum(map(complexity, node.children))


def compile_tree(node: Node, bars: DataFrame, daily: dict[str, DataFrame] | None = None, out: str = "factor") -> DataFrame:
    """The plan of a DAILY tree over minute bars: ``instrument, trade_date, factor``.

    Minute operators add columns to one frame, so the exchange by instrument-day is shared;
    subtrees of equal text are built once. DAILY leaves are frames of ``instrument, trade_date,
    factor``.
    """
    if kind(node, daily) != DAILY:
        raise ValueError("the root must be daily")
    names: dict[str, str] = {}
    frame = bars

    def minute(n: Node) -> str:
        nonlocal frame
        if n.leaf:
            return LEAVES[n.leaf]
        if text(n) not in names:
            source, p = minute(n.children[0]), RULES[n.operator].defaults | dict(n.params)
            name = names[text(n)] = f"_n{len(names)}"
            build: Callable = {"close_minute_log_return": intraday.log_return, "forward_window_std": intraday.forward_std}[n.operator]
            frame = build(frame, **p, **({"price": source} if n.operator == "close_minute_log_return" else {"value": source}), out=name)
        return names[text(n)]

    def day(n: Node) -> DataFrame:
        if n.leaf:
            return daily[n.leaf].select("instrument", "trade_date", "factor")
        p = RULES[n.operator].defaults | dict(n.params)
        if n.operator == "masked_daily_mean_signal":
            value, mask = n.children
            column, source = minute(value), minute(mask.children[0])
            return intraday.event_mean(frame, column, source, **(RULES[mask.operator].defaults | dict(mask.params)))
        below = with_date_idx(day(n.children[0]), None if daily else calendar(bars))
        if n.operator == "seed_ts_std_daily":
            return rolling.rolling_std(below, "factor", **p, out="_f").select("instrument", "trade_date", below["date_idx"], "_f").withColumnRenamed("_f", "factor").drop("date_idx")
        return rolling.trailing_mean(below, "factor", **p, out="_f").select("instrument", "trade_date", "_f").withColumnRenamed("_f", "factor")

    return day(node).select("instrument", "trade_date", "factor").withColumnRenamed("factor", out)


def adopted(horizon=5, response_window=5, top_k=10, exclude_before=15, min_gap=5, ts_std=60) -> Node:
    """The volume-event dispersion factor as a tree."""
    response = Node("forward_window_std", (("ddof", 1), ("window", response_window)), (Node("close_minute_log_return", (("horizon", horizon),), (Node(leaf="minute_close"),)),))
    events = Node("topk_separated_events", (("exclude_before", exclude_before), ("k", top_k), ("min_gap", min_gap)), (Node(leaf="minute_volume"),))
    return Node("seed_ts_std_daily", (("ddof", 1), ("window", ts_std)), (Node("masked_daily_mean_signal", (), (response, events)),))


def decode(root: Node) -> dict[str, int]:
    """The parameters of a tree of the adopted shape; raises ValueError for another."""
    try:
        mean = root.children[0]
        response, events = mean.children
        ret = response.children[0]
        shape = (root.operator, mean.operator, response.operator, events.operator, ret.operator)
    except (IndexError, ValueError) as e:
        raise ValueError("not a tree of the adopted shape") from e
    if shape != ("seed_ts_std_daily", "masked_daily_mean_signal", "forward_window_std", "topk_separated_events", "close_minute_log_return"):
        raise ValueError("not a tree of the adopted shape")
    e, r = dict(events.params), dict(response.params)
    return {"horizon": dict(ret.params)["horizon"], "response_window": r["window"], "top_k": e["k"], "exclude_before": e["exclude_before"], "min_gap": e["min_gap"], "ts_std": dict(root.params)["window"]}


def random_tree(rng: random.Random, leaves: tuple[str, ...] = (), graft: float = 0.1) -> Node:
    """A random tree of the daily type; with probability ``graft`` its inner daily value is one of the external ``leaves``."""

    def num(depth: int) -> Node:
        op = rng.choice(["leaf", "close_minute_log_return", "forward_window_std"]) if depth else "leaf"
        if op == "leaf":
            return Node(leaf=rng.choice(list(LEAVES)))
        if op == "close_minute_log_return":
            return Node(op, (("horizon", rng.choice([1, 2, 5])),), (Node(leaf="minute_close"),))
        return Node(op, (("ddof", 1), ("window", rng.choice([3, 5]))), (num(depth - 1),))

    def day(depth: int) -> Node:
        op = rng.choice(["seed_ts_std_daily", "ts_mean_daily", "masked_daily_mean_signal"]) if depth else "masked_daily_mean_signal"
        if op == "seed_ts_std_daily":
            return Node(op, (("ddof", 1), ("window", rng.choice([5, 20, 60]))), (day(depth - 1),))
        if op == "ts_mean_daily":
            return Node(op, (("days", rng.choice([2, 5, 10])),), (day(depth - 1),))
        if leaves and rng.random() < graft:
            return Node(leaf=rng.choice(list(leaves)))
        events = Node("topk_separated_events", (("exclude_before", rng.choice([0, 2, 5])), ("k", rng.choice([3, 5, 10])), ("min_gap", rng.choice([1, 3, 5]))), (num(1),))
        return Node("masked_daily_mean_signal", (), (num(2), events))

    return day(2)


def subtrees(node: Node) -> list[Node]:
    return [node, *(x for c in node.children for x in subtrees(c))]


def crossover(a: Node, b: Node, rng: random.Random, leaves: tuple[str, ...] = ()) -> Node:
    """``a`` with one subtree replaced by one of ``b`` of the same type (the external ``leaves`` are daily)."""
    daily = dict.fromkeys(leaves)
    spot = rng.choice(subtrees(a))
    fits = [x for x in subtrees(b) if kind(x, daily) == kind(spot, daily)]
    graft = rng.choice(fits) if fits else spot

    def swap(n: Node) -> Node:
        return graft if n is spot else Node(n.operator, n.params, tuple(map(swap, n.children)), n.leaf)

    return swap(a)
