"""Regression trees as plain expressions.

A forest fitted by Spark ML becomes a small value that needs no library to score: one nested condition per tree, as
a Column, or as SQL text for another engine. It can be saved as JSON, and its leaves can be refitted.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from itertools import count
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Leaf:
    number: int
    value: float


@dataclass(frozen=True)
class Split:
    """``yes`` where the numeric ``column`` is at most ``at_most``, or the categorical one equals ``level``."""

    column: str
    yes: Node
    no: Node
    at_most: float | None = None
    level: str | None = None


Node = Leaf | Split


def leaves(node: Node) -> Iterator[Leaf]:
    if isinstance(node, Leaf):
        yield node
    else:
        yield from leaves(node.yes)
        yield from leaves(node.no)


def _numbered(node: Node, number: Iterator[int]) -> Node:
    """The leaves counted from 0, ``yes`` before ``no``."""
    if isinstance(node, Leaf):
        return replace(node, number=next(number))
    return replace(node, yes=_numbered(node.yes, number), no=_numbered(node.no, number))


def _with_values(node: Node, value: Callable[[Leaf], float]) -> Node:
    if isinstance(node, Leaf):
        return replace(node, value=value(node))
    return replace(node, yes=_with_values(node.yes, value), no=_with_values(node.no, value))


@dataclass(frozen=True)
class Forest:
    """Trees whose values add up, and what stands in for missing features (numbers or levels)."""

    trees: tuple[Node, ...]
    fills: Mapping[str, float | str]

    def with_values(self, tree: int, value: Callable[[Leaf], float]) -> Forest:
        """The same forest with the leaf values of one tree replaced."""
        changed = _with_values(self.trees[tree], value)
        return replace(self, trees=(*self.trees[:tree], changed, *self.trees[tree + 1:]))

    def _test(self, s: Split) -> Column:
        if s.level is not None:
            return F.coalesce(F.col(s.column).cast("string"), F.lit(self.fills[s.column])) == s.level
        return F.coalesce(F.col(s.column).cast("double"), F.lit(float(self.fills[s.column]))) <= s.at_most

    def _column(self, node: Node, of: Callable[[Leaf], Column]) -> Column:
        if isinstance(node, Leaf):
            return of(node)
        return F.when(self._test(node), self._column(node.yes, of)).otherwise(self._column(node.no, of))

    def leaf(self, tree: int) -> Column:
        """The number of the leaf a row falls into."""
        return self._column(self.trees[tree], lambda x: F.lit(x.number))

    def prediction(self) -> Column:
        return reduce(add, [self._column(t, lambda x: F.lit(x.value)) for t in self.trees], F.lit(0.0))

    def sql(self) -> str:
        """The prediction as SQL text over the feature columns, for an engine with CASE, COALESCE and CAST."""
        def number(x: float) -> str:
            return f"CAST('{float(x)!r}' AS DOUBLE)"

        def text(x: str) -> str:
            return "'" + x.replace("'", "''") + "'"

        def of(node: Node) -> str:
            if isinstance(node, Leaf):
                return number(node.value)
            if node.level is not None:
                test = f"COALESCE(CAST({node.column} AS VARCHAR), {text(self.fills[node.column])}) = {text(node.level)}"
            else:
                test = f"COALESCE(CAST({node.column} AS DOUBLE), {number(self.fills[node.column])}) <= {number(node.at_most)}"
            return f"CASE WHEN {test} THEN {of(node.yes)} ELSE {of(node.no)} END"

        return " + ".join(["CAST(0 AS DOUBLE)", *map(of, self.trees)])

    def to_json(self) -> str:
        def plain(node: Node) -> dict:
            if isinstance(node, Leaf):
                return {"value": node.value}
            test = {"at_most": node.at_most} if node.level is None else {"level": node.level}
            return {"column": node.column, **test, "yes": plain(node.yes), "no": plain(node.no)}

        return json.dumps({"fills": dict(self.fills), "trees": [plain(t) for t in self.trees]}, indent=1)

    @classmethod
    def from_json(cls, text: str) -> Forest:
        def node(x: dict) -> Node:
            if "column" not in x:
                return Leaf(0, x["value"])
            return Split(x["column"], node(x["yes"]), node(x["no"]), x.get("at_most"), x.get("level"))

        read = json.loads(text)
        return cls(tuple(_numbered(node(t), count()) for t in read["trees"]), read["fills"])


_SPLIT = re.compile(r"(If|Else) \(feature (\d+) (<=|>|in|not in) (.+)\)")
_TREE = re.compile(r"Tree \d+ \(weight (\S+)\):")


def from_description(description: str, slots: Sequence[tuple[str, str | None]], fills: Mapping[str, float | str]) -> Forest:
    """The forest that Spark ML describes as text (``toDebugString``).

    ``slots`` says what each vector position holds: a numeric column, or whether a categorical one has a level.
    """
    lines = [x.strip() for x in description.splitlines()]
    starts = [k for k, x in enumerate(lines) if _TREE.fullmatch(x)]
    return Forest(tuple(
        _numbered(_tree(iter(lines[k + 1:]), slots, float(_TREE.fullmatch(lines[k]).group(1))), count()) for k in starts), fills)


def _tree(lines: Iterator[str], slots: Sequence, weight: float) -> Node:
    line = next(lines)
    if line.startswith("Predict:"):
        return Leaf(0, weight * float(line.removeprefix("Predict:")))
    _, feature, how, bound = _SPLIT.fullmatch(line).groups()
    left = _tree(lines, slots, weight)
    next(lines)  # the line of the other branch says the opposite
    right = _tree(lines, slots, weight)
    column, level = slots[int(feature)]
    if level is None:
        return Split(column, left, right, at_most=float(bound))
    # A level's flag is 0 or 1: does 1, "has the level", go left?
    to_left = float(bound) >= 1.0 if how == "<=" else 1.0 in {float(x) for x in bound.strip("{}").split(",") if x}
    return Split(column, left, right, level=level) if to_left else Split(column, right, left, level=level)
