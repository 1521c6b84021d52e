"""The metadata filter language: a mapping is checked and turned into a tree, the tree into a Spark condition.

A mapping is an AND of its entries. A field maps to a plain value (equality) or to a mapping of operators, all of which must
hold. $and and $or take a list of mappings, $not one mapping. A value operator is false for a record without the field, ne,
nin and all included; a stored null is a value. Everything that is wrong with a filter is raised before any row is read.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .values import canonical, kind_of, stored

GROUPS = ("$and", "$or")
NEGATION = "$not"
PRESENCE = ("exists", "is_missing", "is_null")
OPERATORS = ("eq", "ne", "gt", "gte", "lt", "lte", "contains", "startswith", "endswith", "in", "nin", "any", "all")
MAX_GROUP_DEPTH = 10

Node = tuple


def parse(condition: Any) -> Node:
    """The tree of a filter: ("and" | "or", [nodes]), ("not", node), ("is", field, operator, value), ("presence", field, operator, bool)."""
    if condition is None:
        return ("and", [])
    if not isinstance(condition, Mapping):
        raise TypeError("A filter must be a mapping")
    return _entries(condition, 0)


def _entries(mapping: Mapping, depth: int) -> Node:
    nodes: list[Node] = []
    for key in sorted(mapping):
        value = mapping[key]
        if key in GROUPS:
            if not isinstance(value, (list, tuple)):
                raise ValueError(f'"{key}" is a group and takes a list of filter mappings, got {_name(value)}')
            _check_depth(key, depth)
            for branch in value:
                if not isinstance(branch, Mapping):
                    raise ValueError(f'Every entry of "{key}" must be a filter mapping, got {_name(branch)}')
            nodes.append(("and" if key == "$and" else "or", [_entries(b, depth + 1) for b in value]))
        elif key == NEGATION:
            if not isinstance(value, Mapping):
                raise ValueError(f'"{key}" takes one filter mapping, got {_name(value)}')
            _check_depth(key, depth)
            nodes.append(("not", _entries(value, depth + 1)))
        elif isinstance(value, Mapping):
            for operator in sorted(value):
                target = value[operator]
                if operator in PRESENCE:
                    if not isinstance(target, bool):
                        raise ValueError(f"'{operator}' takes True or False, got {_name(target)}")
                    nodes.append(("presence", key, operator, target))
                elif operator in OPERATORS:
                    nodes.append(("is", key, operator, stored(list(target) if isinstance(target, tuple) and operator in ("in", "nin", "any", "all") else target)))
                else:
                    raise ValueError(f"Unknown filter operation: {operator}")
        else:
            nodes.append(("is", key, "eq", stored(value)))
    return nodes[0] if len(nodes) == 1 else ("and", nodes)


def _name(value: Any) -> str:
    return {"null": "null", "bool": "a boolean", "number": "a number", "string": "a string", "array": "a list"}.get(kind_of(value), "a mapping")


def _check_depth(key: str, depth: int) -> None:
    if depth >= MAX_GROUP_DEPTH:
        raise ValueError(f'Filter groups nest to {MAX_GROUP_DEPTH} levels at most; "{key}" is one deeper')


def always(node: Node) -> bool | None:
    """True or False for a tree whose shape alone decides every record, else None."""
    kind = node[0]
    if kind == "not":
        inner = always(node[1])
        return None if inner is None else not inner
    if kind in ("and", "or"):
        known = [always(n) for n in node[1]]
        stop = kind == "or"
        return stop if stop in known else None if None in known else not stop
    return None


def names(node: Node) -> set[str]:
    if node[0] == "not":
        return names(node[1])
    return set().union(*map(names, node[1])) if node[0] in ("and", "or") else {node[1]}


TRUE, FALSE = ("and", []), ("or", [])


def bound(node: Node, known: set[str], upper: bool) -> Node:
    """What the known fields alone say of a tree: a tree over them that holds wherever the whole one does (upper), or only there (lower).

    An unknown leaf may hold or not, so it counts as true in the upper and as false in the lower bound; a negation swaps the two.
    """
    kind = node[0]
    if kind == "not":
        inner = bound(node[1], known, not upper)
        return FALSE if inner == TRUE else TRUE if inner == FALSE else ("not", inner)
    if kind not in ("and", "or"):
        return node if node[1] in known else TRUE if upper else FALSE
    stop, skip = (FALSE, TRUE) if kind == "and" else (TRUE, FALSE)
    parts = [p for p in (bound(n, known, upper) for n in node[1]) if p != skip]
    return stop if stop in parts else parts[0] if len(parts) == 1 else (kind, parts)


def selection(node: Node, known: set[str]) -> str:
    """How far the known fields decide a tree: "exact" (wholly), "narrowed" (they rule some records out) or "whole" (not at all)."""
    if names(node) <= known:
        return "exact"
    return "whole" if bound(node, known, True) == TRUE else "narrowed"


class StoredField:
    """A field in the column form of values.FIELD; a null column is a missing field."""

    def __init__(self, column: Column):
        self.column, self.kind, self.text, self.num, self.items = column, column["kind"], column["text"], column["num"], column["items"]

    def present(self) -> Column:
        return self.column.isNotNull()

    def null(self) -> Column:
        return self.kind == "null"

    def equal(self, target: Any) -> Column:
        kind = kind_of(target)
        return (self.kind == kind) & (self.text == (target if kind == "string" else canonical(target)))

    def compare(self, operator: str, target: Any) -> Column:
        """By exact magnitude: as doubles, and where those are equal and beyond 2^53, as integers."""
        sign = {"gt": ">", "gte": ">=", "lt": "<", "lte": "<="}[operator]
        number, double = self.kind == "number", float(target)
        strict = self.num > double if sign[0] == ">" else self.num < double
        if abs(double) < 2**53 or abs(double) >= 1e30:
            tie = F.lit("=" in sign)
        else:
            exact, bound = self.text.try_cast("decimal(38,0)"), F.lit(str(int(target))).cast("decimal(38,0)")
            tie = {">": exact > bound, ">=": exact >= bound, "<": exact < bound, "<=": exact <= bound}[sign]
        return number & (strict | ((self.num == double) & tie))

    def among(self, targets: list) -> Column:
        by: dict[str, list[str]] = {}
        for t in targets:
            by.setdefault(kind_of(t), []).append(t if isinstance(t, str) else canonical(t))
        return reduce(or_, [(self.kind == k) & self.text.isin(v) for k, v in by.items()], F.lit(False))

    def contains(self, target: Any) -> Column:
        held = (self.kind == "array") & F.array_contains(self.items, canonical(target))
        return held | ((self.kind == "string") & self.text.contains(target)) if isinstance(target, str) else held

    def starts(self, target: str) -> Column:
        return (self.kind == "string") & self.text.startswith(target)

    def ends(self, target: str) -> Column:
        return (self.kind == "string") & self.text.endswith(target)

    def any_of(self, targets: list) -> Column:
        listed = F.array(*map(F.lit, map(canonical, targets))) if targets else F.array().cast("array<string>")
        return ((self.kind == "array") & F.arrays_overlap(self.items, listed)) | ((self.kind != "array") & self.among(targets))

    def all_of(self, targets: list) -> Column:
        held = reduce(and_, [F.array_contains(self.items, canonical(t)) for t in targets], F.lit(True))
        alone = reduce(and_, [self.equal(t) for t in targets], F.lit(True))
        return self.present() & (((self.kind == "array") & held) | ((self.kind != "array") & alone))


class TypedField:
    """A plain column as a field; SQL NULL is a missing field. Literals are fitted to the column's type, so conditions push down."""

    def __init__(self, column: Column, kind: str):
        self.column, self.type = column, kind
        self.element = TypedField(column, kind[6:-1]) if kind.startswith("array<") else None

    def present(self) -> Column:
        return self.column.isNotNull()

    def null(self) -> Column:
        return F.lit(False)

    @property
    def whole(self) -> bool:
        return self.type in ("tinyint", "smallint", "int", "bigint")

    @property
    def number(self) -> bool:
        return self.whole or self.type in ("float", "double")

    def fitted(self, target: Any) -> Any:
        """The literal that equals the target in this type, or None."""
        if isinstance(target, bool) or self.type == "boolean":
            return target if isinstance(target, bool) and self.type == "boolean" else None
        if isinstance(target, str):
            return target if self.type == "string" else None
        if isinstance(target, (int, float)) and self.number:
            value = (int(target) if target == int(target) else None) if self.whole else float(target)
            return value if value == target and (not self.whole or -(2**63) <= value < 2**63) else None
        return None

    def equal(self, target: Any) -> Column:
        if self.element:
            wanted = [self.element.fitted(t) for t in target] if isinstance(target, list) else [None]
            return F.lit(False) if None in wanted else self.column == F.array(*map(F.lit, wanted)).cast(self.type)
        value = self.fitted(target)
        return F.lit(False) if value is None else self.column == F.lit(value)

    def compare(self, operator: str, target: Any) -> Column:
        if not self.number:
            return F.lit(False)
        if self.whole:
            low = int(target // 1)
            if target != low:  # between two whole numbers
                operator, target = ("gt", low) if operator in ("gt", "gte") else ("lte", low)
            if not -(2**63) <= target < 2**63:
                return self.column.isNotNull() & F.lit((target > 0) == (operator in ("lt", "lte")))
            target = int(target)
        else:
            near = float(target)
            if near != target:  # the target lies between two doubles
                operator = {"gt": "gte", "gte": "gte", "lt": "lt", "lte": "lt"}[operator] if near > target else {"gt": "gt", "gte": "gt", "lt": "lte", "lte": "lte"}[operator]
            target = near
        bound = F.lit(target)
        return {"gt": self.column > bound, "gte": self.column >= bound, "lt": self.column < bound, "lte": self.column <= bound}[operator]

    def among(self, targets: list) -> Column:
        if self.element:
            return reduce(or_, [self.equal(t) for t in targets], F.lit(False))
        wanted = [v for v in map(self.fitted, targets) if v is not None]
        return self.column.isin(wanted) if wanted else F.lit(False)

    def contains(self, target: Any) -> Column:
        if self.element:
            value = self.element.fitted(target)
            return F.lit(False) if value is None else F.coalesce(F.array_contains(self.column, value), F.lit(False))
        return self.column.contains(target) if self.type == "string" and isinstance(target, str) else F.lit(False)

    def starts(self, target: str) -> Column:
        return self.column.startswith(target) if self.type == "string" else F.lit(False)

    def ends(self, target: str) -> Column:
        return self.column.endswith(target) if self.type == "string" else F.lit(False)

    def any_of(self, targets: list) -> Column:
        return reduce(or_, [self.contains(t) for t in targets], F.lit(False)) if self.element else self.among(targets)

    def all_of(self, targets: list) -> Column:
        return reduce(and_, [self.contains(t) if self.element else self.equal(t) for t in targets], self.present())


Field = StoredField | TypedField
Resolver = Callable[[str], Field]


def condition(node: Node, resolve: Resolver) -> Column:
    """The tree as a condition to filter by. Leaves may be NULL (false to a filter, and so open to pushdown); $not makes them false first."""
    kind = node[0]
    if kind in ("and", "or"):
        return reduce(and_ if kind == "and" else or_, [condition(n, resolve) for n in node[1]], F.lit(kind == "and")) if len(node[1]) != 1 else condition(node[1][0], resolve)
    if kind == "not":
        return ~F.coalesce(condition(node[1], resolve), F.lit(False))
    _, name, operator, target = node
    at = resolve(name)
    if kind == "presence":
        asked = {"exists": at.present, "is_missing": lambda: ~at.present(), "is_null": lambda: F.coalesce(at.null(), F.lit(False))}[operator]()
        return asked if target else ~asked
    if operator == "eq":
        return at.equal(target)
    if operator == "ne":
        return at.present() & ~F.coalesce(at.equal(target), F.lit(False))
    if operator in ("gt", "gte", "lt", "lte"):
        return at.compare(operator, target) if kind_of(target) == "number" else F.lit(False)
    if operator == "contains":
        return at.contains(target)
    if operator in ("startswith", "endswith"):
        return (at.starts if operator == "startswith" else at.ends)(target) if isinstance(target, str) else F.lit(False)
    if not isinstance(target, list):
        return at.present() if operator == "nin" else F.lit(False)
    if operator == "in":
        return at.among(target)
    if operator == "nin":
        return at.present() & ~F.coalesce(at.among(target), F.lit(False))
    return at.any_of(target) if operator == "any" else at.all_of(target)


def bound_condition(node: Node, make: Callable[[str], Column]) -> Column:
    """The condition over fields that are costly to make (make: name -> column form): each is computed once for a row."""
    known: dict[str, StoredField] = {}

    def within(left: list[str]) -> Column:
        if not left:
            return condition(node, known.__getitem__)

        def bind(field: Column) -> Column:
            known[left[0]] = StoredField(field)
            return within(left[1:])

        return F.exists(F.array(make(left[0])), bind)

    return within(sorted(names(node)))


class Missing:
    """A field that no record has."""

    def __getattr__(self, name: str) -> Callable[..., Column]:
        return lambda *_: F.lit(False)


def typed_fields(df: DataFrame) -> Resolver:
    """Fields are the table's columns; a name without a column is a field that no record has."""
    kinds = dict(df.dtypes)
    return lambda name: TypedField(df[name], kinds[name]) if name in kinds else Missing()


def where(df: DataFrame, wanted: Mapping | None, resolve: Resolver | None = None) -> DataFrame:
    """The rows that a filter matches."""
    node = parse(wanted)
    return df if always(node) else df.filter(condition(node, resolve or typed_fields(df)))
