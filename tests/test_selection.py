"""What declared fields alone say of a filter: bounds around the true matches, and the reads that they narrow."""

import random

import numpy as np
import pytest

from orrery import VectorDatabase
from orrery.functions.filters import FALSE, TRUE, always, bound, names, parse, selection


def leaf(rng, field):
    return {field: rng.choice([{"gte": rng.randrange(6)}, {"lt": rng.randrange(6)}, {"eq": rng.randrange(6)}, {"ne": rng.randrange(6)}, {"exists": rng.random() < 0.5}, {"in": [1, 3]}])}


def tree(rng, depth):
    if depth == 0 or rng.random() < 0.3:
        return leaf(rng, rng.choice("abcd"))
    kind = rng.choice(["$and", "$or", "$not"])
    return {kind: tree(rng, depth - 1)} if kind == "$not" else {kind: [tree(rng, depth - 1) for _ in range(rng.randint(1, 3))]}


def holds(node, record):
    """A plain reading of a parsed filter."""
    if node[0] == "not":
        return not holds(node[1], record)
    if node[0] in ("and", "or"):
        return (all if node[0] == "and" else any)(holds(n, record) for n in node[1])
    kind, field, operator, value = node
    if kind == "presence":
        return (field in record) == value
    if field not in record:
        return False
    x = record[field]
    return {"gte": lambda: x >= value, "lt": lambda: x < value, "eq": lambda: x == value, "ne": lambda: x != value, "in": lambda: x in value}[operator]()


@pytest.mark.parametrize("seed", range(200))
def test_bounds_enclose_the_matches(seed):
    rng = random.Random(seed)
    node = parse(tree(rng, 4))
    known = set(rng.sample("abcd", rng.randrange(5)))
    low, high = bound(node, known, False), bound(node, known, True)
    assert names(low) | names(high) <= known
    for _ in range(60):
        record = {f: rng.randrange(6) for f in "abcd" if rng.random() < 0.8}
        true = holds(node, record)
        assert not holds(low, record) or true
        assert not true or holds(high, record)
    if names(node) <= known:
        assert selection(node, known) == "exact"
    else:
        assert selection(node, known) == ("whole" if high == TRUE else "narrowed")


def test_known_shapes():
    mixed = parse({"$or": [{"a": 1, "x": 2}, {"a": 2, "$not": {"x": 3}}]})
    assert selection(mixed, {"a"}) == "narrowed" and selection(mixed, {"x"}) == "narrowed" and selection(mixed, {"a", "x"}) == "exact" and selection(mixed, set()) == "whole"
    assert bound(parse({"$or": [{"a": 1}, {"x": 2}]}), {"a"}, True) == TRUE and bound(parse({"a": 1, "x": 2}), {"a"}, False) == FALSE
    assert bound(parse({"$not": {"a": 1, "x": 2}}), {"a"}, False) == ("not", parse({"a": 1})) and always(TRUE) and always(FALSE) is False


def test_collections_read_no_more_than_declared_fields_allow(spark):
    rng = np.random.default_rng(4)
    index = VectorDatabase(spark).create(dim=2, space="l2", indexed_fields=["a"])
    rows = [{"a": int(rng.integers(6)), "x": int(rng.integers(6))} for _ in range(200)]
    index.add({"ids": [str(i) for i in range(200)], "vectors": rng.standard_normal((200, 2)), "metadatas": rows})
    wanted = {"$or": [{"a": 1, "x": {"lt": 3}}, {"a": 4, "x": 5}]}
    true = [r for r in rows if r["a"] == 1 and r["x"] < 3 or r["a"] == 4 and r["x"] == 5]
    assert index.count(wanted) == len(true)
    assert index.count_bounds(wanted) == (0, sum(r["a"] in (1, 4) for r in rows))
    assert index.count_bounds({"a": 1}) == (sum(r["a"] == 1 for r in rows),) * 2
    assert index.explain_filter(wanted) == {"selection": "narrowed", "declared": ["a"], "undeclared": ["x"]}
    plan = index.frame(wanted)._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :].split("ReadSchema")[0]
    assert "declared.f0" in pushed and "Or(" in pushed
