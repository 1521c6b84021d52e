"""The filter language against plain Python on stored metadata, on declared and undeclared fields, typed columns and JSON text."""

import contextlib
import io
import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from orrery import VectorDatabase
from orrery.functions.filters import StoredField, always, bound_condition, condition, parse, typed_fields, where
from orrery.functions.values import canonical, json_field, kind_of, stored

ROWS = {
    "r01": {"name": "alpha", "count": 10, "ratio": 0.5, "flag": True, "tags": ["a", "b"], "nullable": None, "nested": {"key": "v", "n": 1}},
    "r02": {"name": "beta", "count": 10.0, "ratio": 2, "flag": False, "tags": [], "nullable": "set", "nested": {"key": "v", "n": 1.0}},
    "r03": {"name": "", "count": "10", "ratio": -1.5, "flag": 1, "tags": ["b", 3, None], "a.b": 1, "nested": {"key": "w"}},
    "r04": {"name": "alphabet", "count": 11},
    "r05": {"count": 2**53 + 1, "ratio": float(2**53), "tags": "a", "name": None},
    "r06": {"count": 2**53, "ratio": 1e300, "tags": [["a"], {"z": 1}], "name": "ALPHA", "$price": 3, "it's": 1},
}


def same(a, b):
    if kind_of(a) != kind_of(b):
        return False
    if isinstance(a, list):
        return len(a) == len(b) and all(map(same, a, b))
    if isinstance(a, dict):
        return a.keys() == b.keys() and all(same(a[k], b[k]) for k in a)
    return a == b


def holds(row, wanted):
    """A plain reading of the language's rules."""
    for key, want in wanted.items():
        if key == "$and":
            ok = all(holds(row, w) for w in want)
        elif key == "$or":
            ok = any(holds(row, w) for w in want)
        elif key == "$not":
            ok = not holds(row, want)
        elif isinstance(want, dict):
            ok = all(one(row, key, op, t) for op, t in want.items())
        else:
            ok = one(row, key, "eq", want)
        if not ok:
            return False
    return True


def one(row, key, op, t):
    there = key in row
    if op in ("exists", "is_missing", "is_null"):
        return {"exists": there, "is_missing": not there, "is_null": there and row[key] is None}[op] == t
    if not there:
        return False
    v = row[key]
    number = lambda x: kind_of(x) == "number"
    if op in ("gt", "gte", "lt", "lte"):
        return number(v) and number(t) and {"gt": v > t, "gte": v >= t, "lt": v < t, "lte": v <= t}[op]
    if op == "eq":
        return same(v, t)
    if op == "ne":
        return not same(v, t)
    if op == "contains":
        return isinstance(v, str) and isinstance(t, str) and t in v or isinstance(v, list) and any(same(x, t) for x in v)
    if op in ("startswith", "endswith"):
        return isinstance(v, str) and isinstance(t, str) and getattr(v, op)(t)
    if op in ("in", "nin"):
        return (isinstance(t, list) and any(same(v, x) for x in t)) == (op == "in")
    held = v if isinstance(v, list) else [v]
    if not isinstance(t, list):
        return False
    return any(same(x, y) for x in held for y in t) if op == "any" else all(any(same(x, y) for x in held) for y in t)


TARGETS = [None, True, 10, 10.0, 10.5, "10", "", "alpha", "a", [], ["a"], ["b", 3], [None], [10], ["alpha", None, 10], 2**53, 2**53 + 1, float(2**53), 1e300, -2, {"key": "v", "n": 1}]
NAMES = ["name", "count", "ratio", "flag", "tags", "nullable", "nested", "absent", "a.b", "$price", "it's"]
OPERATORS = ["eq", "ne", "gt", "gte", "lt", "lte", "contains", "startswith", "endswith", "in", "nin", "any", "all"]
SIMPLE = [{n: {o: t}} for n, o, t in itertools.product(NAMES, OPERATORS, TARGETS)] + [{n: {o: b}} for n in NAMES for o in ("exists", "is_missing", "is_null") for b in (True, False)]


def random_filter(rng, depth=0):
    roll = rng.random()
    if depth < 3 and roll < 0.5:
        kind = rng.choice(["$and", "$or", "$not"])
        return {kind: random_filter(rng, depth + 1) if kind == "$not" else [random_filter(rng, depth + 1) for _ in range(rng.randrange(4))]}
    return dict(kv for _ in range(rng.randrange(1, 3)) for kv in rng.choice(SIMPLE).items())


def filters():
    """A fixed draw of the single conditions, and combinations."""
    rng = random.Random(11)
    return rng.sample(SIMPLE, 500) + [random_filter(rng) for _ in range(60)]


@pytest.fixture(scope="module")
def index(spark):
    index = VectorDatabase(spark).create(dim=1, space="l2", indexed_fields=["name", "tags", "count"])
    index.add([{"id": i, "vector": [0.0], "metadata": m} for i, m in ROWS.items()])
    return index


def matrix(df, conditions):
    """Which filters hold for which row, by one pass for each few dozen filters."""
    out = {}
    for start in range(0, len(conditions), 60):
        part = conditions[start : start + 60]
        for r in df.select("id", F.array(*[F.coalesce(c, F.lit(False)) for c in part]).alias("held")).collect():
            out.setdefault(r.id, []).extend(r.held)
    return out


@pytest.mark.parametrize("declared", [True, False])
def test_stored_fields(index, declared):
    wanted = filters()
    rows = index.records
    resolve = (lambda n: index._field(rows, n)) if declared else lambda n: StoredField(rows["fields"][F.lit(n)])
    got = matrix(rows, [condition(parse(w), resolve) for w in wanted])
    for i, row in ROWS.items():
        wrong = [w for w, held in zip(wanted, got[i], strict=True) if held != holds(stored(row), stored_filter(w))]
        assert not wrong, (i, wrong[:5])


def stored_filter(w):
    return json.loads(json.dumps(w))


def test_json_text(spark):
    """JSON columns read by VARIANT functions; numbers in arrays and objects keep their spelling, so those filters are left out."""
    df = spark.createDataFrame([(i, json.dumps(m)) for i, m in ROWS.items()], "id string, doc string")
    wanted = [w for w in filters() if "nested" not in json.dumps(w)][:250]
    got = matrix(df, [bound_condition(parse(w), lambda n: json_field(F.col("doc"), n)) for w in wanted])
    for i, row in ROWS.items():
        wrong = [w for w, held in zip(wanted, got[i], strict=True) if held != holds(row, w)]
        assert not wrong, (i, wrong[:5])


def test_typed_columns(spark):
    rows = [("a", 10, 0.5, True, ["x", "y"]), ("b", 2**53 + 1, float(2**53), False, []), ("", -3, -0.0, None, None), (None, None, None, True, ["z"])]
    df = spark.createDataFrame([(str(i), *r) for i, r in enumerate(rows)], "id string, s string, n long, d double, f boolean, t array<string>")
    named = [{k: v for k, v in zip("sndft", r, strict=True) if v is not None} for r in rows]
    targets = [True, 10, 10.0, 10.5, -3, "a", "", "x", ["x"], ["x", "y"], [10, "a"], [], 2**53, 2**53 + 1, 2**70, -(2**70), 0, 1e300]
    every = [{n: {o: t}} for n in [*"sndft", "absent"] for o in OPERATORS for t in targets]
    wanted = random.Random(6).sample(every, 500) + [{"$not": {n: {"gt": 1}}} for n in "nd"] + [{n: {"exists": b}} for n in "sndft" for b in (True, False)]
    got = matrix(df, [condition(parse(w), typed_fields(df)) for w in wanted])
    for i, row in enumerate(named):
        wrong = [w for w, held in zip(wanted, got[str(i)], strict=True) if held != holds(row, w)]
        assert not wrong, (i, wrong[:5])


def test_presence_matrix(spark):
    index = VectorDatabase(spark).create(dim=1, space="l2")
    index.add([{"id": "has", "vector": [0], "metadata": {"lang": "en"}}, {"id": "null", "vector": [0], "metadata": {"lang": None}}, {"id": "none", "vector": [0], "metadata": {"n": 1}}])
    ids = lambda w: sorted(r.id for r in index.frame(w).collect())
    assert ids({"lang": {"exists": True}}) == ["has", "null"] and ids({"lang": {"is_missing": True}}) == ["none"]
    assert ids({"lang": {"is_null": True}}) == ["null"] and ids({"lang": {"is_null": False}}) == ["has", "none"]


def test_errors_and_shapes():
    for bad in ({"a": {"near": 1}}, {"$and": {}}, {"$or": ["x"]}, {"$not": []}, {"a": {"exists": 1}}):
        with pytest.raises(ValueError):
            parse(bad)
    deep = {"a": 1}
    for _ in range(11):
        deep = {"$not": deep}
    with pytest.raises(ValueError):
        parse(deep)
    assert always(parse({})) and always(parse({"$not": {"$or": []}})) and always(parse({"$or": [{}, {"a": 1}]}))
    assert always(parse({"$or": []})) is False and always(parse({"a": 1})) is None
    assert canonical({"b": 1.0, "a": [True, None, "é"]}) == '{"a":[true,null,"é"],"b":1}'


def test_pushdown(spark):
    df = where(spark.read.parquet("/root/testdata/sf0.001/orders.parquet"), {"o_orderstatus": "F", "o_custkey": {"gte": 10.5}})
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        df.explain("formatted")
    pushed = shown.getvalue().split("PushedFilters: ")[1].split("\n")[0]
    assert "EqualTo(o_orderstatus,F)" in pushed and "GreaterThan(o_custkey,10)" in pushed
