"""The example of the README, run as it stands."""

import re

import numpy as np

from orrery import VectorDatabase


def test_example(spark, tmp_path):
    with open("README.md") as f:
        code = re.search(r"```python\n(.*?)```", f.read(), re.S)[1]
    code = code.replace("index.search([", "hits = index.search([")
    df = spark.createDataFrame([("c", [0.9, 0.1, 0.1], '{"author": "Alice", "year": 2019}'), ("d", [0.8, 0.2, 0.1], '{"author": "Alice", "year": 2024}')], "id string, vector array<double>, metadata string")
    names = {"spark": spark, "df": df, "queries": np.array([[1.0, 0, 0], [0, 1.0, 0]]), "path": str(tmp_path / "saved"), "VectorDatabase": VectorDatabase}
    exec(code, names)
    assert [h["id"] for h in names["hits"]] == ["a", "d"]
    assert [(r.qid, r.id) for r in names["page"].filter("rank = 1").orderBy("qid").collect()] == [(0, "c"), (1, "b")]
    assert len(names["again"]) == 4
