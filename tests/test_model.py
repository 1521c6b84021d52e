"""Random sequences of calls against a dictionary that holds what the collection should."""

import random

import numpy as np
import pytest

from orrery import VectorDatabase
from orrery.functions.metrics import block_distances


@pytest.mark.parametrize("space,seed", [("l2", 1), ("cosine", 2)])
def test_sequences(spark, space, seed):
    rng = random.Random(seed)
    index = VectorDatabase(spark).create(dim=3, space=space, indexed_fields=["rank"])
    model: dict[str, tuple[list, dict]] = {}
    vector = lambda: [rng.randrange(1, 9) / 8 for _ in range(3)]
    metadata = lambda: {"rank": rng.randrange(100), "tag": rng.choice("abcd")}
    for _ in range(30):
        step = rng.choice(["add", "add", "add_new", "remove", "remove_many", "where", "update", "search", "list", "count", "compact", "get"])
        if step == "add":
            batch = [(f"k{rng.randrange(25)}", vector(), metadata()) for _ in range(rng.randrange(1, 6))]
            first = {}
            for i, v, m in batch:
                first.setdefault(i, (v, m))
            result = index.add({"ids": [b[0] for b in batch], "vectors": [b[1] for b in batch], "metadatas": [b[2] for b in batch]})
            assert (result.total_inserted, result.total_errors) == (len(first), len(batch) - len(first))
            for i, record in first.items():
                model.pop(i, None)
                model[i] = record
        elif step == "add_new":
            i, v, m = f"k{rng.randrange(25)}", vector(), metadata()
            assert index.add([{"id": i, "vector": v, "metadata": m}], overwrite=False).total_inserted == (i not in model)
            model.setdefault(i, (v, m))
        elif step == "remove":
            i = f"k{rng.randrange(25)}"
            assert index.remove_point(i) == (model.pop(i, None) is not None)
        elif step == "remove_many":
            ids = [f"k{rng.randrange(25)}" for _ in range(3)]
            assert index.remove_points(ids) == [i for i in dict.fromkeys(ids) if i not in model]
            for i in ids:
                model.pop(i, None)
        elif step == "where":
            limit = rng.randrange(30)
            gone = [i for i, (_, m) in model.items() if m.get("rank", 1000) < limit]
            assert index.remove_where({"rank": {"lt": limit}}) == len(gone)
            for i in gone:
                del model[i]
        elif step == "update":
            i, m = f"k{rng.randrange(25)}", {"tag": "new", "rank": rng.randrange(100)}
            assert index.update_metadata(i, m) == (i in model)
            if i in model:
                model[i] = (model[i][0], m)
        elif step == "search":
            wanted = rng.choice([None, {"tag": {"in": ["a", "new"]}}, {"$not": {"rank": {"gte": 50}}}])
            fits = [i for i, (_, m) in model.items() if not wanted or ("tag" in wanted and m["tag"] in ("a", "new")) or ("$not" in wanted and m["rank"] < 50)]
            q = vector()
            page = index.search(q, filter=wanted, top_k=4)
            scores = dict(zip(fits, block_distances(space, np.array([q]), np.array([model[i][0] for i in fits]).reshape(-1, 3))[0], strict=True)) if fits else {}
            assert len(page) == min(4, len(fits)) and len({h["id"] for h in page}) == len(page)
            assert np.allclose([h["score"] for h in page], sorted(scores.values())[:4], atol=1e-5)
            assert all(abs(scores[h["id"]] - h["score"]) < 1e-5 and h["metadata"] == model[h["id"]][1] for h in page)
        elif step == "list":
            offset = rng.randrange(5)
            assert index.list(7, offset=offset) == [(i, m) for i, (_, m) in model.items()][offset : offset + 7]
        elif step == "count":
            assert index.count({"rank": {"gte": 50}}) == sum(m["rank"] >= 50 for _, m in model.values()) and len(index) == len(model)
        elif step == "compact":
            index.compact()
        else:
            ids = [f"k{rng.randrange(25)}" for _ in range(3)]
            assert [(r["id"], r["metadata"]) for r in index.get_records(ids)] == [(i, model[i][1]) for i in ids if i in model]
    assert dict(index.list(1000)) == {i: m for i, (_, m) in model.items()}
