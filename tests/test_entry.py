"""The driver's entry without the training-data subpackage, and the logging functions."""

import importlib
import json
import logging
import sys

import orrery


def test_without_subpackage(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("orrery.llm") or m in ("corpus_pipeline", "__spark_entry__")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "orrery.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.delattr(orrery, "llm", raising=False)
    entry = importlib.import_module("__spark_entry__")
    assert "flagship" in entry.queries() and not any(n.startswith("op") or n == "pipeline" for n in entry.queries())
    assert entry.oracle_sql().keys() <= entry.queries().keys()
    monkeypatch.delitem(sys.modules, "__spark_entry__")


def test_logging(tmp_path):
    assert orrery.init_file_logging(str(tmp_path), level="info", format="json")
    assert orrery.is_logging_initialized() and not orrery.init_logging()
    logging.getLogger("orrery").info("a line")
    line = json.loads((tmp_path / "orrery.log").read_text())
    assert line["level"] == "INFO" and line["message"] == "a line"
