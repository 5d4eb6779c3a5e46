"""The entry module, with and without the training-data operators."""

import importlib
import sys

from nomenspark import plans


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(plans.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_without_training_operators(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    e = importlib.import_module("__spark_entry__")
    assert set(e.queries()) == set(plans.queries())
    monkeypatch.delitem(sys.modules, "__spark_entry__")
