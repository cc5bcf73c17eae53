import importlib.util
import sys

from quillgraph.plans import catalogue


def test_queries_without_the_training_data_subpackage(monkeypatch):
    """As after both folders are deleted, with or without corpus_pipeline.py."""
    import __spark_entry__ as entry

    real = importlib.util.find_spec

    def find(name, *rest):
        if name.startswith("quillgraph.llm"):
            raise ModuleNotFoundError(name)
        return real(name, *rest)

    for m in [m for m in sys.modules if m.startswith("quillgraph.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setitem(sys.modules, "quillgraph.llm", None)
    monkeypatch.setattr(importlib.util, "find_spec", find)
    assert set(entry.queries()) == set(catalogue.QUERIES) and set(entry.oracle_sql()) == set(catalogue.ORACLES)


def test_every_oracle_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(catalogue.QUERIES) <= set(entry.queries())
