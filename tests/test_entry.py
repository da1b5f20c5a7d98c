import importlib
import sys

import __spark_entry__ as entry


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and len(names) > 40


def test_core_stands_alone(monkeypatch):
    monkeypatch.setitem(sys.modules, "lodestone.llm", None)
    try:
        got = importlib.reload(entry).queries()
        assert "hybrid_search" in got and not any(n.startswith(("p1_", "p3_")) for n in got)
    finally:
        monkeypatch.undo()
        importlib.reload(entry)


def test_core_imports_nothing_of_llm():
    from pathlib import Path

    root = Path(entry.__file__).parent / "lodestone"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "llm" not in p.read_text(), p
