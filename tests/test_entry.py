import importlib
import sys

import __spark_entry__ as entry


def test_names_agree():
    queries, oracle = entry.queries(), entry.oracle_sql()
    assert set(oracle) <= set(queries) and len(queries) >= 70


def test_runs_without_the_llm_folder(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("bidloom.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "bidloom.llm", None)
    fresh = importlib.reload(entry)
    assert "p1_found" in fresh.queries() and "p7_found" not in fresh.queries()
    monkeypatch.undo()
    importlib.reload(entry)


def test_core_never_imports_llm():
    import pathlib

    root = pathlib.Path(entry.__file__).parent / "bidloom"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "bidloom.llm" not in p.read_text()
