import ast
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_names_and_oracles():
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and {"p3_found", "pipeline_walking"} <= set(names)


def test_nothing_outside_imports_the_llm_package():
    for path in [*ROOT.glob("weftmark/**/*.py"), *ROOT.glob("*.py"), *ROOT.glob("tests/*.py")]:
        if "llm" in path.relative_to(ROOT).parts or path.name == "__spark_entry__.py":
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            if isinstance(node, ast.Import):
                assert not any("weftmark.llm" in n.name for n in node.names), path
            if isinstance(node, ast.ImportFrom):
                assert not (node.module or "").startswith("weftmark.llm") and not (node.module == "weftmark" and any(n.name == "llm" for n in node.names)), path


def test_walking_slice(spark):
    df = entry.entry(spark)
    assert df.columns == ["type", "source_id", "target_id", "provenance"] and df.count() > 0
