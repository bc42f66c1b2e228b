import pathlib
import re
import sys

import __spark_entry__

ROOT = pathlib.Path(__spark_entry__.__file__).parent


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).columns == ["query_id", "rank", "id", "score"]


def test_nothing_else_imports_the_training_subpackage():
    for f in (ROOT / "wrenchlake").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            assert not re.search(r"import.*\bllm\b|from.*\bllm\b", f.read_text()), f


def test_entry_without_the_training_subpackage(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    names = __spark_entry__.queries()
    assert names and not any(re.match(r"op\d+_|pipeline", n) for n in names)
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_no_python_in_the_library_s_plans(spark, small):
    made = {n: q for n, q in __spark_entry__.queries().items() if not re.match(r"op\d+_|pipeline", n)}
    for name in ("rerank_topk", "team_overview", "chat_story", "chart_row_score", "source_list"):
        plan = made[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas", plan), name
