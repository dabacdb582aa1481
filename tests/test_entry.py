"""The driver contract: names, SQL for registered queries only, a flagship plan without Python."""

import __spark_entry__ as entry
from paperloom.operators import retrieval


def test_contract(spark):
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and "bm25_topk" in names
    assert entry.entry(spark).columns == ["query_id", "rank", "doc_id", "score"]


def test_flagship_plan_stays_in_the_jvm(spark, monkeypatch):
    """Neither the plan of the result nor that of any table written for it."""
    plans, real = [], retrieval.written
    plan_of = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(retrieval, "written", lambda df, label: plans.append(plan_of(df)) or real(df, label))
    plans.append(plan_of(entry.queries()["bm25_topk"](spark, "/root/testdata/sf0.001")))
    assert len(plans) > 3
    for plan in plans:
        assert "Python" not in plan and "CartesianProduct" not in plan
    assert any("ReadSchema: struct<doc_id:bigint,text:string>" in p for p in plans)
