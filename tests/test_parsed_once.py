"""Documents are walked as little as the rules allow, and gates read their inputs once."""

from pyspark.sql import functions as F

from stopwise import session
from stopwise.operators import ingest
from stopwise.plans import q_audit, q_coverage
from stopwise.sources.tables import Tables

INFO = '"info":{"resolved":true,"docent":{"model_label":"m"}}'
DOCUMENTS = [
    ("[1]", "NOT_A_JSON_OBJECT"),
    ("7", "NOT_A_JSON_OBJECT"),
    ('{"messages":[1]}', "MISSING_INSTANCE_ID"),
    ('{"instance_id":""}', "MISSING_INSTANCE_ID"),
    ('{"instance_id":"i"}', "MISSING_OR_EMPTY_MESSAGES"),
    ('{"instance_id":"i","messages":[]}', "MISSING_OR_EMPTY_MESSAGES"),
    ('{"instance_id":"i","messages":{"0":1}}', "MISSING_OR_EMPTY_MESSAGES"),
    ('{"instance_id":"i","messages":"text"}', "MISSING_OR_EMPTY_MESSAGES"),
    ('{"instance_id":"i","messages":null}', "MISSING_OR_EMPTY_MESSAGES"),
    ('{"instance_id":"i","messages":[1]}', "MISSING_INFO"),
    ('{"instance_id":"i","messages":[1],"info":[true]}', "MISSING_INFO"),
    ('{"instance_id":"i","messages":[1],"info":{}}', "MISSING_RESOLVED_BOOL"),
    ('{"instance_id":"i","messages":[1],"info":{"resolved":1}}', "MISSING_RESOLVED_BOOL"),
    ('{"instance_id":"i","messages":[1],"info":{"resolved":true}}', "MISSING_MODEL_LABEL"),
    ('{"instance_id":"i","messages":[null],' + INFO + "}", None),
    ('{"instance_id":"i","messages":[{}],' + INFO + "}", None),
]


def test_first_failing_rule_of_odd_documents(spark):
    docs = ingest.parse_documents(spark.createDataFrame(DOCUMENTS, "document string, expected string"))
    found = docs.select("document", "expected", ingest.validate_fields().alias("reason")).collect()
    assert len(found) == len(DOCUMENTS)
    assert [(r["document"], r["reason"]) for r in found if r["reason"] != r["expected"]] == []


def test_validation_builds_no_list_of_messages(spark):
    docs = ingest.parse_documents(spark.createDataFrame(DOCUMENTS, "document string, expected string"))
    plan = docs.select(ingest.validate_fields())._jdf.queryExecution().optimizedPlan().toString()
    assert "$.messages[0]" in plan and "array<variant>" not in plan.lower()


def test_parsed_rows_come_in_small_tasks():
    assert session.TASK_ROWS <= 25_000


def test_feasibility_parses_documents_once(spark):
    t = Tables(session.tune(spark), "/root/testdata/sf0.001")
    plan = q_audit.feasibility(t)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parse_json") + plan.count("parseJson") == 1


def test_prefix_gate_writes_no_prefixes(spark, monkeypatch):
    from stopwise.sources import tables

    monkeypatch.setattr(tables, "materialize", lambda df, name: (_ for _ in ()).throw(AssertionError(name)))
    found = q_coverage.damaged_prefixes(Tables(session.tune(spark), "/root/testdata/sf0.001"))
    assert "label" not in found.columns and found.where(F.col("prefix_step_idx") == 0).count() > 0
