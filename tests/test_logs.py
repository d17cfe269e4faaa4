"""Logs of runs, artefacts, actions and alerts; imports of cards and weights."""

import pytest
from pyspark.sql import functions as F

from oddsmill.operators import governance as G
from oddsmill.operators import monitoring as M
from oddsmill.operators import scorecard


def test_runs_steps_and_artifacts(spark, tmp_path):
    log, data = str(tmp_path / "log"), str(tmp_path / "data.csv")
    (tmp_path / "data.csv").write_text("a,b\n1,2\n")
    run = G.new_run_id({"x": 1}, "2024-01-02 03:04:05", "ada")
    assert run == G.new_run_id({"x": 1}, "2024-01-02 03:04:05", "ada") and run.startswith("run_20240102T030405_")
    G.record(spark, log, "run", run, "2024-01-02 03:04:05", {"status": "created", "user_id": "ada", "config_hash": G.config_hash({"x": 1})})
    G.record(spark, log, "step", f"{run}/bins", "2024-01-02 03:05:00", {"status": "started"})
    G.record(spark, log, "step", f"{run}/bins", "2024-01-02 03:06:00", {"status": "done"})
    G.record(spark, log, "run", run, "2024-01-02 04:00:00", {"status": "done"})
    G.register_artifact(spark, log, "table", "2024-01-02 03:04:06", run, "csv", data)
    G.register_artifact(spark, log, "card", "2024-01-02 03:30:00", run, "json", data, ("table",))
    events = spark.read.schema(G.EVENT_SCHEMA).parquet(log)
    assert [(r.run_id, r.status, r.user_id) for r in G.list_runs(G.runs_of(events), status="done").collect()] == [(run, "done", "ada")]
    step = G.steps_of(events, run).first()
    assert (step.step, step.status) == ("bins", "done") and step.started < step.ended
    assert [(r.artifact, r.depth) for r in G.lineage(G.artifact_links(events), "card").collect()] == [("card", 0), ("table", 1)]
    assert G.verify_artifact(spark, events, "table")
    (tmp_path / "data.csv").write_text("a,b\n1,3\n")
    assert not G.verify_artifact(spark, events, "table")
    G.delete_artifact(spark, log, "table", "2024-01-03 00:00:00")
    events = spark.read.schema(G.EVENT_SCHEMA).parquet(log)
    assert {r.id for r in G.recorded(events, "artifact").collect()} == {"card"}


def test_diamonds_are_walked_once(spark):
    links = [(f"a{i}", f"{x}{i + 1}") for i in range(80) for x in "ab"] + [(f"b{i}", f"a{i + 1}") for i in range(1, 80)]
    out = {r.artifact: r.depth for r in G.lineage(spark.createDataFrame(links, "child string, parent string"), "a0").collect()}
    assert len(out) == 161 and out["a80"] == 80 and out["b5"] == 5


def test_audit_log_shows_changes_and_gaps(spark, tmp_path):
    path = str(tmp_path / "audit")
    for i in range(4):
        G.audit(spark, path, f"2024-01-0{i + 1} 00:00:00", "ada", "score", f"card {i}", {"n": i})
    log = spark.read.schema(G.AUDIT_SCHEMA).parquet(path)
    assert log.count() == 4 and G.audit_faults(log).count() == 0
    assert [(r.seq, r.fault) for r in G.audit_faults(log.where("seq <> 2")).collect()] == [(3, "gap")]
    edited = log.withColumn("user_id", F.when(F.col("seq") == 1, "eve").otherwise(F.col("user_id")))
    assert [(r.seq, r.fault) for r in G.audit_faults(edited).collect()] == [(1, "changed")]


def test_alerts_live_by_their_events(spark):
    rows = [("2024-01-01 00:00:00", "critical", "drift", "psi"), ("2024-01-01 00:01:00", "info", "note", "psi")]
    log = M.created(spark.createDataFrame(rows, "ts string, severity string, title string, source string").withColumn("ts", F.col("ts").cast("timestamp")))
    first, second = [r.alert_id for r in log.orderBy("ts").collect()]
    assert [r.severity for r in M.active_alerts(log).collect()] == ["critical", "info"]
    log = log.unionByName(M.changed(log, first, "acknowledged", "2024-01-01 01:00:00"))
    log = log.unionByName(M.changed(log, first, "resolved", "2024-01-01 02:00:00", "retrained"))
    assert [r.alert_id for r in M.active_alerts(log).collect()] == [second]
    assert M.changed(log, first, "resolved", "2024-01-01 03:00:00").count() == 0 and M.changed(log, "no such", "resolved", "2024-01-01 03:00:00").count() == 0
    state = {r.alert_id: r for r in M.alert_state(log).collect()}
    assert state[first].notes == "retrained" and state[first].status == "resolved"
    with pytest.raises(ValueError):
        M.changed(log, first, "forgotten", "2024-01-01 03:00:00")
    with pytest.raises(Exception, match="unknown severity"):
        M.created(spark.createDataFrame([("2024-01-01 00:00:00", "loud", "x", "y")], "ts string, severity string, title string, source string")).collect()


def test_counters_and_gauges(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", 2.0, 2), ("a", None, 3), ("b", 5.0, 1)], "name string, value double, t int")
    assert {r["name"]: r.total for r in M.counters(df, "name", "value").collect()} == {"a": 3.0, "b": 5.0}
    assert {r["name"]: r.value for r in M.gauges(df, "name", "value", "t").collect()} == {"a": 2.0, "b": 5.0}
    with pytest.raises(Exception, match="does not fall"):
        M.counters(df.withColumn("value", -F.col("value")), "name", "value").collect()
    assert M.exposition(M.gauges(df, "name", "value", "t"), "g", "name", "value").orderBy("line").first().line == 'oddsmill_g{name="a"} 2.0'


def test_a_card_read_back_scores_alike(spark):
    rows = [(float(i % 50), float(i % 7), int((i % 50) * 2 + (i % 7) * 5 + i % 13 > 70)) for i in range(3000)]
    df = spark.createDataFrame(rows, "a double, b double, y int")
    card = scorecard.Scorecard.fit(df, ["a", "b"], "y")
    again = scorecard.Scorecard.from_spec(card.spec())
    assert again.spec() == card.spec()
    one, two = (c.score(df).agg(F.sum("score"), F.min("score"), F.max("score")).first() for c in (card, again))
    assert all(abs(x - y) < 1e-6 for x, y in zip(one, two, strict=True))
