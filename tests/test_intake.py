"""Model verdicts as rows."""

from ridgeline.plans import intake


def test_candidate_verdicts(spark):
    rows = spark.createDataFrame(
        [("c1", " True Positive ", "0.5", " why ", [" a ", "", "b", "c", "d"]), ("c2", "tp", "0.49", None, None), ("c3", None, "7", None, []), ("c4", "incident", "x", None, [None, "z"]), ("c5", "false_positive", "1", None, None)],
        "candidate_id string, verdict string, confidence string, rationale string, remediation_steps array<string>",
    )
    got = {r.candidate_id: (r.verdict, r.confidence, r.selected, r.steps) for r in intake.candidate_verdicts(rows).collect()}
    assert got == {"c1": ("true positive", 0.5, True, ["a", "b", "c"]), "c2": ("tp", 0.49, False, []), "c3": ("unknown", 1.0, False, []), "c4": ("incident", 0.0, False, ["z"]), "c5": ("false_positive", 1.0, False, [])}
    assert intake.candidate_verdicts(rows.limit(0)).count() == 0


def test_accepted_alerts(spark):
    rows = spark.createDataFrame(
        [("a1", "no", "yes", None, None, 1), ("a2", None, " YES ", None, None, 2), ("a2", "true", None, None, "0.9", 3), ("a3", "incident_candidate", None, None, "0.4", 4), ("a3", None, None, "y", "0.5", 5), (" ", "true", None, None, "1", 6), (None, "true", None, None, "1", 7), ("a4", None, None, None, "1", 8)],
        "alert_id string, incident_candidate string, is_incident string, selected string, confidence string, seq int",
    )
    assert sorted((r.alert_id, r.seq) for r in intake.accepted_alerts(rows).collect()) == [("a2", 2), ("a3", 5)]
    assert intake.accepted_alerts(rows.limit(0)).count() == 0
