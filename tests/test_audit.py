"""Decisions in words, metrics of candidates and readiness, on hand-made rows."""

from tidewire.plans import audit


def test_decisions(spark):
    actions = spark.createDataFrame([
        (1, 5, "discover_sources_finished", '{"candidates": 2, "search": {"status": "ok"}}'), (2, None, "discover_sources_finished", "not json"),
        (3, 9, "approve_source_candidate", '{"source_id": 4}'), (4, 5, "else", None), (5, None, None, None), (6, 5, "source_discovery_plan_built", '{"policy": {"auto": 3}}'),
    ], "id int, task_id int, action_type string, output string")
    tasks = spark.createDataFrame([(5, "pumps")], "id int, topic string")
    got = {r["id"]: (r["title"], r["summary"], r["tone"]) for r in audit.decisions(actions, tasks).collect()}
    assert got == {
        1: ("Поиск источников завершён", "Тема: pumps, кандидатов: 2, поиск: ok.", "good"),
        2: ("Поиск источников завершён", "Тема: —, кандидатов: 0, поиск: —.", "neutral"),
        3: ("Кандидат одобрен", "Создан источник #4, первый сбор: не ставился.", "good"),
        4: ("else", "Детали записаны в журнал действий", "neutral"), 5: ("", "Детали записаны в журнал действий", "neutral"),
        6: ("План построен", "Авто: 3, вручную: 0, запрещено: 0.", "neutral"),
    }


def test_readiness(spark):
    checks = lambda *rows: spark.createDataFrame(list(rows), "code string, severity string, found boolean")
    state = lambda *rows: tuple(audit.readiness(checks(*rows)).first())
    assert state(("a", "blocker", True), ("b", "info", True), ("c", "info", None)) == ("blocked", "a,b", 1)
    assert state(("a", "blocker", False), ("b", "warning", True)) == ("degraded", "b", 0)
    assert state(("a", "blocker", False)) == ("ready", "", 0) == state()


def test_candidate_metrics(spark):
    rows = [("x", 10, "ok", True, True, 60.0), ("x", 0, "rejected", None, False, None), ("x", None, "error", False, None, 49.99), ("y", 1, None, None, None, None)]
    got = {r[0]: tuple(r)[1:] for r in audit.candidate_metrics(spark.createDataFrame(rows, "k string, text_chars int, status string, prefilter_keep boolean, relevant boolean, total_score double"), "k").collect()}
    assert got == {"x": (3, 1, 2, 1, 1, 2, 1, 55.0, 1), "y": (1, 1, 0, 0, 0, 0, 0, None, 0)}
