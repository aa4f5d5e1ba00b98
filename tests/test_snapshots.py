import datetime as dt

from crawlquarry.operators import snapshots as S

DAY = dt.datetime(2025, 1, 1)


def audits(spark, rows):
    return spark.createDataFrame([(a, "p", s, DAY + dt.timedelta(days=n), st, "clash") for a, s, n, st in rows], "audit_id string, project_id string, schedule_id string, audit_date timestamp, status string, url string")


def pages(spark, rows):
    return spark.createDataFrame([(*r, "S9") for r in rows], "ord bigint, audit_id string, url string, status_code int, title string, canonical string, schedule_id string")


def run(spark, a, p):
    return {(r.schedule_id, r.audit_id, r.url, r.change_kind): tuple(r.changed) for r in S.changes(pages(spark, p), audits(spark, a)).collect()}


def test_changes(spark):
    a = [("a1", "s", 1, "READY"), ("a2", "s", 2, "FAILED"), ("a3", "s", 3, "READY"), ("a4", "s", 4, "READY"), ("b1", None, 1, "READY")]
    p = [
        (1, "a1", "u", 200, "t", None), (2, "a1", "gone", 200, "t", "c"), (3, "a2", "failed", 1, "", ""), (4, "a3", " u ", 200, "t", ""), (5, "a3", "new", None, None, None),
        (6, "a4", "u", 301, "t", ""), (7, "a4", "u", 200, "T", "c"), (8, "a4", "new", 0, "", ""), (9, "a4", None, 1, "x", "x"), (10, None, "q", 1, "x", "x"), (11, "b1", "manual", 1, "x", "x"), (12, "a1", "back", 1, "x", "x"), (13, "a4", "back", 1, "x", "x"),
    ]
    assert run(spark, a, p) == {
        ("s", "a3", "gone", "removed"): (), ("s", "a3", "new", "added"): (), ("s", "a4", "u", "changed"): ("title", "canonical"), ("s", "a4", "new", "changed"): ("status_code",),
        ("s", "a3", "back", "removed"): (), ("s", "a4", "back", "added"): (),
    }


def test_empty_snapshot_removes_all(spark):
    a = [("a1", "s", 1, "READY"), ("a2", "s", 2, "READY")]
    assert run(spark, a, [(1, "a1", "u", 1, "t", "c")]) == {("s", "a2", "u", "removed"): ()}


def test_empty_tables_and_repeats(spark):
    assert run(spark, [], []) == {}
    a = [("a1", "s", 1, "READY"), ("a2", "s", 1, "READY"), ("a2", "s", 1, "READY")]
    p = [(1, "a1", "u", 1, "t", "c"), (1, "a1", "u", 1, "t", "c"), (2, "a2", "u" * 10_000, 1, "t", "c")]
    assert set(run(spark, a, p)) == {("s", "a2", "u", "removed"), ("s", "a2", "u" * 10_000, "added")}


def test_kept_snapshots_move_only_the_new_one(spark, tmp_path):
    def audits(*rows):
        return spark.createDataFrame(rows, "audit_id string, schedule_id string")

    def pages(*rows):
        return spark.createDataFrame([(*r, "x") for r in rows], "ord bigint, audit_id string, url string, status_code int, title string, canonical string, present string")

    kept = S.Kept(spark, str(tmp_path / "k"), buckets=3)
    kept.advance(pages((1, "a1", "u", 200, None, "c"), (2, "a1", "v", 200, "t", "c"), (3, "b1", "z", 1, "", "")), audits(("a1", "s"), ("b1", "r"), ("e1", "e")))
    assert kept.changes().isEmpty()
    second = pages((4, "a2", " u ", 200, "old", "c"), (5, "a2", "u", 200, "", "c2"), (6, "a2", "w", None, None, None), (7, "other", "q", 1, "", ""), (8, "e2", "n", 1, "", ""))
    kept.advance(second, audits(("a2", "s"), ("e2", "e")))
    got = {tuple(r[:4]) + (tuple(r.changed),) for r in kept.changes().collect()}
    assert got == {("s", "a2", "u", "changed", ("canonical",)), ("s", "a2", "v", "removed", ()), ("s", "a2", "w", "added", ()), ("e", "e2", "n", "added", ())}
    kept.advance(second.limit(0), audits(("a3", "s")))
    assert {(r.url, r.change_kind) for r in kept.changes().collect()} == {("u", "removed"), ("w", "removed")}
    assert {r.url for r in spark.table(kept.table).where("present").collect()} == {"z", "n"}
    stored = spark.table(kept.table).where("present")
    new = kept._first(second, audits(("a2", "s")))
    plan = stored.join(new.drop("audit_id"), ["schedule_id", "url"], "full_outer")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" in plan  # the stored side stays where it is
    with __import__("pytest").raises(ValueError):
        kept.advance(second, audits(("a4", "s"), ("a5", "s")))
