import datetime as dt

import pytest

from arcloom.operators.orphans import find_orphans, orphan_report

D = [dt.datetime(2024, 1, d) for d in range(1, 20)]
REF = "id int, repo int, src string, created_at timestamp, loaded_at timestamp, hit string, t_time string"
TGT = "repo int, id string, loaded_at timestamp, deleted_at timestamp, row_id string"


def found(spark, refs, targets, **kw):
    r, t = spark.createDataFrame(refs, REF), spark.createDataFrame(targets, TGT)
    got = find_orphans(r, t, ["repo", "src"], ["repo", "id"], **kw)
    return {(x["row_id"], x["reason"]) for x in got.collect()}, got


def ref(i, repo, src, at=5, created=1):
    return (i, repo, src, D[created], D[at] if at is not None else None, "x", "y")


TARGETS = [(1, "a", D[1], None, "z"), (1, "late", D[9], None, "z"), (1, "gone", D[1], D[3], "z"), (1, "later", D[1], D[9], "z"), (2, "a", D[1], None, "z"), (1, "both", D[9], D[3], "z")]


def test_reasons_and_clashing_columns(spark):
    got, _ = found(spark, [ref(1, 1, "a"), ref(2, 1, "nope"), ref(3, 1, "late"), ref(4, 1, "gone"), ref(5, 1, "later"), ref(6, 2, "late"), ref(7, 1, None), ref(8, 1, "both")], TARGETS, required=["src"])
    assert got == {(2, "missing"), (3, "late"), (4, "deleted"), (6, "missing"), (8, "late"), (8, "deleted")}


def test_deleted_at_the_same_time_counts_and_late_at_the_same_time_does_not(spark):
    got, _ = found(spark, [ref(1, 1, "gone", at=3), ref(2, 1, "gone", at=2), ref(3, 1, "late", at=9)], TARGETS)
    assert got == {(1, "deleted")}


def test_repeated_deliveries_count_by_the_earliest(spark):
    twice = [ref(1, 1, "gone", at=2), ref(1, 1, "gone", at=8), ref(2, 1, "late", at=8), ref(2, 1, "late", at=12), ref(3, 1, "x"), ref(3, 1, "x")]
    got, df = found(spark, twice, TARGETS)
    assert got == {(2, "late"), (3, "missing")} and df.count() == 2
    assert found(spark, [ref(1, 1, "t", at=5)], [(1, "t", D[9], None, ""), (1, "t", D[2], None, "")])[0] == set()


def test_null_times_are_neither_late_nor_deleted(spark):
    got, _ = found(spark, [ref(1, 1, "late", at=None), ref(2, 1, "gone", at=None), ref(3, 1, "no", at=None)], TARGETS)
    assert got == {(3, "missing")}


@pytest.mark.parametrize("match,want", [("simple", set()), ("partial", {(2, "missing")}), ("full", {(1, "missing"), (2, "missing")})])
def test_partly_null_keys(spark, match, want):
    got, _ = found(spark, [ref(1, None, "a"), ref(2, None, "nope"), ref(3, None, None)], TARGETS, match=match, required=["src"])
    assert got == want


def test_partial_key_is_late_only_if_all_targets_are(spark):
    targets = [(1, "p", D[9], None, ""), (2, "p", D[1], None, ""), (1, "q", D[9], None, ""), (2, "q", D[8], None, "")]
    got, _ = found(spark, [ref(1, None, "p"), ref(2, None, "q")], targets)
    assert got == {(2, "late")}


def test_empty_tables(spark):
    assert found(spark, [], TARGETS)[0] == set()
    assert found(spark, [ref(1, 1, "a")], [])[0] == {(1, "missing")}


def test_report_counts_by_month(spark):
    rows = [("t", "f", 1, "missing", D[1]), ("t", "f", 2, "missing", D[2]), ("t", "f", 3, "late", None)]
    df = spark.createDataFrame(rows, "table_name string, field_name string, row_id int, reason string, created_at timestamp")
    assert {(r["month"], r["reason"], r["n"]) for r in orphan_report(df).collect()} == {("2024-01", "missing", 2), (None, "late", 1)}


def test_hot_key(spark):
    refs = [ref(i, 1, "a" if i % 3 else "nope") for i in range(900)]
    got, _ = found(spark, refs, TARGETS)
    assert len(got) == 300
