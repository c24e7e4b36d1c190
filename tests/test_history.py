"""Point-in-time joins, histories and orphan references on small fixtures, with brute force beside them."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tessera.operators.asof import known_at
from tessera.operators.orphans import Reference, orphan_references, orphan_report
from tessera.operators.scd2 import scd2_history, scd2_merge

D = dt.date


def _known(spark, requests, facts):
    r = spark.createDataFrame(requests, "case string, company string, period date, cutoff date, row_id string")
    f = spark.createDataFrame(facts, "company string, period date, ann date, id string, case string")
    out = known_at(r, f, request_keys=[F.col("company")], request_period=F.col("period"), cutoff=F.col("cutoff"), fact_keys=[F.col("company")], fact_period=F.col("period"), available_on=F.col("ann"), row_id=F.col("id"), rows_per_bucket=20)
    assert out.columns == ["case", "company", "period", "cutoff", "row_id"]
    return sorted((x["case"], x["row_id"]) for x in out.collect())


def test_known_at_never_sees_later_rows(spark):
    facts = [("A", D(2020, 12, 31), D(2021, 4, 1), "e1", ""), ("A", D(2020, 12, 31), D(2021, 8, 1), "e2", ""), ("A", D(2021, 3, 31), D(2021, 4, 20), "e3", ""), (None, D(2021, 3, 31), D(2021, 4, 20), "e4", ""), ("A", D(2021, 6, 30), None, "e5", "")]
    requests = [("c1", "A", D(2020, 12, 31), D(2021, 4, 1), ""), ("c2", "A", D(2020, 12, 31), D(2021, 3, 31), ""), ("c3", "A", None, D(2021, 9, 1), ""), ("c4", "A", None, D(2021, 4, 10), ""), ("c5", None, None, D(2021, 4, 10), ""), ("c5", None, None, D(2021, 4, 10), ""), ("c6", "A", None, None, ""), ("c7", "B", None, D(2022, 1, 1), "")]
    got = _known(spark, requests, facts)
    assert got == [("c1", "e1"), ("c2", None), ("c3", "e3"), ("c4", "e1"), ("c5", None), ("c5", None), ("c6", None), ("c7", None)]


def test_known_at_against_brute_force(spark):
    rnd = random.Random(3)
    day = lambda: D(2020, 1, 1) + dt.timedelta(days=rnd.randrange(60))
    facts = [(rnd.choice("AB"), rnd.choice([D(2019, 12, 31), D(2020, 3, 31)]), day(), f"e{i:03d}", "") for i in range(120)]
    facts += facts[:10]  # repeated rows
    requests = [(f"c{i:03d}", rnd.choice("ABC"), rnd.choice([None, D(2019, 12, 31), D(2020, 3, 31)]), day(), "") for i in range(60)]

    def brute(company, period, cutoff):
        rows = [f for f in facts if f[0] == company and f[2] <= cutoff and (period is None or f[1] == period)]
        return max(((f[1], f[2], f[3]) for f in rows), default=(None,) * 3)[2]

    assert _known(spark, requests, facts) == sorted((c, brute(a, p, k)) for c, a, p, k, _ in requests)


def test_known_at_empty_sides(spark):
    assert _known(spark, [], [("A", D(2020, 1, 1), D(2020, 1, 1), "e", "")]) == []
    assert _known(spark, [("c", "A", None, D(2020, 1, 1), "")], []) == [("c", None)]


def _history(spark, rows):
    df = spark.createDataFrame(rows, "g string, k string, snap date, ann date, v double, valid_from string")
    out = scd2_history(df, group="g", key="k", snapshot="snap", announced="ann", attributes=["v"])
    return sorted((x.g, x.k, x.v if x.v is not None else -1.0, str(x.valid_from), str(x.valid_to)) for x in out.collect())


def test_history_runs_corrections_and_gaps(spark):
    s1, s2, s3, s4 = D(2020, 3, 31), D(2020, 6, 30), D(2020, 9, 30), D(2020, 12, 31)
    a = lambda s: s + dt.timedelta(days=30)
    rows = [("g", "x", s, a(s), 0.1, "") for s in (s1, s2)] + [("g", "x", s3, a(s3), 0.2, "")] + [("g", "x", s4, a(s4), 0.1, "")]
    rows += [("g", "y", s1, a(s1), 0.5, ""), ("g", "y", s3, a(s3), 0.5, "")]  # absent in s2: two versions
    rows += [("g", "z", s2, a(s2), 0.3, "")]
    # s2 is announced again without z
    rows += [("g", "x", s2, a(s3), 0.1, "")]
    rows += rows[:3] + [("g", None, s1, a(s1), 0.1, ""), (None, "x", s1, a(s1), 0.1, ""), ("g", "n", s4, None, 0.1, "")]
    assert _history(spark, rows) == [
        ("g", "x", 0.1, "2020-03-31", "2020-09-30"),
        ("g", "x", 0.1, "2020-12-31", "9999-12-31"),
        ("g", "x", 0.2, "2020-09-30", "2020-12-31"),
        ("g", "y", 0.5, "2020-03-31", "2020-06-30"),
        ("g", "y", 0.5, "2020-09-30", "2020-12-31"),
    ]


def test_history_null_attributes_are_equal_and_empty_is_empty(spark):
    s1, s2 = D(2020, 3, 31), D(2020, 6, 30)
    assert _history(spark, [("g", "x", s1, s1, None, ""), ("g", "x", s2, s2, None, "")]) == [("g", "x", -1.0, "2020-03-31", "9999-12-31")]
    assert _history(spark, []) == []


def test_history_equals_a_fold_of_merges(spark):
    rnd = random.Random(5)
    snaps = [D(2020, m, 1) for m in range(1, 8)]
    rows = [("g", k, s, s, rnd.choice([0.1, 0.2]), "") for s in snaps for k in "abcd" if rnd.random() < 0.7]
    dim = spark.createDataFrame([], "k string, v double, valid_from date, valid_to date")
    for s in snaps:
        batch = spark.createDataFrame([(r[1], r[4]) for r in rows if r[2] == s], "k string, v double")
        dim = spark.createDataFrame(scd2_merge(dim, batch, keys=["k"], attributes=["v"], as_of=str(s)).collect(), dim.schema)
    folded = sorted(("g", x.k, x.v, str(x.valid_from), str(x.valid_to)) for x in dim.collect())
    assert _history(spark, rows) == folded


def test_merge_of_updates_keeps_absent_keys(spark):
    end = D(9999, 12, 31)
    dim = spark.createDataFrame([("a", 1.0, D(2020, 1, 1), end), ("b", 2.0, D(2020, 1, 1), end), ("c", 3.0, D(2019, 1, 1), D(2020, 1, 1))], "k string, v double, valid_from date, valid_to date")
    batch = spark.createDataFrame([("a", 1.5), ("d", None), (None, 9.0), ("a", 1.5)], "k string, v double")
    kept = sorted((x.k, x.v or 0.0, str(x.valid_to)) for x in scd2_merge(dim, batch, keys=["k"], attributes=["v"], as_of="2021-01-01", full_snapshot=False).collect())
    assert kept == [("a", 1.0, "2021-01-01"), ("a", 1.5, "9999-12-31"), ("b", 2.0, "9999-12-31"), ("c", 3.0, "2020-01-01"), ("d", 0.0, "9999-12-31")]


def _refs(spark, rows, parents):
    r = spark.createDataFrame(rows, "id string, fk string, loaded timestamp_ntz, orphan_kind string")
    p = spark.createDataFrame(parents, "pk string, loaded timestamp_ntz, gone timestamp_ntz")
    return Reference("r", r, "id", "fk", "loaded", p, "pk", "loaded", "gone")


def test_orphans(spark):
    t = dt.datetime
    may, june = t(2021, 5, 1), t(2021, 6, 1)
    rows = [("1", " P1\t", may, ""), ("2", "p2", may, ""), ("3", "x", june, ""), ("3", "x", june, ""), ("4", None, may, ""), ("5", "P3", may, ""), ("6", "p4", may, ""), ("7", "p4", june, ""), ("8", "p1", None, "")]
    parents = [("P1", may, None), ("p2", may, june), ("p3", june, june), ("p4", t(2021, 5, 15), None), (None, may, None)]
    ref = _refs(spark, rows, parents)
    assert sorted(map(tuple, orphan_references(ref).collect())) == [("r", "2", "2021-05", "deleted"), ("r", "3", "2021-06", "missing"), ("r", "5", "2021-05", "deleted"), ("r", "5", "2021-05", "late"), ("r", "6", "2021-05", "late")]
    report = {(x.period, x.orphan_kind): (x.n_orphans, x.n_rows) for x in orphan_report([ref]).collect()}
    assert report["2021-05", "deleted"] == (2, 5)


def test_orphans_empty_tables(spark):
    t = dt.datetime(2021, 5, 1)
    assert orphan_references(_refs(spark, [], [("p", t, None)])).collect() == []
    assert [x.orphan_kind for x in orphan_references(_refs(spark, [("1", "p", t, "")], [])).collect()] == ["missing"]
