"""Look-ups of events, folds of their fields, and the calendar: plans and small cases."""

import random

import pytest
from tradebook.operators import matching as M, prefix, reports
from tradebook.plans import standins as S
from tradebook.plans.catalog.events import events, guarded, keys


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_one_look_up_table_reads_each_input_once(spark, sf_dir):
    looked = M.holders(M.key_rows(*keys(spark, sf_dir)))
    plan = plan_of(M.classify_event(events(spark, sf_dir), *keys(spark, sf_dir)))
    assert plan.count("/customer.parquet") == 1 and plan.count("/orders.parquet") == 1
    assert looked.groupBy("key").count().filter("count > 1").isEmpty()


def test_first_holder_of_a_key(spark):
    jobs = spark.createDataFrame([(9, 1, "r1", "5"), (4, 2, "r1", None), (5, 3, None, "7")],
                                 "job_id long, customer_id long, ref_key string, stored string")
    customers = spark.createDataFrame(
        [(1, "A", "e1", "p1", "r1", "8"), (2, "B", "e1", None, "r2", "3"), (3, "C", None, "p1", "r2", "4"), (4, None, None, None, None, None)],
        "customer_id long, name string, email_key string, phone_key string, ref_key string, stored string")
    got = {r.key: (r.is_customer, r.id, r.owner, r.stored) for r in M.holders(M.key_rows(jobs, customers)).collect()}
    assert got == {"r:r1": (False, 4, 2, None), "r:r2": (True, 2, 2, "3"), "e:e1": (True, 1, 1, None), "p:p1": (True, 1, 1, None)}


def test_fold_aggregates_numbers_only(spark, sf_dir):
    fields = ["quote_value", "installation_value", "ext_status", "modified"]
    plan = plan_of(M.fold_sparse_updates(guarded(spark, sf_dir), "ref_key", "seq", fields))
    assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_fold_keeps_last_known_values(spark):
    r = random.Random(4)
    rows = [(f"k{r.randrange(5)}" if i % 3 else "hot", i, r.choice(["", None, f"a{i}"]), r.choice(["", f"b{i}"]), r.random() < 0.7)
            for i in range(300)]
    rows += [("none", 1000, "x", "y", False), ("blank", 1001, "", None, True)]
    df = spark.createDataFrame(rows, "key string, at long, a string, b string, applied boolean").repartition(5)
    want = {k: [None, None] for k, *_ in rows}
    for key, _, a, b, applied in sorted(rows, key=lambda x: x[1]):
        if applied:
            want[key] = [a or want[key][0], b or want[key][1]]
    got = M.fold_sparse_updates(df, "key", "at", ["a", "b"]).collect()
    assert {x.key: [x.a, x.b] for x in got} == want and len(got) == len(want)
    assert M.fold_sparse_updates(df.limit(0), "key", "at", ["a", "b"]).isEmpty()


@pytest.mark.parametrize("bits,writes", [(16, ["calendar"]), (0, ["calendar", "hot", "ranked"])])
def test_calendar_entries_are_written_once(spark, sf_dir, monkeypatch, bits, writes):
    """Only the entries of crowded days go by range, and the places are those of a plain window."""
    labels = []
    for module in (reports, prefix):
        kept = module.stored
        monkeypatch.setattr(module, "stored", lambda df, label, kept=kept: labels.append(label) or kept(df, label))
    kept = reports.ranged_rank
    monkeypatch.setattr(reports, "ranged_rank", lambda *a: kept(*a, bits))
    rows = reports.booking_calendar(S.jobs(spark, sf_dir), S.customers(spark, sf_dir)).collect()
    assert labels == writes
    days = {}
    for x in rows:
        days.setdefault((x.fitter, x.event_date), []).append(x)
    assert max(map(len, days.values())) > 1
    for entries in days.values():
        entries.sort(key=lambda x: x.seq_in_day)
        assert [x.seq_in_day for x in entries] == list(range(1, len(entries) + 1))
        assert [(x.start, x.kind, x.job_id, x.pos) for x in entries] == sorted(
            (x.start, x.kind, x.job_id, x.pos) for x in entries)
