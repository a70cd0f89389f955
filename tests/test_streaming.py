"""Batches that are run again, split differently, or compacted give the same tables."""

import json
import random
from pathlib import Path

from pyspark.sql import functions as F

from tradebook.operators import reminders as R
from tradebook.operators.deliveries import capture_raw_event
from tradebook.operators.replay import merged, replay
from tradebook.operators.deliveries import project_events
from tradebook.plans import daily
from tradebook.schemas import CUSTOMERS, DELIVERIES, JOBS, LINK
from tradebook.session import scratch_dir
from tradebook.sources.tables import ChangingTable, _complete
from tradebook.streaming import jobs as ST


def bodies(n):
    r = random.Random(5)
    for i in range(n):
        pairs = [("Reference", f"R{r.randrange(8)}"), ("Email", r.choice(["a", "b", "c", ""])),
                 ("Phone", r.choice(["1", "2", ""])), ("Name", f"N{i}")]
        yield json.dumps({"json": {
            "infoProperties": [{"name": k, "value": v} for k, v in pairs],
            "price": r.randrange(3), "modifiedDate": str(r.randrange(9))}})


def state(jobs, customers):
    def rows(df, columns):
        return sorted(
            (*[r[c] for c in columns], json.dumps(json.loads(r.data_json), sort_keys=True))
            for r in df.withColumn("data_json", F.regexp_replace(
                "data_json", r'"(wonAt|createdAt)":"[^"]*"', '"at":""')).collect())

    return rows(jobs, ["id", "customer_id", "title"]), rows(customers, ["id", "name", "stage"])


def test_batches_equal_one_run(spark):
    rows = [(i, 1, None, "text/plain", b) for i, b in enumerate(bodies(40))]
    captured = capture_raw_event(spark.createDataFrame(rows, DELIVERIES)).cache()
    no_jobs = spark.createDataFrame([], JOBS)
    no_customers = spark.createDataFrame([], CUSTOMERS)
    now = F.lit("2026-01-01").cast("timestamp")
    whole = replay(project_events(captured), no_jobs, no_customers, now)
    expected = state(merged(no_jobs, whole.jobs), merged(no_customers, whole.customers))

    folder = scratch_dir(spark, "test")
    jobs, customers = ST.crm_tables(spark, folder)
    jobs.start(no_jobs)
    customers.start(no_customers)
    for batch_id, (first, last) in enumerate(((0, 15), (15, 40))):
        part = captured.filter(F.col("seq").between(first, last - 1))
        ST.apply_batch(spark, part, folder, batch_id)
        if batch_id == 0:
            # A second attempt finds the first one's output and must not build on it.
            ST.apply_batch(spark, part, folder, batch_id)
    got = state(jobs.current(), customers.current())
    assert [r[:3] for r in got[0]] == [r[:3] for r in expected[0]]
    assert [r[:3] for r in got[1]] == [r[:3] for r in expected[1]]
    deal = ("quoteValue", "externalRef", "externalModifiedAt", "email", "phone")
    for mine, want in zip(got[0] + got[1], expected[0] + expected[1]):
        mine, want = json.loads(mine[-1]), json.loads(want[-1])
        assert [mine.get(f) for f in deal] == [want.get(f) for f in deal]

    before = state(jobs.current(), customers.current())
    jobs.compact()
    customers.compact()
    assert state(jobs.current(), customers.current()) == before


def test_changes_replace_rows(spark):
    table = ChangingTable(spark, scratch_dir(spark, "table"), "id long, v string")

    def rows(*pairs):
        return spark.createDataFrame(list(pairs), "id long, v string")

    table.start(rows((1, "a"), (2, "b")))
    table.write_changes(rows((2, "c"), (3, "d")), 0)
    table.write_changes(rows((3, "e")), 1)

    def read(before=None):
        return sorted(map(tuple, table.current(before).collect()))

    assert read(0) == [(1, "a"), (2, "b")]
    assert read(1) == [(1, "a"), (2, "c"), (3, "d")]
    assert read() == [(1, "a"), (2, "c"), (3, "e")]
    table.compact()
    table.write_changes(rows((1, "z")), 2)
    assert read() == [(1, "z"), (2, "c"), (3, "e")]


def test_compaction_can_be_run_again(spark):
    folder = scratch_dir(spark, "compacted")
    table = ChangingTable(spark, folder, "id long, v string")

    def rows(*pairs):
        return spark.createDataFrame(list(pairs), "id long, v string")

    table.start(rows((1, "a")))
    for n in range(12):
        for _ in range(2):
            # The batch and its compaction both run a second time.
            assert len(table.current(n).collect()) == n + 1
            table.write_changes(rows((1, f"v{n}"), (n + 2, "new")), n)
            if n % 3 == 2:
                table.compact(n)
        assert ("v%d" % n) in [r.v for r in table.current().collect()]
    assert sorted(_complete(spark, f"{folder}/base", "through=")) == [8, 11]
    assert sorted(_complete(spark, f"{folder}/changes", "batch=")) == [9, 10, 11]
    assert table.current().count() == 13


def version(i, n, **survey):
    return (i, 1, n, json.dumps({"tabs": {"survey": survey}}))


def test_versions_in_one_batch_and_across(spark):
    folder = scratch_dir(spark, "versions")
    ChangingTable(spark, f"{folder}/state", ST.VERSIONS).start(
        spark.createDataFrame([], ST.VERSIONS))

    def run(batch_id, *rows):
        ST.transitions_batch(spark, spark.createDataFrame(list(rows), ST.VERSIONS),
                             f"{folder}/state", f"{folder}/out", batch_id, bits=1)
        return sorted((r.job_id, r.message_fitters)
                      for r in spark.read.parquet(f"{folder}/out/batch={batch_id}").collect())

    full = {"date": "2026-01-01", "fitter": "F"}
    # A first version is a creation and gives no message; blank, then filled, gives one.
    assert run(0, version(1, 1, **full), version(2, 1), version(2, 5, **full)) == [(2, "F")]
    assert run(1, version(1, 2), version(2, 6, **full)) == []
    again = [version(1, 3, date="2026-01-01", fitter="G"), version(1, 4, **full), version(2, 7)]
    assert run(2, *again) == [(1, "G")]
    assert run(2, *again) == [(1, "G")]


def spoil(folder, keep=()):
    """Overwrite all files of a table but those of the partitions to keep; reading one of them then fails."""
    count = 0
    for path in Path(folder.removeprefix("file:")).rglob("*.parquet"):
        if not any(part in path.parts for part in keep):
            path.write_bytes(b"spoilt")
            count += 1
    return count


def project(reference, email="", phone="", modified="", name=""):
    pairs = [("Reference", reference), ("Email", email), ("Phone", phone), ("Name", name)]
    return json.dumps({"json": {"infoProperties": [{"name": k, "value": v} for k, v in pairs], "modifiedDate": modified}})


def deliver(spark, first, *texts):
    return capture_raw_event(spark.createDataFrame([(first + i, 1, None, "", t) for i, t in enumerate(texts)], DELIVERIES))


def many_records(spark, folder, n=300):
    """Jobs and customers with keys of their own, 1 .. n."""
    at = F.lit("2026-01-01").cast("timestamp")
    rows = spark.range(1, n + 1).withColumn("tenant_id", F.lit(1).cast("long"))
    jobs, customers = ST.crm_tables(spark, folder)
    jobs.start(rows.select(
        "id", "tenant_id", F.col("id").alias("customer_id"), F.lit("T").alias("title"), F.lit("S").alias("status"),
        F.format_string('{"externalRef":"J%d","externalModifiedAt":"5"}', "id").alias("data_json"),
        at.alias("created_at"), at.alias("updated_at")))
    customers.start(rows.select(
        "id", "tenant_id", F.format_string("N%d", "id").alias("name"), F.lit("S").alias("stage"),
        F.format_string('{"email":"e%d@x","phone":"%d"}', "id", "id").alias("data_json"),
        at.alias("created_at"), at.alias("updated_at")))
    return jobs, customers


def actions(spark, folder, batch_id):
    return [(r.action, r.job_id, r.customer_id, r.matched_by)
            for r in spark.read.parquet(f"{folder}/actions/batch={batch_id}").orderBy("seq").collect()]


def test_a_batch_reads_the_buckets_it_asks_for(spark):
    folder = scratch_dir(spark, "buckets")
    jobs, customers = many_records(spark, folder)
    ST.apply_batch(spark, deliver(spark, 0, project("new", email="nobody@x", phone="none")), folder, 0)
    assert actions(spark, folder, 0) == [("created-customer", None, 301, None)]
    ids = spark.createDataFrame([(7,), (301,)], "id long")
    mine = [f"_bucket={n}" for n in jobs.places(ids)]
    asked = [f"_bucket={n}" for n in ST.key_table(spark, folder).places(spark.createDataFrame(
        [(k,) for k in ("r:1:j7", "r:1:new", "r:1:other", "e:1:e7@x", "e:1:new7@x", "p:1:7")], "key string"))]
    assert spoil(f"{folder}/jobs", mine) > 20 and spoil(f"{folder}/customers", mine) > 20 and spoil(f"{folder}/keys", asked) > 20
    ST.apply_batch(spark, deliver(
        spark, 10, project("J7", modified="6", email="new7@x"), project("other", email="E7@x", phone="7"), project("new", modified="2"),
    ), folder, 1)
    # The job's event gave customer 7 another e-mail, so the second one goes by phone.
    assert actions(spark, folder, 1) == [
        ("updated-job", 7, None, "reference"), ("created-job", 301, 7, "phone"), ("updated-customer", None, 301, "reference")]


def test_late_events_are_refused_without_a_document(spark):
    folder = scratch_dir(spark, "late")
    many_records(spark, folder, 40)
    for n in range(2):
        ST.apply_batch(spark, deliver(spark, 10 * n, project("J3", modified=f"6{n}"), project("lead", phone="x", modified=f"7{n}")), folder, n)
    spoil(f"{folder}/jobs")
    # The customers hold whom a job belongs to; their documents are not needed either.
    ST.apply_batch(spark, deliver(
        spark, 90, project("J3", modified="61"), project("lead", modified="70"), project("J3", modified="4"), project("J9", modified="5"),
    ), folder, 2)
    assert [a[0] for a in actions(spark, folder, 2)] == ["skipped-stale"] * 4


def test_keys_that_were_lost_are_not_found(spark):
    folder = scratch_dir(spark, "lost")
    many_records(spark, folder, 30)
    ST.apply_batch(spark, deliver(spark, 0, project("J3", modified="6", email="moved@x")), folder, 0)
    for _ in range(2):
        # Also when the batch is run a second time.
        ST.apply_batch(spark, deliver(spark, 10, project("a", email="e3@x"), project("b", email="moved@x"), project("c", phone="3")), folder, 1)
        assert [(a, c) for a, _, c, _ in actions(spark, folder, 1)] == [
            ("created-customer", 31), ("created-job", 3), ("created-job", 3)]
    for table in (*ST.crm_tables(spark, folder), ST.key_table(spark, folder)):
        table.compact(1)
    held = {(r.key, r.id) for r in ST.key_table(spark, folder).current().collect()}
    assert ("e:1:moved@x", 3) in held and ("e:1:e3@x", 3) not in held and ("e:1:e3@x", 31) in held
    jobs, customers = ST.published_tables(spark, folder)
    assert {(r.key, r.id) for r in ST._keys_of(jobs, customers, LINK).collect()} == held


def test_a_part_of_a_batch_is_not_published(spark):
    folder = scratch_dir(spark, "published")
    jobs, customers = many_records(spark, folder, 10)
    assert ST.published(spark, folder) is None and ST.published_tables(spark, folder)[0].count() == 10
    ST.apply_batch(spark, deliver(spark, 0, project("new", email="n@x")), folder, 0)
    assert ST.published(spark, folder) == 0 and ST.published_tables(spark, folder)[1].count() == 11
    # A later batch stops half-way: its customers are written, its jobs are not.
    customers.write_changes(customers.current().limit(1).withColumn("id", F.lit(99).cast("long")), 1)
    assert ST.published_tables(spark, folder)[1].count() == 11 and customers.current().count() == 12


def test_versions_are_read_by_bucket(spark):
    folder = scratch_dir(spark, "version-buckets")
    state = ST.version_state(spark, f"{folder}/state")
    state.start(spark.createDataFrame([], ST.VERSIONS))

    def run(batch_id, *rows):
        ST.transitions_batch(spark, spark.createDataFrame(list(rows), ST.VERSIONS), f"{folder}/state", f"{folder}/out", batch_id)
        return sorted(r.job_id for r in spark.read.parquet(f"{folder}/out/batch={batch_id}").collect())

    assert run(0, *[version(i, 1) for i in range(200)]) == []
    mine = state.places(spark.createDataFrame([(5,), (17,)], "id long"))
    assert spoil(f"{folder}/state", [f"_bucket={n}" for n in mine]) > 20
    full = {"date": "2026-01-01", "fitter": "F"}
    assert run(1, version(5, 2, **full), version(17, 2)) == [5]
    assert run(2, version(5, 3, **full), version(17, 3, **full)) == [17]


def dated_job(i, survey, install, sent=False):
    mark = {"status": "sent" if sent else "pending", "sentAt": ""}
    tabs = {"survey": {"date": survey, "fitter": "F"},
            "installation": {"date": install, "fitters": ["A"], "emailReminders": {"week": mark, "day": mark}},
            "serviceCall": {"bookings": [{"id": "b1", "date": survey, "fitter": "F"}, {"id": "b1", "date": install, "fitter": "G"}]}}
    return (i, 1, i, "T", "S", json.dumps({"tabs": tabs}), None, None)


def test_schedule_is_kept_up_to_date(spark):
    """After any save the schedule gives what all documents give, from the months concerned."""
    r = random.Random(11)
    days = ["2026-01-30", "2026-01-31", "2026-02-01", "2026-02-05", "2026-07-01", "", "soon"]

    def draw(i):
        return dated_job(i, r.choice(days), r.choice(days), r.random() < 0.3)

    folder = scratch_dir(spark, "schedule")
    schedule = daily.schedule_table(spark, folder)
    rows = {i: draw(i) for i in range(30)}

    def frame(some):
        return spark.createDataFrame(list(some), JOBS)

    def check(before=None):
        for day in ("2026-01-30", "2026-02-01"):
            want = R.due_reminders(frame(rows.values()), day)
            got = daily.scheduled_due(schedule, day, before).select(*want.columns)
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))

    schedule.start(daily.monthly_schedule(frame(rows.values())))
    check()
    for batch_id in range(4):
        saved = r.sample(sorted(rows), 8)
        before = frame(rows[i] for i in saved)
        gone = saved[0] if batch_id == 3 else None
        rows.update({i: draw(i) for i in saved})
        if gone is not None:
            del rows[gone]
        new = [] if batch_id % 2 else [100 + batch_id]
        rows.update({i: draw(i) for i in new})
        daily.record_schedule(schedule, before, frame(rows[i] for i in [*saved, *new] if i in rows), batch_id)
        check()
        if batch_id == 1:
            schedule.compact(1)
            check()
    daily.record_schedule(schedule, None, frame([rows.setdefault(500, draw(500))]), 4)
    check()
    assert spoil(folder, ["event_month=2026-01", "event_month=2026-02"]) > 1
    check()


def test_daily_run_reads_the_schedule_alone(spark):
    folder = scratch_dir(spark, "daily")
    schedule = daily.schedule_table(spark, f"{folder}/schedule")
    jobs = spark.createDataFrame([dated_job(i, "2026-02-01", "2026-02-05") for i in range(1, 6)], JOBS)
    people = spark.createDataFrame(
        [(i, 1, f"N{i}", "S", json.dumps({"name": f"N{i}", "email": f"e{i}@x"}), None, None) for i in range(1, 6)], CUSTOMERS)
    settings = spark.createDataFrame([], "tenant_id long, data_json string, updated_at timestamp")
    schedule.start(daily.monthly_schedule(jobs))
    unread = spark.read.schema(JOBS).parquet(f"{folder}/schedule").filter(F.raise_error(F.lit("jobs were read")).isNull())
    outbox, rejects = daily.daily_reminder_run(
        spark, unread, people, settings, "2026-02-01", f"{folder}/out", schedule=schedule)
    assert outbox.count() == 15 and rejects.isEmpty()
    results = outbox.filter("job_id <= 2").select(
        "job_id", "booking_id", "kind", F.lit("Succeeded").alias("status"), F.lit(None).cast("string").alias("error"))
    after, failed = daily.close_daily_run(
        jobs, outbox, results, F.lit("2026-02-01").cast("date"), schedule=schedule, batch_id=0)
    assert failed.count() == 9
    for day in ("2026-02-01", "2026-02-04"):
        want = R.due_reminders(after, day)
        got = daily.scheduled_due(schedule, day).select(*want.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count()
