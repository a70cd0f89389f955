"""Hand-made rows for the rules that are easy to get wrong."""

import json

import pytest
from pyspark.sql import functions as F

from tradebook import schemas
from tradebook.functions import dates as DT
from tradebook.functions import documents as DOC
from tradebook.functions import text as T
from tradebook.operators import bookings as B
from tradebook.operators import deliveries as D
from tradebook.operators import entities as E
from tradebook.operators import matching as M
from tradebook.operators import outbox as O
from tradebook.operators import reminders as R
from tradebook.operators import reports as REP
from tradebook.operators import snapshots as S
from tradebook.schemas import LINK

RUN = "2026-08-03"


def values(spark, texts, expression):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("t"))).collect()]


# ---- functions -------------------------------------------------------------------------------

def test_norm_and_trim(spark):
    assert values(spark, ["\t A@B  ", None, " ", "x\u0085"], T.norm_text) == [
        "a@b", "", "", "x\u0085"]
    assert values(spark, ["﻿  ", "B"], T.norm_key) == [None, "b"]


def test_fee(spark):
    got = values(spark, ["Fee £1,250.50", "£  7", "1250", "£1.5.2", "a £2 b £3", None], T.parse_fee)
    assert got == ["1250.50", "7", "", "1.5", "2", ""]


def test_price(spark):
    prices = ["0", "-4", '"12"', "1200.0", "12000000", "0.1", "1e3", "1e21", "1e-7", "true", "null",
              "123456789.123456789", "0.000012", "[]"]
    got = values(spark, prices, lambda t: DOC.positive_price_text(F.parse_json(t)))
    assert got == ["", "", "", "1200", "12000000", "0.1", "1000", "1e+21", "1e-7", "", "",
                   "123456789.12345679", "0.000012", ""]


def test_truth(spark):
    texts = ["0", "0.0", '""', "false", "null", "{}", "[]", '"0"', "1", "true", '" "']
    assert values(spark, texts, lambda t: DOC.is_truthy(F.parse_json(t))) == [
        False, False, False, False, False, True, True, True, True, True, True]


def test_dates(spark):
    days = ["2026-08-02", "2026-08-03", "2026-08-10", "", "not a date", "2026-08-04T09:30:00Z", None]
    assert values(spark, days, lambda t: DT.days_until(t, RUN)) == [-1, 0, 7, None, None, 1, None]
    assert values(spark, ["2026-08-03", ""], DT.long_date) == ["Monday 3 August 2026", ""]


def test_template(spark):
    def fill(t):
        return T.fill_template(t, {"a": F.lit("[{{b}}] $& $$"), "b": F.lit(None).cast("string")})

    assert values(spark, ["{{a}} {{b}} {{c}} {{a}}"], fill) == ["[] $& $$  {{c}} [] $& $$"]


def test_file_name(spark):
    assert values(spark, ["a b/ü.pdf", "", None], T.safe_file_name) == ["a_b__.pdf", "file", "file"]


def test_redaction(spark):
    df = spark.createDataFrame([({"a": "pw", "b": ""}, "fitter"), ({"a": "pw", "b": ""}, "office"),
                                ({"a": "pw", "b": ""}, None)], "m map<string,string>, role string")
    got = [r[0] for r in df.select(DOC.redact_map(F.col("m"), F.col("role"))).collect()]
    assert got == [{"a": "true", "b": ""}, {"a": "pw", "b": ""}, {"a": "true", "b": ""}]


def test_edit_keeps_other_fields(spark):
    doc = '{"a":{"b":{"c":1},"x":[1,"t",{"y":null}]},"n":1.5,"s":"q","t":true}'

    def edit(t):
        return F.to_json(DOC.with_path(F.parse_json(t), ["a", "b", "z"], F.lit("new").cast("variant")))

    got = json.loads(values(spark, [doc], edit)[0])
    want = json.loads(doc)
    want["a"]["b"]["z"] = "new"
    assert got == want
    assert json.loads(values(spark, ['{"a":5}'], edit)[0]) == {"a": {"b": {"z": "new"}}}


# ---- payloads --------------------------------------------------------------------------------

def deliveries(spark, bodies, content_type="application/json"):
    df = spark.createDataFrame(
        [(i, 1, content_type, b) for i, b in enumerate(bodies)],
        "seq long, tenant_id long, content_type string, raw_text string",
    )
    return df.withColumn("received_at", F.lit("2026-01-01").cast("timestamp"))


def project(*pairs, **rest):
    return json.dumps({"json": {"infoProperties": [{"name": n, "value": v} for n, v in pairs], **rest}})


def test_lenient_parse(spark):
    long_text = "x" * 3000
    got = D.lenient_payload_parse(
        deliveries(spark, ['{"a":1}', long_text, "null", '{"a":1,"a":2}'], "text/plain")
    ).orderBy("seq").collect()
    assert [r.is_json for r in got] == [True, False, True, True]
    wrapped = json.loads(got[1].payload)
    assert wrapped == {"_nonJsonBody": True, "contentType": "text/plain", "rawText": "x" * 2000}


def test_capture_keeps_whole_texts(spark):
    kept = D.capture_raw_event(deliveries(spark, ["x" * 3000, '{"a":1}'])).orderBy("seq").collect()
    assert [r.raw_text for r in kept] == ["x" * 3000, None]


def test_gate(spark):
    bodies = ['{"json":{"infoProperties":[]}}', '{"json":{"infoProperties":{}}}', '{"json":{}}',
              "null", "[1]", "5", "text", '{"json":{"infoProperties":"[]"}}', '{"json":null}']
    captured = D.capture_raw_event(deliveries(spark, bodies))
    assert [r.seq for r in D.project_payload_gate(captured).collect()] == [0]
    assert [r.seq for r in D.extract_project_fields(captured).collect()] == [0]


def test_extraction(spark):
    bodies = [
        project(("Reference", "old"), ("Reference", " R-1 "), ("Email", "\tA@b "), ("Address", " 1 Rd"),
                ("Postcode", ""), ("Installation Fee", "£ 1,000"), price=12.50, statusName=" Won ",
                modifiedDate="2026-01-01"),
        project(("Reference", 5), ("Name", 0), ("Phone", None)),
        project(("Name", "no reference"), price="7"),
        project(("Reference", "R"), ("Address", 7), ("Postcode", "P"), statusName=[1]),
        json.dumps({"json": {"infoProperties": ["odd", {"name": "Reference", "value": "R-9"}, {}]}}),
    ]
    got = D.extract_project_fields(D.capture_raw_event(deliveries(spark, bodies)), keep=("seq",))
    rows = [tuple(r)[1:] for r in got.orderBy("seq").collect()]
    assert rows[0] == ("R-1", "", "A@b", "", " 1 Rd", "12.5", "1000", "Won", "2026-01-01", None)
    assert rows[1][-1] == "Reference is a number"
    assert rows[2] == ("", "no reference", "", "", "", "", "", "", "", None)
    assert rows[3][4] == "7, P" and rows[3][-1] == "statusName is a array"
    assert rows[4][0] == "R-9" and rows[4][-1] is None


def test_quarantine(spark):
    df = spark.createDataFrame([(1, "{}"), (2, "bad"), (3, "null"), (4, '{"a":1,"a":2}')],
                               "id int, data_json string")
    good, rejects = E.split_json(df)
    assert {r.id for r in good.collect()} == {1, 4}
    assert {(r.id, r.reason) for r in rejects.collect()} == {(2, "not json"), (3, "json null")}


# ---- jobs, reminders, bookings ---------------------------------------------------------------

def jobs(spark, *docs, customer_id=1):
    df = spark.createDataFrame(
        [(i, 1, customer_id, "", "", json.dumps(d) if isinstance(d, dict) else d)
         for i, d in enumerate(docs, start=1)],
        "id long, tenant_id long, customer_id long, title string, status string, data_json string",
    )
    at = F.lit("2026-01-01").cast("timestamp")
    return df.withColumn("created_at", at).withColumn("updated_at", at)


def tabs(**kw):
    return {"tabs": kw}


def test_install_reminders_by_day(spark):
    days = ["2026-08-02", "2026-08-03", "2026-08-04", "2026-08-10", "2026-08-11", "", "soon"]
    due = R.due_reminders(jobs(spark, *[tabs(installation={"date": d, "notifyEnabled": False})
                                        for d in days]), RUN)
    got = sorted((r.job_id, r.kind) for r in due.collect())
    assert got == [(2, "install_day"), (3, "install_day"), (3, "install_week"), (4, "install_week")]


def test_reminder_marks_and_switches(spark):
    def survey(**more):
        return tabs(survey={"date": "2026-08-04", "fitter": "F", **more})

    due = R.due_reminders(jobs(
        spark, survey(), survey(reminderSent={"status": "pending"}), survey(reminderSent={}),
        survey(reminderSent={"status": "sent"}), survey(notifyEnabled=False),
        survey(notifyEnabled="false"), survey(notifyEnabled=None), survey(fitter=""),
        "null", "[]", "bad",
    ), RUN)
    assert sorted(r.job_id for r in due.collect()) == [1, 2, 3, 6, 7]


def test_duplicate_booking_ids(spark):
    bookings = [{"id": "a", "date": "2026-08-04", "fitter": "F1"},
                {"id": "a", "date": "2026-08-03", "fitter": "F2"}]
    due = R.due_reminders(jobs(spark, tabs(serviceCall={"bookings": bookings})), RUN).collect()
    assert sorted((r.event_date, r.message_date, r.message_fitters) for r in due) == [
        ("2026-08-03", "2026-08-04", "F1"), ("2026-08-04", "2026-08-04", "F1")]


def transitions(spark, was, now):
    got = B.booking_transitions(jobs(spark, was), jobs(spark, now)).collect()
    return sorted((r.kind, r.booking_id) for r in got)


@pytest.mark.parametrize("was,now,expected", [
    ({}, {"date": "d", "fitter": "f"}, True),
    ({"date": "d"}, {"date": "d", "fitter": "f"}, True),
    ({"date": "d", "fitter": "f"}, {"date": "e", "fitter": "f"}, False),
    ({}, {"date": "d", "fitter": "f", "emailSent": {"status": "pending"}}, False),
    *[({}, {"date": "d", "fitter": "f", "emailSent": mark}, False)
      for mark in (True, "sent", "false", [], {}, 1)],
    *[({}, {"date": "d", "fitter": "f", "emailSent": mark}, True) for mark in (None, False, "", 0)],
    ({}, {"date": "d", "fitter": "f", "notifyEnabled": False}, False),
    ({}, {"date": "d", "fitter": ""}, False),
])
def test_survey_booked(spark, was, now, expected):
    assert transitions(spark, tabs(survey=was), tabs(survey=now)) == (
        [("survey_booked", None)] if expected else [])


def test_install_booked(spark):
    now = tabs(installation={"date": "d", "fitters": ["f"]})
    assert transitions(spark, tabs(installation={"date": "d", "fitters": []}), now) == [
        ("install_booked", None)]
    assert transitions(spark, now, now) == []


def test_service_bookings(spark):
    was = tabs(serviceCall={"bookings": [
        {"id": "blank"}, {"id": "kept", "date": "d", "fitter": "f"},
        {"id": "twice", "date": "d", "fitter": "f"}, {"id": "twice"}]})
    now = tabs(serviceCall={"bookings": [
        {"id": "blank", "date": "d", "fitter": "f"}, {"id": "kept", "date": "x", "fitter": "f"},
        {"id": "new", "date": "d", "fitter": "f"}, {"id": "half", "date": "d"},
        {"id": "twice", "date": "d", "fitter": "f"},
        {"id": "sent", "date": "d", "fitter": "f", "emailSent": {}}]})
    assert transitions(spark, was, now) == [
        ("service_booked", "blank"), ("service_booked", "new"), ("service_booked", "twice")]


def test_new_job_triggers_nothing(spark):
    now = jobs(spark, tabs(survey={"date": "d", "fitter": "f"}))
    assert B.booking_transitions(now.filter("id < 0"), now).isEmpty()


# ---- messages --------------------------------------------------------------------------------

def customers(spark, *docs):
    df = spark.createDataFrame(
        [(i, 1, "column name", "", json.dumps(d)) for i, d in enumerate(docs, start=1)],
        "id long, tenant_id long, name string, stage string, data_json string")
    at = F.lit("2026-01-01").cast("timestamp")
    return df.withColumn("created_at", at).withColumn("updated_at", at)


def settings(spark, doc=None):
    rows = [] if doc is None else [(1, json.dumps(doc))]
    return spark.createDataFrame(rows, "tenant_id long, data_json string")


def outbox(spark, customer, doc=None, **kw):
    due = R.due_reminders(jobs(spark, tabs(installation={"date": "2026-08-03", "fitters": ["A", "B"]})),
                          RUN, (R.INSTALL_DAY,))
    made, rejects = O.build_outbox(due, customers(spark, customer), settings(spark, doc),
                                   O.default_templates(spark), **kw)
    return made.collect(), rejects.collect()


def test_message_with_default_template(spark):
    (m,), rejects = outbox(spark, {"name": "{{companyName}}", "email": "", "email2": "b@x"})
    assert not rejects and m.to == ["b@x"] and m.bcc is None
    # The name brings in a later key, which is filled as well.
    assert m.subject == "Installation tomorrow for Our company"
    assert "When: Monday 3 August 2026\nWho: A, B\n" in m.body


def test_message_with_own_template(spark):
    own = {"subject": "S {{surveyDate}} {{companyName}}", "body": "B", "bcc": "  "}
    doc = {"companyName": "C", "emailTemplates": {"installReminderDay": own}}
    (m,), _ = outbox(spark, {"name": "N", "email": "a@x", "email2": "b@x"}, doc)
    assert (m.to, m.bcc, m.subject, m.body) == (["a@x", "b@x"], None, "S {{surveyDate}} C", "B")


def test_own_template_counts_as_a_whole(spark):
    doc = {"emailTemplates": {"installReminderDay": {"subject": "no body"}}}
    made, rejects = outbox(spark, {"name": "N", "email": "a@x"}, doc)
    assert not made and [r.reason for r in rejects] == ["template incomplete"]


def test_rejects_and_test_address(spark):
    made, rejects = outbox(spark, {"name": "N"})
    assert not made and [r.reason for r in rejects] == ["no recipient"]
    (m,), rejects = outbox(spark, {"name": "N"}, test_email="t@x")
    assert m.to == ["t@x"] and m.is_test and not rejects


def test_results(spark):
    box = spark.createDataFrame(
        [(1, None, "install_day", False), (2, None, "install_day", False),
         (3, "b", "service_day", False), (4, None, "install_day", True)],
        "job_id long, booking_id string, kind string, is_test boolean")
    results = spark.createDataFrame(
        [(1, None, "install_day", "Failed", "", "full"), (1, None, "install_day", "Succeeded", "", None),
         (2, None, "install_day", "Failed", "", "bounced"), (4, None, "install_day", "Succeeded", "", None)],
        schemas.SEND_RESULTS)
    sent, failed = O.reconcile_send_results(box, results)
    assert [r.job_id for r in sent.collect()] == [1]
    assert sorted((r.job_id, r.status, r.error) for r in failed.collect()) == [
        (2, "Failed", "bounced"), (3, "no result", None)]


def test_marks(spark):
    docs = [
        {"x": {"y": [1]}}, {"tabs": {"installation": {"emailReminders": {"day": {"status": "pending"}}}}},
        {"tabs": {"serviceCall": {"bookings": [{"id": "a", "k": 1}, {"id": "b"}, {"id": "a"}]}}},
        {"untouched": 1},
    ]
    sent = spark.createDataFrame(
        [(1, None, R.INSTALL_WEEK), (1, None, R.SURVEY_DAY), (2, None, R.INSTALL_WEEK),
         (3, "a", R.SERVICE_BOOKED), (3, "b", R.SERVICE_DAY), (3, "a", R.SERVICE_BOOKED)],
        "job_id long, booking_id string, kind string")
    before = jobs(spark, *docs)
    after = {r.id: json.loads(r.data_json)
             for r in S.mark_sent(before, sent, F.lit(RUN).cast("date")).collect()}
    mark = {"status": "sent", "sentAt": "03/08/2026"}
    assert after[1] == {"x": {"y": [1]}, "tabs": {
        "installation": {"emailReminders": {"week": mark}}, "survey": {"reminderSent": mark}}}
    assert after[2]["tabs"]["installation"]["emailReminders"] == {
        "day": {"status": "pending"}, "week": mark}
    assert after[3]["tabs"]["serviceCall"]["bookings"] == [
        {"id": "a", "k": 1, "emailSent": mark}, {"id": "b", "reminderSent": mark},
        {"id": "a", "emailSent": mark}]
    assert after[4] == {"untouched": 1}


# ---- matching --------------------------------------------------------------------------------

def test_identity(spark):
    people = M.customer_keys(customers(
        spark, {"email": "", "phone": "1"}, {"email": "A@x ", "phone": "2"}, {"email": "a@X", "phone": "1"},
        {"email": " ", "phone": " "}))
    events = spark.createDataFrame(
        [(1, "1:a@x", "1:1"), (2, "1:z@x", "1:1"), (3, None, None), (4, None, "1:2"),
         (5, "1:z@x", "1:9"), (6, "2:a@x", "2:1")],
        "seq long, email_key string, phone_key string")
    got = {r.seq: (r.matched_customer, r.matched_by)
           for r in M.identity_match(events, people).collect()}
    assert got == {1: (2, "email"), 2: (1, "phone"), 3: (None, None), 4: (2, "phone"), 5: (None, None),
                   6: (None, None)}


def test_link_order(spark):
    job = jobs(spark, {LINK.ref: "r-1", LINK.modified: "5"})
    people = customers(spark, {LINK.ref: "R-1"}, {LINK.ref: "R-2", LINK.modified: "5"})
    events = spark.createDataFrame(
        [(1, "R-1", "1:r-1", "6"), (2, "R-1", "1:r-1", "5"), (3, "R-1", "1:r-1", ""),
         (4, "R-2", "1:r-2", "4"), (5, "R-3", "1:r-3", "1"), (6, "", None, "1"), (7, "R-1", "2:r-1", "6")],
        "seq long, reference string, ref_key string, modified string",
    ).withColumn("email_key", F.lit(None).cast("string")).withColumn(
        "phone_key", F.lit(None).cast("string"))
    got = {r.seq: (r.action, r.job_id, r.customer_id)
           for r in M.classify_event(events, M.job_keys(job), M.customer_keys(people)).collect()}
    assert got == {
        1: ("updated-job", 1, None), 2: ("skipped-stale", 1, None), 3: ("updated-job", 1, None),
        4: ("skipped-stale", None, 2), 5: ("created-customer", None, None), 6: ("skipped", None, None),
        7: ("created-customer", None, None)}


# ---- writes ----------------------------------------------------------------------------------

def test_insert_into_empty_table(spark):
    empty = spark.createDataFrame([], schemas.CUSTOMERS)
    new = spark.createDataFrame([(7, 1, '{"name":"B"}'), (3, 1, '{"stage":"S","name":""}')],
                                "position long, tenant_id long, data_json string")
    snapshot, inserted = S.insert_entities(
        empty, new, "customer", "position", F.lit("2026-01-01").cast("timestamp"))
    assert sorted((r.id, r.name, r.stage) for r in snapshot.collect()) == [
        (1, "", "S"), (2, "B", "New Enquiry")]
    assert inserted.count() == 2


def test_delete_customers(spark):
    people = customers(spark, {}, {}, {})
    asked = spark.createDataFrame([(1, 1), (2, 1), (9, 1)], "id long, tenant_id long")
    left, blocked = S.delete_customers_restrict(people, jobs(spark, {}, customer_id=1), asked)
    assert sorted(r.id for r in left.collect()) == [1, 3]
    assert [r.id for r in blocked.collect()] == [1]


def test_delete_requests_of_other_tenants(spark):
    people = customers(spark, {}, {})
    asked = spark.createDataFrame([(1, 9), (2, 9)], "id long, tenant_id long")
    left, blocked = S.delete_customers_restrict(people, jobs(spark, {}, customer_id=1), asked)
    assert left.count() == 2 and blocked.isEmpty()


def test_patch_refreshes_columns(spark):
    people = customers(spark, {"name": "a", "k": 1}, {"name": "b"}, {"name": "c"})
    patches = spark.createDataFrame([(1, "new"), (2, "")], "id long, name string")
    now = F.lit("2026-05-05").cast("timestamp")
    got = {r.id: (r.name, json.loads(r.data_json), str(r.updated_at)[:10])
           for r in S.sparse_patch(people, patches, "id", ["name"], now).collect()}
    assert got == {
        1: ("new", {"name": "new", "k": 1}, "2026-05-05"),
        2: ("column name", {"name": "b"}, "2026-05-05"),
        3: ("column name", {"name": "c"}, "2026-01-01")}


def test_marks_touch_only_their_jobs(spark):
    before = jobs(spark, {"a": 1}, {"a": 2})
    sent = spark.createDataFrame([(1, None, "survey_day")], "job_id long, booking_id string, kind string")
    after = {r.id: r for r in S.mark_sent(
        before, sent, F.lit(RUN).cast("date"), F.lit("2026-05-05").cast("timestamp")).collect()}
    assert [str(after[i].updated_at)[:10] for i in (1, 2)] == ["2026-05-05", "2026-01-01"]
    assert after[2] == before.filter("id = 2").first()


def test_results_are_not_mixed(spark):
    box = spark.createDataFrame([(1, None, "k", False)],
                                "job_id long, booking_id string, kind string, is_test boolean")
    results = spark.createDataFrame(
        [(1, None, "k", "Failed", "bounced", 2), (1, None, "k", "Throttled", None, 1)],
        "job_id long, booking_id string, kind string, status string, error string, at int")
    pairs = [O.reconcile_send_results(box, results, at)[1].first() for at in (None, "at")]
    assert [(r.status, r.error) for r in pairs] == [("Throttled", None), ("Failed", "bounced")]


def test_calendar_goes_by_time(spark):
    def visit(date, start):
        return tabs(installation={"date": date, "fitters": ["F"], "startTime": start})

    got = REP.booking_calendar(
        jobs(spark, visit("2026-08-03", "10:30"), visit("2026-08-03T00:00:00", "9:30"),
             visit("2026-08-03", "09:00"), visit("2026-08-03", "")), customers(spark, {})).collect()
    assert sorted((r.seq_in_day, r.start) for r in got) == [
        (1, ""), (2, "09:00"), (3, "9:30"), (4, "10:30")]


def test_clock_texts(spark):
    """Numbers are read from texts that begin with a time only, and no other text is cast."""
    rows = {"": None, None: None, "9:30": (9, 30), "09:05": (9, 5), "10:30 am": (10, 30), "7:451": (7, 45), "99:99": (99, 99),
            "a:30": None, "1:3": None, ":30": None, "100:30": None, " 9:30": None, "-1:30": None, "9:30:15": (9, 30), "12": None}
    df = spark.createDataFrame([(t,) for t in rows], "t string").select(
        "t", DT.start_hour(F.col("t")).alias("hour"), DT.day_minute(F.col("t")).alias("minute"))
    assert {r.t: (r.hour, r.minute) for r in df.collect()} == {
        t: (v[0], v[0] * 60 + v[1]) if v else (None, -1) for t, v in rows.items()}
    assert "regexp_extract" not in df._jdf.queryExecution().toString()


def test_calendar_reads_what_it_shows(spark):
    """Only the shown fields are read, once, and a visit that is not whole is left out."""
    people = jobs(
        spark,
        tabs(survey={"date": "2026-08-03", "fitter": "A", "notes": {"a": 1}, "notifyEnabled": "yes", "emailSent": 3},
             installation={"date": "2026-08-04", "fitters": ["B", "", None], "startTime": None, "deliveries": "none"},
             serviceCall={"bookings": [{"id": "b0", "date": "2026-08-05", "fitter": "C"}, None, {"id": "b1", "date": "", "fitter": "C"},
                                       {"id": "b2", "date": "2026-08-05", "fitter": ""}, {"id": "b3", "date": "soon", "fitter": "C"}]}),
        tabs(survey={"date": "2026-08-03", "fitter": ""}, installation={"date": "", "fitters": ["B"]}, serviceCall={"bookings": None}),
        tabs(survey={"date": "soon", "fitter": "A"}, installation={"date": "2026-08-04", "fitters": []}), {}, {"tabs": None})
    entries = REP.calendar_entries(people)
    got = sorted((r.job_id, r.kind, r.pos, r.fitter, r.event_date, r.start, r.booking_id) for r in entries.collect())
    assert [(k, *x) for _, k, *x in got] == [
        ("installation", 0, "B", "2026-08-04", "", None), ("installation", 1, "", "2026-08-04", "", None),
        ("installation", 2, None, "2026-08-04", "", None), ("service call", 0, "C", "2026-08-05", "", "b0"),
        ("survey", 0, "A", "2026-08-03", "", None)]
    plan = entries._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1 and "notifyEnabled" not in plan and "deliveries" not in plan
    assert plan.count("transform(") == 2
