"""Batch replay against a plain one-by-one simulation on small random tables."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tradebook import schemas
from tradebook.operators import replay as RP
from tradebook.operators.deliveries import capture_raw_event, project_events
from tradebook.operators.matching import classify_event, customer_keys, job_keys
from tradebook.schemas import LINK

NOW = "2024-02-01 00:00:00"
EVENT = (
    "seq long, reference string, name string, email string, phone string, address string, "
    "quote_value string, installation_value string, ext_status string, modified string"
)
DEAL = {"quote_value": "quoteValue", "installation_value": "installationValue",
        "ext_status": LINK.status, "modified": LINK.modified}


def norm(text):
    return (text or "").strip().lower()


def simulate(events, jobs, customers):
    """The tables after applying the events one by one, and what each event did."""
    jobs = {j["id"]: dict(j) for j in jobs}
    customers = {c["id"]: dict(c) for c in customers}
    log = []

    def lookup(table, field, key):
        for id_ in sorted(table):
            if key and norm(table[id_].get(field)) == key:
                return id_
        return None

    def patch(record, event, fields):
        for source, target in fields.items():
            if event[source]:
                record[target] = event[source]

    person = {f: f for f in ("name", "email", "phone", "address")}
    for e in events:
        ref = norm(e["reference"])
        if not ref:
            log.append((e["seq"], "skipped", None, None))
            continue
        job = lookup(jobs, LINK.ref, ref)
        holder = None if job is not None else lookup(customers, LINK.ref, ref)
        if job is not None or holder is not None:
            record = jobs[job] if job is not None else customers[holder]
            known = record.get(LINK.modified)
            if e["modified"] and known and e["modified"] <= known:
                log.append((e["seq"], "skipped-stale", job, holder))
                continue
            patch(record, e, DEAL)
            if job is not None:
                if record["customerId"] in customers:
                    patch(customers[record["customerId"]], e, person)
                log.append((e["seq"], "updated-job", job, None))
            else:
                patch(record, e, person)
                log.append((e["seq"], "updated-customer", None, holder))
            continue
        found = lookup(customers, "email", norm(e["email"]))
        if found is None:
            found = lookup(customers, "phone", norm(e["phone"]))
        deal = {target: e[source] for source, target in DEAL.items()}
        if found is not None:
            new = max(jobs, default=0) + 1
            title = customers[found]["name"] or e["name"] or e["reference"]
            jobs[new] = {"id": new, "customerId": found, "title": title,
                         LINK.ref: e["reference"], **deal}
            log.append((e["seq"], "created-job", new, found))
        else:
            new = max(customers, default=0) + 1
            customers[new] = {
                "id": new, "name": e["name"] or e["reference"], "email": e["email"],
                "phone": e["phone"], "address": e["address"], LINK.ref: e["reference"],
                "stage": "Quoted" if e["quote_value"] else "New Enquiry", **deal,
            }
            log.append((e["seq"], "created-customer", None, new))
    return log, jobs, customers


def draw(seed, n_events, n_refs, n_people):
    r = random.Random(seed)

    def maybe(text, share=0.7):
        return text if r.random() < share else ""

    def email():
        return maybe(r.choice(["a", "A ", "b", "c", "d", "e"][:n_people]) )

    def phone():
        return maybe(str(r.randrange(n_people)), 0.5)

    customers = [
        {"id": i, "name": maybe(f"N{i}"), "stage": "Quoted", "email": email(), "phone": phone(),
         LINK.ref: maybe(f"r{r.randrange(n_refs)}", 0.3), LINK.modified: maybe(str(r.randrange(9)), 0.5)}
        for i in range(1, 5)
    ]
    jobs = [
        {"id": i, "customerId": r.choice([1, 2, 3, 99]), "title": f"J{i}",
         LINK.ref: maybe(f"R{r.randrange(n_refs)} ", 0.5), LINK.modified: maybe(str(r.randrange(9)), 0.5)}
        for i in range(1, 4)
    ]
    events = [
        {"seq": i * r.choice([1, 1]) , "reference": maybe(r.choice("rR") + str(r.randrange(n_refs)), 0.95),
         "name": maybe(f"P{i}"), "email": email().strip(), "phone": phone(), "address": maybe(f"A{i}"),
         "quote_value": maybe(str(i)), "installation_value": maybe(str(i * 2), 0.3),
         "ext_status": maybe(f"S{i}"), "modified": maybe(str(r.randrange(9)))}
        for i in range(n_events)
    ]
    return events, jobs, customers


def frames(spark, events, jobs, customers):
    from tradebook.functions.text import tenant_key

    ev = spark.createDataFrame([tuple(e.values()) for e in events], EVENT).withColumn(
        "tenant_id", F.lit(1).cast("long"))
    for key, field in (("ref_key", "reference"), ("email_key", "email"), ("phone_key", "phone")):
        ev = ev.withColumn(key, tenant_key(F.col("tenant_id"), F.col(field)))
    at = F.lit("2020-01-01 00:00:00").cast("timestamp")
    j = spark.createDataFrame(
        [(x["id"], 1, x["customerId"], x["title"], "Book Survey",
          json.dumps({LINK.ref: x[LINK.ref], LINK.modified: x[LINK.modified], "other": [1]}))
         for x in jobs],
        "id long, tenant_id long, customer_id long, title string, status string, data_json string",
    ).withColumn("created_at", at).withColumn("updated_at", at)
    c = spark.createDataFrame(
        [(x["id"], 1, x["name"], x["stage"],
          json.dumps({k: x[k] for k in ("email", "phone", LINK.ref, LINK.modified)}
                     | {"name": "old", "other": {"a": 1}}))
         for x in customers],
        "id long, tenant_id long, name string, stage string, data_json string",
    ).withColumn("created_at", at).withColumn("updated_at", at)
    return ev, j, c


@pytest.mark.parametrize("seed,n_events,n_refs,n_people", [
    (1, 40, 6, 3), (2, 60, 30, 4), (3, 80, 60, 6), (4, 50, 50, 2), (5, 120, 40, 5), (6, 1, 1, 1),
    (7, 90, 80, 5), (8, 70, 70, 3),
])
def test_replay_equals_one_by_one(spark, seed, n_events, n_refs, n_people):
    events, jobs, customers = draw(seed, n_events, n_refs, n_people)
    log, jobs_after, customers_after = simulate(events, jobs, customers)
    ev, j, c = frames(spark, events, jobs, customers)
    out = RP.replay(ev, j, c, F.lit(NOW).cast("timestamp"), bits=3)

    got = sorted((r.seq, r.action, r.job_id, r.customer_id) for r in out.actions.collect())
    assert got == sorted(log)

    for table, changed, expected, columns in (
        (j, out.jobs, jobs_after, {"title": "title", "customer_id": "customerId"}),
        (c, out.customers, customers_after, {"name": "name", "stage": "stage"}),
    ):
        rows = {r.id: r for r in RP.merged(table, changed).collect()}
        assert set(rows) == set(expected)
        for id_, want in expected.items():
            doc = json.loads(rows[id_].data_json)
            for column, field in columns.items():
                assert (rows[id_][column] or "") == (want[field] or "")
            for field, value in want.items():
                if field not in ("id", "customerId", "title", "name", "stage"):
                    assert (doc.get(field) or "") == (value or ""), (id_, field)
            if id_ <= 4 and "other" in json.loads(rows[id_].data_json):
                assert doc["other"] in ([1], {"a": 1})


def test_duplicate_delivery_is_stale(spark):
    body = json.dumps({"json": {
        "infoProperties": [{"name": "Reference", "value": "R-1"}], "price": 10,
        "modifiedDate": "2026-01-02"}})
    rows = spark.createDataFrame(
        [(i, 1, None, "text/plain", body) for i in range(3)], schemas.DELIVERIES)
    events = project_events(capture_raw_event(rows))
    empty_jobs = spark.createDataFrame([], schemas.JOBS)
    empty_customers = spark.createDataFrame([], schemas.CUSTOMERS)
    out = RP.replay(events, empty_jobs, empty_customers, F.lit(NOW).cast("timestamp"))
    assert [r.action for r in out.actions.orderBy("seq").collect()] == [
        "created-customer", "skipped-stale", "skipped-stale"]
    made = out.customers.first()
    assert (made.id, made.name, made.stage) == (1, "R-1", "Quoted")
    assert json.loads(made.data_json)["tabs"]["installation"]["emailReminders"]["week"] == {
        "status": "pending", "sentAt": ""}


def test_tenants_do_not_match(spark):
    """Two tenants share reference, e-mail and phone."""
    def body(reference):
        pairs = [("Reference", reference), ("Email", "x@t"), ("Phone", "1")]
        return json.dumps({"json": {"infoProperties": [{"name": n, "value": v} for n, v in pairs]}})

    _, jobs, customers = frames(
        spark, [], [{"id": 1, "customerId": 1, "title": "J", LINK.ref: "R-9", LINK.modified: ""}],
        [{"id": 1, "name": "A", "stage": "Quoted", "email": "x@t", "phone": "1", LINK.ref: "",
          LINK.modified: ""}])
    rows = spark.createDataFrame(
        [(0, 2, None, "", body("R-9")), (1, 1, None, "", body("R-9")), (2, 2, None, "", body("R-10")),
         (3, 1, None, "", body("R-10"))], schemas.DELIVERIES)
    events = project_events(capture_raw_event(rows))
    each = classify_event(events, job_keys(jobs), customer_keys(customers)).collect()
    assert sorted((r.seq, r.action, r.customer_id) for r in each) == [
        (0, "created-customer", None), (1, "updated-job", None), (2, "created-customer", None),
        (3, "created-job", 1)]
    out = RP.replay(events, jobs, customers, F.lit(NOW).cast("timestamp"))
    assert sorted((r.seq, r.action, r.job_id, r.customer_id) for r in out.actions.collect()) == [
        (0, "created-customer", None, 2), (1, "updated-job", 1, None), (2, "created-job", 2, 2),
        (3, "created-job", 3, 1)]
    assert sorted((r.id, r.tenant_id, r.customer_id) for r in out.jobs.collect()) == [
        (1, 1, 1), (2, 2, 2), (3, 1, 1)]
    assert sorted((r.id, r.tenant_id) for r in out.customers.collect()) == [(1, 1), (2, 2)]


def test_a_chain_is_looked_up_where_it_changed(spark, monkeypatch):
    """Each reference is found by the e-mail that the one before it gave their customer.

    So each round settles one more of them, and looks up no reference that was settled before.
    """
    n, bystanders = 6, 40
    customers = [{"id": 1, "name": "A", "stage": "Quoted", "email": "m0", "phone": "", LINK.ref: "", LINK.modified: ""}]
    blank = {f: "" for f in ("name", "phone", "address", "quote_value", "installation_value", "ext_status", "modified")}
    events = []
    for k in range(n):
        events += [{"reference": f"r{k}", "email": f"m{k}"}, {"reference": f"r{k}", "email": f"m{k + 1}"}]
    events += [{"reference": f"b{k}", "email": f"own{k}"} for k in range(bystanders)]
    events = [{"seq": i, "reference": e["reference"], **blank, "email": e["email"]} for i, e in enumerate(events)]
    events = [{k: e[k] for k in ("seq", "reference", "name", "email", "phone", "address", "quote_value",
                                 "installation_value", "ext_status", "modified")} for e in events]
    log, *_ = simulate(events, [], customers)
    asked = []
    kept = RP._Rounds.add

    def add(self, df, number):
        out = kept(self, df, number)
        if self.label == "targets":
            asked.append(out.count())
        return out

    monkeypatch.setattr(RP._Rounds, "add", add)
    ev, j, c = frames(spark, events, [{"id": 1, "customerId": 1, "title": "J", LINK.ref: "", LINK.modified: ""}], customers)
    out = RP.replay(ev, j.limit(0), c, F.lit(NOW).cast("timestamp"))
    assert sorted((r.seq, r.action, r.job_id, r.customer_id) for r in out.actions.collect()) == sorted(log)
    assert [a for _, a, *_ in log[:2 * n]] == ["created-job", "updated-job"] * n
    assert asked[0] == n + bystanders and len(asked) == out.rounds > n - 1
    assert all(a <= n for a in asked[1:]) and asked[1:] == sorted(asked[1:], reverse=True)
