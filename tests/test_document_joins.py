"""Tables of documents, which take far more room than the planner expects, are not broadcast by its estimate."""

import json

import pytest
from pyspark.sql import functions as F

from tradebook.operators import bookings as B
from tradebook.operators import outbox as O
from tradebook.operators import snapshots as W
from tradebook.operators.joins import document_join
from tradebook.plans import daily

ROWS = 3000
LIMIT = "spark.sql.maxBroadcastTableSize"


@pytest.fixture
def narrow(spark):
    """No side of more than 48 MB can be broadcast; the documents below take some 60 MB a table."""
    old = spark.conf.get(LIMIT)
    spark.conf.set(LIMIT, "48m")
    yield spark
    spark.conf.set(LIMIT, old)


def documents(spark, folder, name, doc):
    """`ROWS` jobs of that document, with notes of 20 KB that a file stores in much less."""
    text = json.dumps(doc)[:-1] + ', "notes": "'
    rows = spark.range(ROWS).select(
        "id", F.lit(1).cast("long").alias("tenant_id"), (F.col("id") % 7).alias("customer_id"),
        F.lit("column title").alias("title"), F.lit("").alias("status"),
        F.concat(F.lit(text), F.expr("repeat(md5(cast(id as string)), 640)"), F.lit('"}')).alias("data_json"),
        F.lit("2026-01-01").cast("timestamp").alias("created_at"), F.lit("2026-01-01").cast("timestamp").alias("updated_at"),
    )
    rows.coalesce(1).write.parquet(f"{folder}/{name}")
    return spark.read.parquet(f"{folder}/{name}")


EMPTY = {"tabs": {"survey": {"date": "d"}, "installation": {"date": "d", "fitters": []},
                  "serviceCall": {"bookings": [{"id": "a", "date": "", "fitter": "f"}]}}}
BOOKED = {"tabs": {"survey": {"date": "d", "fitter": "f"}, "installation": {"date": "d", "fitters": ["f", "g"]},
                   "serviceCall": {"bookings": [{"id": "a", "date": "e", "fitter": "h"}]}}}


@pytest.fixture(scope="module")
def versions(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("jobs")
    return documents(spark, folder, "before", EMPTY), documents(spark, folder, "after", BOOKED)


def found(messages):
    return {tuple(r) for r in messages.groupBy("kind", "booking_id", "message_date", "message_fitters").count().collect()}


SURVEY = ("survey_booked", None, "d", "f", ROWS)
INSTALL = ("install_booked", None, "d", "f, g", ROWS)
SERVICE = ("service_booked", "a", "e", "h", ROWS)


def test_installations(narrow, versions):
    assert found(B.booking_transitions(*versions, (B.INSTALL_BOOKED,))) == {INSTALL}


def test_earlier_bookings(narrow, versions):
    shown = B.booking_before_after(*versions).drop("job_id")
    assert [tuple(r) for r in shown.groupBy(*shown.columns).count().collect()] == [
        ("a", 0, "e", "h", True, "", "f", ROWS)]


def test_all_kinds(narrow, versions):
    assert found(B.booking_transitions(*versions)) == {SURVEY, INSTALL, SERVICE}


def test_service_visits(narrow, versions):
    assert found(B.booking_transitions(*versions, (B.SERVICE_BOOKED,))) == {SERVICE}


def test_surveys(narrow, versions):
    assert found(B.booking_transitions(*versions, (B.SURVEY_BOOKED,))) == {SURVEY}


# ---- saving of jobs ---------------------------------------------------------------------------

def now():
    return F.lit("2026-02-01").cast("timestamp")


@pytest.fixture(scope="module")
def customers(spark, tmp_path_factory):
    doc = {"name": "Ann", "email": "ann@mail.test", "address": "1 Test Road"}
    table = documents(spark, tmp_path_factory.mktemp("customers"), "table", doc).drop("customer_id")
    return table.withColumnsRenamed({"title": "name", "status": "stage"})


@pytest.fixture(scope="module")
def settings(spark):
    return spark.createDataFrame([(1, "{}")], "tenant_id long, data_json string")


def test_saved_jobs(narrow, versions, customers, settings):
    before, after = versions
    changes = after.select("id", "tenant_id", "customer_id", "data_json")
    _, _, outbox, rejects = daily.save_jobs(narrow, before, customers, settings, changes, now())
    assert sorted((r["kind"], r["to"], r["count"]) for r in outbox.groupBy("kind", "to").count().collect()) == [
        (kind, ["ann@mail.test"], ROWS) for kind in ("install_booked", "service_booked", "survey_booked")]
    assert rejects.isEmpty()


def test_replaced_documents(narrow, versions):
    before, after = versions
    changes = after.filter("id % 10 > 0").select("id", "tenant_id", "data_json")
    saved, _ = W.replace_entities(before, changes, "job", now())
    booked = F.get_json_object("data_json", "$.tabs.survey.fitter") == "f"
    assert sorted((r[0], r[1], r[2]) for r in saved.groupBy(
        booked.isNotNull().alias("new"), (F.col("updated_at") == now()).alias("updated")).count().collect()) == [
            (False, False, ROWS // 10), (True, True, ROWS // 10 * 9)]


def test_customers_of_few_messages(narrow, customers, settings):
    due = narrow.createDataFrame(
        [(1, None, "survey_booked", 5, "2026-08-03", "f"), (2, None, "survey_booked", ROWS, "2026-08-03", "f"),
         (3, None, "survey_booked", None, "2026-08-03", "f")],
        "job_id long, booking_id string, kind string, customer_id long, message_date string, message_fitters string")
    outbox, rejects = O.build_outbox(due, customers, settings, O.default_templates(narrow))
    assert [(r.job_id, r.to, r.subject) for r in outbox.collect()] == [
        (1, ["ann@mail.test"], "Survey date confirmed for Ann")]
    assert sorted((r.job_id, r.reason) for r in rejects.collect()) == [
        (2, "customer not found"), (3, "customer not found")]


def test_few_changes_are_still_broadcast(narrow, versions, tmp_path):
    """A small change set spares the large table its shuffle."""
    before, after = versions
    after.filter("id < 5").select("id", "tenant_id", "data_json").write.parquet(f"{tmp_path}/few")
    few = narrow.read.parquet(f"{tmp_path}/few")
    joined = document_join(before.drop("data_json"), few, ["id", "tenant_id"], "left")
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.filter("data_json is not null").count() == 5
