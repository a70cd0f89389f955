"""Queries that read a table several times over make its documents once."""

from datetime import datetime

import duckdb
import pytest

import __spark_entry__ as entry
from tradebook.operators.deliveries import extract_project_fields
from tradebook.plans import daily
from tradebook.plans.catalog import messages, streams

GIVEN = {
    "orders": "select i as o_orderkey, i % 4 as o_custkey, case i % 3 when 0 then 'F' when 1 then 'O' else 'P' end as o_orderstatus, "
              "60000.0 + i as o_totalprice, timestamp '1999-05-01' + interval (i) day as o_orderdate, "
              "case i % 2 when 0 then '1-URGENT' else '3-MEDIUM' end as o_orderpriority from range(12) t(i)",
    "customer": "select i as c_custkey, i % 3 as c_nationkey, 'Customer ' || i as c_name, 4500.0 + i as c_acctbal, "
                "case i % 2 when 0 then 'MACHINERY' else 'HOUSEHOLD' end as c_mktsegment from range(4) t(i)",
    "events": "select i as event_id, timestamp '2024-01-10' + interval (i) day as ts, i % 5 as user_id, "
              "case i % 3 when 0 then 'purchase' when 1 then 'click' else 'view' end as event_type, 20.0 + i as value, "
              "'{\"k\": ' || (i % 2) || '}' as props from range(20) t(i)",
    "nation": "select i as n_nationkey, 'N' || i as n_name, i as n_regionkey from range(3) t(i)",
}


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    folder = tmp_path_factory.mktemp("given")
    for name, sql in GIVEN.items():
        duckdb.connect().execute(f"copy ({sql.replace('i % 4 as', 'cast(i % 4 as bigint) as')}) to '{folder}/{name}.parquet'")
    return str(folder)


def given_files(df):
    return [f for f in df.inputFiles() if f.rsplit("/", 1)[-1].split(".")[0] in GIVEN]


@pytest.mark.parametrize("name", ["replay_deals", "stream_apply"])
def test_deals_come_from_stored_tables(spark, tables, name):
    result = entry.queries()[name](spark, tables)
    assert given_files(result) == []
    assert result.count()


def test_schedule_reads_stored_jobs(spark, tables, monkeypatch):
    seen, record = [], daily.record_schedule
    monkeypatch.setattr(daily, "record_schedule", lambda s, before, after, n: (seen.extend((before, after)), record(s, before, after, n)))
    entry.queries()["scheduled_reminder_run"](spark, tables).collect()
    assert seen and all(given_files(df) == [] for df in seen)


def test_staleness_finds_the_actions(spark, tables):
    assert streams.stream_staleness(spark, tables).count()


def test_property_lists_are_read_in_one_go(spark):
    """Names that are no text, and members that are no objects, count as they did one by one."""
    lists = ['[1,null,"x",{"name":"Reference","value":"R1"},{"name":"Reference"}]', '[{"name":"Reference","value":"R2"},[],{"value":"R3"}]',
             '[{"name":{"a":1},"value":1},{"name":"Name","value":null},{"name":7,"value":"y"},{"name":"Email","value":{"b":2}}]', "[]", "{}", "null"]
    rows = [(n, datetime(2024, 1, 1), True, '{"json":{"infoProperties":' + items + "}}") for n, items in enumerate(lists)]
    fields = extract_project_fields(spark.createDataFrame(rows, "seq long, received_at timestamp, is_json boolean, payload string"))
    got = {r["seq"]: (r["reference"], r["name"], r["email"], r["error"]) for r in fields.collect()}
    assert got == {0: ("", "", "", None), 1: ("R2", "", "", None), 2: ("", "", "", "Email is a object"), 3: ("", "", "", None)}
    assert "lambdafunction(try_variant_get" not in fields._jdf.queryExecution().toString()
