"""Documents are made and rewritten once, by code that is compiled and by all cores."""

from pyspark.sql import functions as F

from tradebook.functions.documents import with_marked_paths, with_path
from tradebook.operators import outbox as O, snapshots as W
from tradebook.operators.once import once
from tradebook.plans import standins as S
from tradebook.schemas import JOBS


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_generator_holds_no_lambda(spark):
    df = once(spark.range(3), {"a": F.transform(F.array("id"), lambda x: x + 1)})
    generators = [line for line in plan(df).splitlines() if "Generate" in line]
    assert generators and not any("lambda" in line for line in generators)
    assert [(r.id, r.a) for r in df.orderBy("id").collect()] == [(0, [1]), (1, [2]), (2, [3])]
    assert df.columns == ["id", "a"]


def test_documents_are_made_by_all_cores(spark, sf_dir):
    cores = spark.sparkContext.defaultParallelism
    for df in (S.jobs(spark, sf_dir), S.customers(spark, sf_dir), S.deliveries(spark, sf_dir)):
        assert df.rdd.getNumPartitions() >= cores


def test_marked_paths_equal_the_paths_one_by_one(spark):
    texts = [None, "1", "[]", "{}", '{"a":1}', '{"a":{"b":{"x":1},"z":2},"k":null}', '{"a":{"b":5,"c":[1]},"d":{"e":1}}']
    paths = [["a", "b", "x"], ["a", "b", "y"], ["a", "c"], ["d"]]
    rows = [(t, *[bool(n >> i & 1) for i in range(4)]) for t in texts for n in range(1, 16)]
    df = spark.createDataFrame(rows, "t string, f0 boolean, f1 boolean, f2 boolean, f3 boolean")
    value = F.lit("new").cast("variant")
    one_by_one = F.try_parse_json("t")
    for i, path in enumerate(paths):
        df = df.withColumn(f"_d{i}", F.when(F.col(f"f{i}"), with_path(one_by_one, path, value)).otherwise(one_by_one))
        one_by_one = F.col(f"_d{i}")
    changes = [(path, F.col(f"f{i}"), value) for i, path in enumerate(paths)]
    both = df.select(F.to_json(one_by_one).alias("was"), F.to_json(with_marked_paths(F.try_parse_json("t"), changes)).alias("now"))
    assert all(r.was == r.now for r in both.collect())


def test_marking_moves_the_jobs_once(spark):
    jobs = spark.createDataFrame([(n, 1, 1, "", "", "{}", None, None) for n in (1, 1, None, 2)], JOBS)
    sent = spark.createDataFrame([(1, None, "install_day"), (1, None, "install_day")], "job_id long, booking_id string, kind string")
    after = W.mark_sent(jobs, sent, F.lit("1999-06-24").cast("date"), F.lit("2024-02-01").cast("timestamp"))
    assert plan(after).count("Join ") == 1
    rows = after.collect()
    assert sorted((r.id or 0, "sent" in r.data_json, r.updated_at is not None) for r in rows) == [
        (0, False, False), (1, True, True), (1, True, True), (2, False, False)]


def test_only_results_of_live_messages_are_compared(spark):
    outbox = spark.createDataFrame([(1, None, "install_day", False)], "job_id long, booking_id string, kind string, is_test boolean")
    results = spark.createDataFrame(
        [(1, None, "install_day", "Failed", "x"), (1, None, "install_day", "Succeeded", None), (2, None, "install_day", "Failed", "y")],
        "job_id long, booking_id string, kind string, status string, error string")
    sent, failed = O.reconcile_send_results(outbox, results)
    assert "LeftSemi" in plan(sent)
    assert [tuple(r) for r in sent.collect()] == [(1, None, "install_day")] and failed.isEmpty()
