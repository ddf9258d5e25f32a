"""Batch studies, result tables on small cases, streams."""

import json
import threading
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from graphband.operators import documents, results
from graphband.plans import study
from graphband.sources import artifacts
from graphband.sources import study as figures
from graphband.streaming import logs


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_run_cases(spark, tmp_path):
    done = study.Study(spark, str(tmp_path / "a"))
    cases = [{"case_key": k} for k in ("g__a__s", "g__b__s", "g__c__s")]

    def execute(case):
        if "__b__" in case["case_key"]:
            raise ValueError("no such algorithm")
        return f"runs/{case['case_key']}"

    assert study.dry_run(cases) == ["g__a__s", "g__b__s", "g__c__s"]
    assert study.run_cases(done, cases, execute) == 1 and done.failed()
    assert [(r["case_id"], r["state"]) for r in done.states().orderBy("case_id").collect()] == [(0, "completed"), (1, "failed"), (2, "completed")]
    assert done.manifest().where("error_type = 'ValueError'").count() == 1
    first = study.Study(spark, str(tmp_path / "b"))
    assert study.run_cases(first, cases, execute, stop_on_error=True) == 1 and first.states().count() == 2


def test_sweep_cancels_defers_and_resumes(spark, tmp_path):
    """A running case is stopped by its tag and the next one goes on; a restart skips what is done, and its numbers go on."""
    started, order = threading.Event(), []
    slow = F.udf(lambda i: time.sleep(0.5) or i, "long")

    def execute(case):
        order.append(case["case_key"])
        if case["case_key"] == "slow" and case.get("wait", True):
            started.set()
            spark.range(400, numPartitions=4).select(slow("id")).write.format("noop").mode("overwrite").save()
        if case["case_key"] == "bad":
            raise ValueError("no")
        return f"runs/{case['case_key']}"

    cases = [{"case_key": k} for k in ("late", "slow", "a", "bad", "never")]
    sweep = study.Sweep(study.Study(spark, str(tmp_path / "s")), execute, 1, lambda case: case["case_key"] == "late")
    sweep.cancel("never")
    threading.Thread(target=lambda: started.wait(60) and time.sleep(1) is None and sweep.cancel("slow")).start()
    began = time.time()
    assert sweep.run(cases) == {"cancelled": 2, "completed": 2, "failed": 1}
    assert time.time() - began < 45 and order == ["slow", "a", "bad", "late"]
    again = study.Study(spark, str(tmp_path / "s"))
    order.clear()
    assert study.Sweep(again, execute, 2).run([c | {"wait": False} for c in cases]) == {"skipped": 2, "completed": 2, "failed": 1}
    assert sorted(order) == ["bad", "never", "slow"]
    numbers = [r["seq"] for r in again.manifest().select("seq").collect()]
    assert sorted(numbers) == list(range(len(numbers)))
    assert {r["case_key"]: r["state"] for r in again.by_key().collect()} == {"late": "completed", "slow": "completed", "a": "completed", "bad": "failed", "never": "completed"}


def test_fallback_prefers_the_closest(spark):
    wanted = spark.createDataFrame([("g1", "a", "s"), ("g1", "b", "s"), ("g1", "c", "m"), ("g9", "a", "s")], "geometry string, algorithm string, size string")
    known = spark.createDataFrame([("g1", "a", "s", 5), ("g1", "b", "m", 3), ("g2", "c", "m", 1)], "geometry string, algorithm string, size string, run_id long")
    assert [r[3:] for r in rows(results.with_fallback(wanted, known))] == [(5, "exact"), (3, "algorithm"), (3, "geometry"), (1, "any")]


def test_summary_columns_and_strict_curves(spark):
    metrics = spark.createDataFrame([(1, "K", v, f"frac_within_{b}%", x) for v, b, x in (("original", "0.1", 0.1), ("permuted", "0.1", 0.5), ("original", "1.0", 0.4), ("permuted", "1.0", 0.8), ("original", "0.7", 0.3))], "run_id long, matrix string, variant string, metric string, value double")
    cases = spark.createDataFrame([("run_1", 1, "k"), (None, 2, "x")], "result_dir string, run_id long, case_key string")
    out = {r["case_key"]: r for r in results.batch_summary(cases, metrics, ("0.1", "0.7", "1.0")).collect()}
    assert (out["k"]["K_frac_0_1pct_original"], out["k"]["K_frac_1_0pct_permuted"], out["x"]["K_frac_0_1pct_original"]) == (0.1, 0.8, None)
    assert "K_frac_within_200_original" not in out["k"].asDict()
    assert [r["percent"] for r in results.curve_series(metrics, strict=True).orderBy("percent").collect()] == [0.1, 1.0]
    assert [r["permuted"] for r in results.curve_series(metrics).orderBy("percent").collect()] == [0.5, 0.0, 0.8]


def test_case_row_and_usage(spark):
    cases = spark.createDataFrame([("a__b__c",)], "case_key string")
    assert results.case_row(cases, "a__b__c").count() == 1
    with pytest.raises(ValueError, match="a__b__c"):
        results.case_row(cases, "x")
    jobs = spark.createDataFrame([(1, 10, 25, [("QA", 4, 2), ("qb", 1, 1)]), (2, 10, 5, [("QA", 2, 1)]), (3, 0, 7, None)], "job long, started long, ended long, resources array<struct<unit: string, qubits: long, runs: long>>")
    assert [tuple(r) for r in results.usage_of_resources(jobs).collect()] == [("QA", 2, 6, 3, 15), ("qb", 1, 1, 1, 15), ("unknown", 1, 0, 0, 7)]
    assert [tuple(r) for r in results.usage_of_resources(jobs, "QB").collect()] == [("QA", 1, 4, 2, 15), ("qb", 1, 1, 1, 15)]


def test_thinned_keeps_the_last(spark):
    points = spark.range(11).selectExpr("0 AS run", "id")
    assert rows(results.thinned(points, ["run"], "id", 4)) == [(0, i) for i in (0, 2, 4, 6, 8, 10)]
    assert rows(results.thinned(points, ["run"], "id", 3)) == [(0, i) for i in (0, 3, 6, 9, 10)]


def test_push_goes_on_where_it_stopped(spark, tmp_path):
    (tmp_path / "in").mkdir()
    sent = []

    def write(name, seq, text):
        line = logs.line("INFO", text, "01 Jan 2026 00:00:00 UTC")
        (tmp_path / "in" / name).write_text(json.dumps({"job_id": 1, "seq": seq, "value": line}) + "\n")

    for name, seq, text in (("a.json", 1, "Graph G_K with 7 nodes and 9 edges"), ("b.json", 2, "Partitioning on coarse graph produced 4 parts")):
        write(name, seq, text)
        q = logs.push(spark, str(tmp_path / "in"), str(tmp_path / "offsets"), lambda n, t: sent.extend(r.asDict() for r in t.collect()))
        q.processAllAvailable()
        q.stop()
    assert [(r["initial_nodes"], r["coarse_parts"]) for r in sent] == [(7, None), (None, 4)]


def test_progress_and_tail(spark):
    lines = [(1, i, logs.line("INFO", t, f"01 Jan 2026 00:00:0{i} UTC")) for i, t in enumerate(("Converting matrices to graphs", "Coarse graph has", "x", "Permuting matrices"))]
    parsed = logs.parse(spark.createDataFrame(lines, "job_id long, seq long, value string"))
    assert rows(logs.progress(parsed)) == [(1, "permutation", 90)]
    assert rows(logs.tail(parsed, 2, 10)) == [(1, "g matrices")]


def test_catalog_and_new_folders(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "k.mtx").write_text("%%MatrixMarket matrix coordinate real general\n3 4 1\n1 1 2.0\n")
    (tmp_path / "bad.mtx").write_text("%%MatrixMarket matrix coordinate real general\nx y\n")
    found = {r["path"].rsplit("/", 1)[1]: r for r in artifacts.catalog(spark, str(tmp_path)).collect()}
    assert (found["k.mtx"]["rows"], found["k.mtx"]["cols"], found["k.mtx"]["nnz"], found["k.mtx"]["error"]) == (3, 4, 1, None)
    assert found["bad.mtx"]["rows"] is None and "size line" in found["bad.mtx"]["error"]
    at = datetime(2026, 5, 21, 15, 19, 3, 42)
    names = [artifacts.new_folder(spark, str(tmp_path), "run", at).rsplit("/", 1)[1] for _ in range(3)]
    assert names == ["run_20260521_151903_000042", "run_20260521_151903_000042_01", "run_20260521_151903_000042_02"]
    assert artifacts.new_folder(spark, str(tmp_path), "batch", at).endswith("/batch_20260521_151903")


def test_strict_curves(spark):
    row = lambda p, v, x: (1, "K", v, f"frac_within_{p}%", x)
    both = [row(p, v, 0.5) for p in ("0.1", "1.0") for v in ("original", "permuted")]
    frame = lambda rows: spark.createDataFrame(rows, "run_id long, matrix string, variant string, metric string, value double")
    assert results.strict_curves(frame(both)).count() == 2
    for bad in (both[:-1], [*both[:-1], row("1.0", "permuted", None)], []):
        with pytest.raises(ValueError, match="no"):
            results.strict_curves(frame(bad))


def test_documents_of_any_shape(spark):
    texts = [(1, '{"a": {"b": [1, {"c": null}, []], "d": "x.y"}, "e": true}'), (2, "[1.5, [2]]"), (3, "7"), (4, "not json"), (5, None), (6, "{}")]
    found = rows(documents.leaves(spark.createDataFrame(texts, "doc long, json string")))
    assert found == [(1, "$.a.b[0]", "1"), (1, "$.a.b[1].c", None), (1, "$.a.d", "x.y"), (1, "$.e", "true"), (2, "$[0]", "1.5"), (2, "$[1][0]", "2"), (3, "$", "7"), (4, "$", "not json")]
    a, b = (spark.createDataFrame(x, "doc long, path string, value string") for x in ([(1, "$.a", "1"), (1, "$.b", None), (1, "$.c", None)], [(1, "$.a", "2"), (1, "$.b", None), (1, "$.d", None)]))
    assert rows(documents.differences(a, b)) == [(1, "$.a", "1", "2", "changed"), (1, "$.c", None, None, "removed"), (1, "$.d", None, None, "added")]


def test_job_states_parse_lines_once(spark, monkeypatch):
    from graphband import session
    from graphband.sources import study
    from graphband.streaming import logs

    written = []
    monkeypatch.setattr(logs, "materialise", lambda df: written.append(df.columns) or session.materialise(df))
    out = logs.job_states(logs.parse(study.ended_lines(spark, "/root/testdata/sf0.001")))
    assert len(written) == 1 and "rlike" not in out._jdf.queryExecution().analyzed().toString().lower()


def test_turns_in_many_files_give_the_same_states(spark, monkeypatch):
    from graphband import queries_study

    monkeypatch.setattr(queries_study, "TURN", 50)
    one, two = (q(spark, "/root/testdata/sf0.001") for q in (queries_study.job_states, queries_study.job_states_streamed))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_curves_of_shown_runs_alone(spark):
    """Figures of runs that are not shown are dropped before curves are grouped; the rows are the same."""
    case = lambda run, algorithm: ("g", "small", algorithm, run, "completed", f"run_{run}")
    cases = spark.createDataFrame([case(1, "high"), case(2, "high"), case(3, "low"), case(4, "low")], "geometry string, size string, algorithm string, run_id long, status string, result_dir string")
    rows = [(run, "K", v, "frac_within_0.1%", run + x) for run in range(1, 200) for v, x in (("original", 0.25), ("permuted", 0.5))]
    metrics = spark.createDataFrame(rows, "run_id long, matrix string, variant string, metric string, value double")
    out = results.overlay(cases, metrics, "high", "low")
    assert [tuple(r) for r in out.collect()] == [("g", "small", 0.1, 1.5, 3.5)]
    curves = results.analysis_curves(cases, metrics, ("high", "low"))
    assert sorted(tuple(r) for r in curves.collect()) == [("g", "K", "small", 0.0, 0.0, 0.0, 0.0), ("g", "K", "small", 0.1, 1.25, 1.5, 3.5)]
    for frame in (out, curves):
        assert "LeftSemi" in frame._jdf.queryExecution().optimizedPlan().toString()


def test_lines_and_documents_are_dealt_by_their_number(spark, tmp_path, monkeypatch):
    """However small their files are: a task has a bounded number of lines to sum up and of documents to parse."""
    spark.sql("SELECT id AS l_orderkey, 'O' AS l_linestatus, 1.0D AS l_quantity, 0.01D AS l_tax FROM range(90)").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(figures, "LINES", 10)
    assert figures.metrics(spark, str(tmp_path)).select(F.spark_partition_id().alias("p")).distinct().count() > 5
    made, one = [], documents.materialise
    monkeypatch.setattr(documents, "DOCS", 10)
    monkeypatch.setattr(documents, "materialise", lambda x: made.append(x.select(F.spark_partition_id().alias("p")).distinct().count()) or one(x))
    docs = spark.range(90).coalesce(1).select(F.col("id").alias("doc"), F.lit('{"a":1}').alias("json"))
    assert documents.leaves(docs).count() == 90 and made[0] > 5
