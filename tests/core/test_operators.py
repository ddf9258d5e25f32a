"""Hand-checked cases: a small matrix, two triangles with a bridge, logs."""

import time

import pytest

from graphband.operators import graph, metrics, partition
from graphband.sources import mtx, mtx_source
from graphband.streaming import logs


@pytest.fixture(scope="module")
def matrix(spark):
    return spark.createDataFrame([(0, 0, 1.0), (0, 3, 2.0), (1, 1, 3.0), (2, 2, 4.0), (3, 0, 2.0), (3, 3, 5.0)], "i long, j long, v double")


@pytest.fixture(scope="module")
def triangles(spark):
    edges = spark.createDataFrame([(0, 1, 3.0), (1, 2, 2.0), (0, 2, 1.0), (3, 4, 3.0), (4, 5, 2.0), (3, 5, 1.0), (2, 3, 1.0)], "u long, v long, w double")
    return edges, spark.range(6).selectExpr("id", "1.0D AS c")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_shape_and_bands(matrix):
    assert rows(metrics.shape(matrix, 4)) == [(4, 6, 3, 1.0)]
    assert rows(metrics.fixed_band(matrix)) == [(6, 1.0)]
    curve = {r["hundredths"]: r for r in metrics.band_curve(matrix, 4).collect()}
    assert (curve[0]["width"], curve[0]["within"]) == (0, 4)
    assert {(r["width"], r["within"]) for k, r in curve.items() if k} == {(1, 4)}


def test_width_is_ieee(matrix):
    r = {x["hundredths"]: x["width"] for x in metrics.band_curve(matrix, 200).collect()}
    assert r[350] == 8


def test_empty_matrix(matrix):
    none = matrix.where("false")
    assert rows(metrics.shape(none, 4)) == [(4, 0, 0, 0.0)]
    assert rows(metrics.fixed_band(none)) == [(0, 1.0)]


def test_graph_of_matrix(matrix):
    assert rows(graph.matrix_to_graph(matrix, 1)) == [(0, 3, 4.0)]
    assert rows(graph.node_weights(matrix, 4, 1)) == [(0, 1.0), (1, 3.0), (2, 4.0), (3, 5.0)]
    assert rows(graph.matrix_to_graph(matrix, 2)) == [(0, 1, 4.0)]
    assert rows(graph.node_weights(matrix, 4, 2)) == [(0, 4.0), (1, 9.0)]


def test_degrees_and_matching(triangles):
    edges, nodes = triangles
    assert rows(graph.weighted_degrees(edges)) == [(0, 4.0), (1, 5.0), (2, 4.0), (3, 5.0), (4, 5.0), (5, 3.0)]
    assert rows(graph.mutual_round(graph.candidates(edges, nodes, "sorted"))) == [(0, 1), (3, 4)]
    assert rows(graph.matching(edges, nodes, "sorted", cap=1.5)) == [(i, i) for i in range(6)]
    mates = graph.matching(edges, nodes, "sorted")
    assert {frozenset(r) for r in rows(mates)} == {frozenset(x) for x in ((0, 1), (3, 4), (2,), (5,))}
    labels = graph.supernodes(mates)
    assert rows(labels) == [(0, 0), (1, 0), (2, 1), (3, 2), (4, 2), (5, 3)]
    assert rows(graph.contract_nodes(nodes, labels)) == [(0, 2.0), (1, 1.0), (2, 2.0), (3, 1.0)]
    assert rows(graph.contract_edges(edges, labels)) == [(0, 1, 3.0), (1, 2, 1.0), (2, 3, 3.0)]


def test_cut_and_score(spark, triangles):
    edges, nodes = triangles
    part = spark.range(6).selectExpr("id", "id div 3 AS p")
    assert rows(partition.edge_cut(edges, part)) == [(1.0,)]
    assert rows(partition.balance_violation(nodes, part, 2, 0.02)) == [(0.0,)]
    assert rows(partition.partition_score(edges, nodes, part, 2, 0.02, 1.0))[0][0] == pytest.approx(1 / 13)


def test_moves(spark, triangles):
    edges, _ = triangles
    part = spark.createDataFrame([(i, int(i > 1)) for i in range(6)], "id long, p long")
    assert rows(partition.best_moves(edges, part)) == [(2, 1, 0, 2.0)]


def test_permutation(spark):
    order = partition.node_order(spark.createDataFrame([(0, 1), (1, 0), (2, 1), (3, 0)], "id long, p long"))
    assert [r["old"] for r in order.orderBy("new").collect()] == [1, 3, 0, 2]
    assert [r["old"] for r in partition.expand(order, 2).orderBy("new").collect()] == [2, 3, 6, 7, 0, 1, 4, 5]


def test_mtx_round_trip(spark, matrix, tmp_path):
    path = str(tmp_path / "a.mtx")
    mtx.write(matrix, 4, path, "test")
    assert mtx.inspect(spark, path).nnz == 6
    assert rows(mtx.read(spark, path)) == rows(matrix)
    (tmp_path / "s.mtx").write_text("%%MatrixMarket matrix coordinate pattern symmetric\n% c\n3 3 2\n2 1\n3 3\n")
    assert rows(mtx.read(spark, str(tmp_path / "s.mtx"))) == [(0, 1, 1.0), (1, 0, 1.0), (2, 2, 1.0)]
    with pytest.raises(ValueError):
        mtx.read(spark, str(tmp_path / "a.txt"))


def test_logs(spark):
    lines = [
        "[21 May 2026 15:19:03 UTC INFO] Converting matrices to graphs",
        "\x1b[31m[21 May 2026 15:19:08 UTC VERBOSE] Coarse graph has 5 nodes and 6 edges with 2 levels\x1b[0m\r",
        "run.py:3: UserWarning: no angles", "ERROR: no file", "Traceback (most recent call last):", "no warnings here", "Warning: old", "[INFO] warning: small", "[ERROR] x", "[odd] y", "[15:20:01 WARNING]  z ",
    ]
    parsed = logs.parse(spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "job_id long, seq long, value string"))
    found = parsed.orderBy("seq").collect()
    assert [r["level"] for r in found] == ["INFO", "VERBOSE", "WARNING", "ERROR", "ERROR", "INFO", "WARNING", "WARNING", "ERROR", "INFO", "WARNING"]
    assert [str(r["ts"]) for r in found[:3]] == ["2026-05-21 15:19:03", "2026-05-21 15:19:08", "None"]
    assert (found[10]["hms"], found[10]["message"], found[9]["message"], found[8]["hms"]) == ("15:20:01", "z", "[odd] y", None)
    assert rows(logs.stage_durations(parsed)) == [(1, "coarsening", 0, 1), (1, "initialization", 5, 1)]


def test_job_states_end_once(spark, tmp_path):
    """An exit code closes the open stage and ends the job; the stream tells the same, and of live time when its timer runs out."""
    at = lambda s, text, code=None: (logs.line("INFO", text, f"21 May 2026 15:19:{s:02d} UTC"), code)
    runs = {
        1: [at(0, "Converting matrices to graphs"), at(4, "Graph G_K with 3 nodes and 4 edges"), at(9, "Uncoarsening Kernighan-Lin"), at(12, "done", 0), at(30, "Permuting matrices")],
        2: [at(1, "Coarsening Heavy Edge Matching"), ("Error: bad", None), ("Error: worse", None), at(8, "exit", 3)],
        3: [at(2, "Partitioning on coarse graph produced 4 parts"), at(7, "Results saved in runs/a")],
        4: [("bare", None)],
    }
    lines = [(job, i, value, code) for job, found in runs.items() for i, (value, code) in enumerate(found)]
    frame = spark.createDataFrame(lines, "job_id long, seq long, value string, exit_code int")
    batch = {r["job_id"]: r.asDict() for r in logs.job_states(logs.parse(frame)).collect()}
    assert [(batch[i]["status"], batch[i]["stage"], batch[i]["percent"]) for i in (1, 2, 3, 4)] == [("completed", "uncoarsening", 100), ("failed", "coarsening", 36), ("running", "partitioning", 54), ("running", None, 0)]
    assert (batch[1]["initialization"], batch[1]["uncoarsening"], batch[1]["permutation"], batch[2]["coarsening"], batch[3]["partitioning"]) == (9, 3, 0, 7, 0)
    assert (batch[2]["first_error"], batch[3]["result_dir"], batch[3]["coarse_parts"], batch[1]["initial_edges"]) == ("Error: bad", "runs/a", 4, 4)
    for i in range(3):
        frame.where(f"seq % 3 = {i}" if i == 5 else f"least(seq, 2) = {i}").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    assert {r["job_id"]: r.asDict() for r in logs.replayed(spark, str(tmp_path / "in")).collect()} == batch
    live = []
    raw = spark.readStream.schema("job_id long, seq long, value string, exit_code int").json(str(tmp_path / "in"))
    out = logs.live_states(logs.parse(raw), "1 second").writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state"))
    q = out.foreachBatch(lambda b, n: live.extend(b.collect())).trigger(processingTime="1 second").start()
    for _ in range(60):
        if len([r for r in live if r["job_id"] == 3]) > 1:
            break
        time.sleep(1)
    q.stop()
    seconds = [r["live_seconds"] for r in live if r["job_id"] == 3]
    assert seconds[0] == 5 and seconds[1] == 6 and len([r for r in live if r["job_id"] == 1]) == 1


def test_raw_files_are_numbered_over_splits(spark, tmp_path):
    text = [f"line {i} " + "x" * (i % 50) for i in range(3000)]
    (tmp_path / "a.log").write_text("\n".join(text) + "\n")
    (tmp_path / "b.log").write_text("only\n")
    default = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        found = logs.read_files(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", default)
    assert sorted((r["seq"], r["value"]) for r in found if r["file"].endswith("a.log")) == list(enumerate(text))
    assert [(r["seq"], r["value"]) for r in found if r["file"].endswith("b.log")] == [(0, "only")]


def test_stream_counts_levels(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"job_id":1,"seq":1,"value":"[01 Jan 2026 00:00:00 UTC INFO] Loading"}\n{"job_id":1,"seq":2,"value":"[01 Jan 2026 00:01:00 UTC ERROR] x"}\n')
    q = logs.stream_levels(spark, str(tmp_path / "in")).writeStream.outputMode("complete").format("memory").queryName("levels").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r["level"], r["n"]) for r in spark.table("levels").collect()) == [("ERROR", 1), ("INFO", 1)]


def test_mtx_source(spark, tmp_path):
    mtx_source.register(spark)
    path = str(tmp_path / "k")
    k = spark.range(5000).selectExpr("id % 97 AS i", "id * 31 % 89 AS j", "id / 7.0D - 3 AS v").repartition(3)
    k.write.format("mtx").option("n", 97).option("comment", "kept").mode("overwrite").save(path)
    read = lambda size: spark.read.format("mtx").option("partition_bytes", size).load(path)
    whole = rows(k)
    for size in (3000, 8192, 1 << 20):
        assert rows(read(size)) == whole
    assert read(3000).rdd.getNumPartitions() > 20
    (tmp_path / "k" / "part-lost.txt").write_text("1 1 9.0\n")  # of a task that was lost
    assert read(1 << 20).count() == 5000
    k.limit(7).write.format("mtx").option("n", 97).mode("append").save(path)
    assert read(1 << 20).count() == 5007 and not (tmp_path / "k" / "part-lost.txt").exists()
    with pytest.raises(Exception, match="outside"):
        k.write.format("mtx").option("n", 5).mode("overwrite").save(str(tmp_path / "x"))
    text = "%%MatrixMarket matrix coordinate pattern symmetric\n% c\n\n3 3 3\n2 1\n% d\n3 3\n3 1"
    (tmp_path / "s.mtx").write_text(text)
    for size in (1, 3, 1000):
        assert rows(spark.read.format("mtx").option("partition_bytes", size).load(str(tmp_path / "s.mtx"))) == [(0, 1, 1.0), (0, 2, 1.0), (1, 0, 1.0), (2, 0, 1.0), (2, 2, 1.0)]
    for bad in ("%%MatrixMarket matrix array real general\n2 2 1\n", "%%MatrixMarket matrix coordinate real general\n", "%%MatrixMarket matrix coordinate real general\n2 2\n"):
        (tmp_path / "b.mtx").write_text(bad)
        with pytest.raises(Exception, match="cannot read|no size line|not a size line"):
            spark.read.format("mtx").load(str(tmp_path / "b.mtx")).collect()
