import json

from siltstone.streaming.watch import BranchSwitch, ReloadMetrics, Watcher, branch_changes, debounced


def test_watch_pauses_without_loss(spark, tmp_path):
    source, seen = tmp_path / "in", []
    source.mkdir()
    stream = spark.readStream.schema("path string").json(str(source))
    watcher = Watcher(stream, "path", str(tmp_path / "cp"), lambda df: seen.append(sorted(r.path for r in df.collect())), ["go"], interval=None)

    def put(name, *paths):
        (source / name).write_text("\n".join(json.dumps({"path": p}) for p in paths))

    put("1.json", "a.go", "a.go", "b.md")
    watcher.start().awaitTermination(60)
    watcher.pause()
    put("2.json", "c.go")
    watcher.resume().awaitTermination(60)
    assert seen == [["a.go"], ["c.go"]]


def test_sessions_stream_like_batch(spark, tmp_path):
    rows = spark.sql("select * from values (timestamp'2024-01-01 00:00:00', 'u', 'a'), (timestamp'2024-01-01 00:00:30', 'u', 'b'), (timestamp'2024-01-01 00:05:00', 'u', 'a') t(ts, k, p)")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    batch = debounced(rows, ["k"], "ts", "p", "1 minute")
    assert sorted(tuple(r.items) if False else (r.n, r["items"]) for r in batch.collect()) == [(1, ["a"]), (2, ["a", "b"])]
    stream = debounced(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), ["k"], "ts", "p", "1 minute", watermark="10 seconds")
    query = stream.writeStream.format("memory").queryName("sessions").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [(r.n, r["items"]) for r in spark.table("sessions").collect()] == [(2, ["a", "b"])]


def test_branch_changes(spark):
    rows = spark.createDataFrame([(1, "main"), (2, "main"), (3, "dev"), (4, "main")], "t int, b string").selectExpr("'r' as r", "t", "b")
    assert [(r.t, r.from_branch, r.to_branch) for r in branch_changes(rows, ["r"], "t", "b").orderBy("t").collect()] == [(3, "main", "dev"), (4, "dev", "main")]


def test_metrics():
    metrics = ReloadMetrics()
    metrics.record(1.0)
    metrics.record(2.0, ValueError("x"))
    assert metrics.snapshot() == {"reloads": 2, "failures": 1, "last_ms": 2.0, "last_error": "x"}


def test_branch_switch_pauses_and_resumes():
    said = []

    class Quiet:
        def pause(self):
            said.append("pause")

        def resume(self):
            said.append("resume")

    switch = BranchSwitch(Quiet(), lambda branch: said.append(branch))
    assert [switch.saw(b) for b in ("main", "main", "dev", "dev", "main")] == [False, False, True, False, True]
    assert said == ["pause", "dev", "resume", "pause", "main", "resume"]
