import os

import pytest
from pyspark.sql import functions as F

from folioforge.operators import graph, relational
from folioforge.plans.lineage import cut
from folioforge.sources import files
from folioforge.streaming import loops


def test_reconcile(spark):
    side = lambda rows: spark.createDataFrame(rows, "row_key long, digest string")
    local, remote, base = side([(1, "a"), (2, "x"), (3, "a"), (4, "p"), (6, "n"), (8, "l")]), side([(1, "a"), (2, "a"), (3, "y"), (4, "q"), (7, "n"), (8, "l")]), side([(1, "a"), (2, "a"), (3, "a"), (4, "a"), (5, "a"), (6, "n"), (8, "a")])
    plan = relational.reconcile(local, remote, base)
    assert {r.row_key: r.action for r in plan.collect()} == {1: "keep", 2: "push", 3: "pull", 4: "conflict", 5: "keep", 6: "delete_local", 7: "pull", 8: "keep"}
    with pytest.raises(ValueError):
        relational.apply_reconciled(plan)
    assert {r.row_key for r in relational.apply_reconciled(plan.filter("row_key <> 4")).collect()} == {1, 2, 3, 7, 8}


def test_transitions(spark):
    rows = [("extracted", "approve", None, "verified"), ("needs_review", "approve", " ", None), ("needs_review", "approve", "ok", "verified"), ("verified", "revoke", None, "revoked"), ("verified", "reject", None, None)]
    d = spark.createDataFrame(rows, "s string, a string, n string, w string").select(relational.transition(F.col("s"), F.col("a"), F.col("n")).alias("g"), "w")
    assert all(r.g == r.w for r in d.collect())


def test_codes(spark):
    have = spark.createDataFrame([("286-1",), ("286-2",), ("53",), ("10064-1",)], "code string")
    ask = spark.createDataFrame([("286",), ("286-2",), ("53",), ("10064",), ("286-3",), ("5",)], "code string")
    assert {r.code for r in relational.missing_codes(ask, have).collect()} == {"286-3", "5"}
    codes = spark.createDataFrame([("ISO 286-2",), ("ISO 53",), (None,), ("ISO/TR 10064-1",), ("ISO 286-1",)], "code string")
    assert [r.code for r in codes.orderBy(relational.natural_key(F.col("code"))).collect()] == ["ISO 53", "ISO 286-1", "ISO 286-2", "ISO/TR 10064-1", None]


def test_components_and_chains(spark):
    edges = [(1, 2), (2, 3), (9, 3), (20, 21), (22, 21), (5, 5), (None, 4)] + [(100 + i, 101 + i) for i in range(40)] + [(1000, 1001 + i) for i in range(60)]
    got = {r.id: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {k: v for k, v in got.items() if k < 100} == {1: 1, 2: 1, 3: 1, 9: 1, 20: 20, 21: 20, 22: 20}
    assert all(got[100 + i] == 100 for i in range(41)) and all(got[1001 + i] == 1000 for i in range(60))
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    items = spark.createDataFrame([(i, i - 1 if i % 10 else None) for i in range(35)], "item_id long, replaces long")
    assert all(r.root == r.item_id // 10 * 10 and r.depth == r.item_id % 10 for r in relational.chains(items).collect())
    with pytest.raises(ValueError):
        relational.chains(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "item_id long, replaces long"), 5)


def test_cut_reads_back(spark):
    d = cut(spark.range(5).withColumn("t", F.lit("x")))
    assert d.count() == 5 and d.columns == ["id", "t"]


def test_files(spark, tmp_path):
    texts = {"a.txt": "düz metin".encode("cp1254"), "b.md": "ışık".encode(), "c.bin": b"\x00\x01", "d.pdf": b"x", "e": b"%PDF-1.7", "f.txt": "ş".encode("utf-16"), ".hidden": b"x", "g.tmp": b"x", "h.png": b"\x89PNG\r\n\x1a\n", "i": b"plain"}
    for n, b in texts.items():
        (tmp_path / n).write_bytes(b)
    rows = files.scan(spark, f"file://{tmp_path}", settled_seconds=-5)
    got = {r.name: r.kind for r in rows.withColumn("kind", files.detect(F.col("name"), F.col("content"))).collect()}
    assert got == {"a.txt": "text", "b.md": "text", "c.bin": "unknown", "d.pdf": "pdf", "e": "pdf", "f.txt": "text", "h.png": "image", "i": "text"}
    text = {r.name: r.text for r in files.decode(rows.select("name", "content")).collect()}
    assert text["a.txt"] == "düz metin" and text["b.md"] == "ışık" and text["f.txt"] == "ş"


def test_archives(spark):
    rows = [("z", 0, "a.txt", 10, 5, False, False), ("z", 1, "/etc/x.txt", 1, 1, False, False), ("z", 2, "../y.txt", 1, 1, False, False), ("z", 3, "l.txt", 1, 1, True, False), ("z", 4, "in.zip", 1, 1, False, False), ("z", 5, "b.txt", 1000, 1, False, False), ("z", 6, "d/", 0, 0, False, True), ("z", 7, "q.exe", 9, 9, False, False)]
    got = {r.name: (r.status, r.reason) for r in files.archive_members(spark.createDataFrame(rows, "archive string, ord int, name string, size long, packed long, is_link boolean, is_dir boolean")).collect()}
    assert got == {"a.txt": ("extracted", None), "/etc/x.txt": ("blocked", "absolute_path"), "../y.txt": ("blocked", "parent_path"), "l.txt": ("blocked", "link"), "in.zip": ("blocked", "nested_archive"), "b.txt": ("blocked", "ratio"), "d/": ("skipped", None), "q.exe": ("catalogued", None)}


def test_archive_of_too_many_members(spark):
    members = spark.range(files.MEMBERS + 3).select(F.lit("big").alias("archive"), F.col("id").cast("int").alias("ord"), F.concat(F.col("id").cast("string"), F.lit(".txt")).alias("name"), F.lit(1).cast("long").alias("size"), F.lit(1).cast("long").alias("packed"), F.lit(False).alias("is_link"), F.lit(False).alias("is_dir"))
    got = files.archive_members(members.unionByName(members.filter("ord < 3").withColumn("archive", F.lit("small")))).groupBy("archive", "status", "reason").count().collect()
    assert {tuple(r) for r in got} == {("big", "blocked", "too_many_members", files.MEMBERS + 3), ("small", "extracted", None, 3)}


def test_manifest(spark):
    v = spark.createDataFrame([(1, 2, "f" * 64, "b.PDF"), (1, 1, "e" * 64, "a.pdf")], "doc_id long, version int, sha string, name string")
    m = files.manifests(v).first().manifest
    assert m.index('"version":1') < m.index('"version":2') and "document-versions/1/v0002_ffffffffffff.pdf" in m


def test_watch(spark, tmp_path):
    folder, state = tmp_path / "in", f"file://{tmp_path}/state"
    folder.mkdir()
    (folder / "a.txt").write_text("1")
    (folder / "b.txt").write_text("1")
    first, at = loops.watch(spark, f"file://{folder}", state)
    assert {r.change for r in first.collect()} == {"new"}
    os.remove(folder / "a.txt")
    (folder / "b.txt").write_text("2")
    (folder / "c.txt").write_text("3")
    second, _ = loops.watch(spark, f"file://{folder}", state, at)
    assert {r.path.rsplit("/", 1)[-1]: r.change for r in second.collect()} == {"a.txt": "missing", "b.txt": "changed", "c.txt": "new"}
    assert loops.backoff(30, True) == 60 and loops.backoff(800, True) == 900 and loops.backoff(500, False) == 30


def test_streams(spark, sf, tmp_path):
    src = f"{tmp_path}/events"
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    half = e.selectExpr("max(event_id) div 2").first()[0]
    e.filter(F.col("event_id") <= half).coalesce(1).write.parquet(src)
    for _ in range(2):  # the second run has nothing new and repeats nothing
        loops.run_once(loops.audit_log(loops.event_stream(spark, src)), f"{tmp_path}/log", f"{tmp_path}/ck")
    e.filter(F.col("event_id") > half).coalesce(1).write.mode("append").parquet(src)
    loops.run_once(loops.audit_log(loops.event_stream(spark, src)), f"{tmp_path}/log", f"{tmp_path}/ck")
    log = spark.read.parquet(f"{tmp_path}/log")
    assert log.count() == e.count() == log.select("event_id").distinct().count()
    loops.run_once(loops.counts_by_window(loops.event_stream(spark, src)), f"{tmp_path}/counts", f"{tmp_path}/ck2")
    assert 0 < spark.read.parquet(f"{tmp_path}/counts").agg(F.sum("n")).first()[0] <= e.count()
    loops.run_once(loops.live_sessions(loops.event_stream(spark, src)), f"{tmp_path}/sessions", f"{tmp_path}/ck3")
    assert spark.read.parquet(f"{tmp_path}/sessions").agg(F.sum("n_events")).first()[0] <= e.count()
    loops.run_once(loops.anchored(loops.event_stream(spark, src)), f"{tmp_path}/anchored", f"{tmp_path}/ck4")
    assert spark.read.parquet(f"{tmp_path}/anchored").agg(F.sum("n_events")).first()[0] <= e.count()


def test_summaries_due(spark):
    rows = [(1, t, "user", "ab") for t in range(9)] + [(2, t, None, None) for t in range(3)] + [(3, None, "a", None), (3, 0, "a", "x"), (3, 0, "a", "x"), (3, 1, "b", "yz")]
    got = relational.summaries_due(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"), 4)
    assert sorted(map(tuple, got.collect()), key=str) == [(1, 4, 0, 3, 8), (1, 8, 4, 7, 8), (3, 4, None, 1, 4)]
    assert relational.summaries_due(spark.createDataFrame([], "conv_id long, turn int, role string, text string"), 4).count() == 0
