import pytest

from folioforge.operators.reingest import Collection

VERSIONS = "version_id long, corpus_status string"
GATES = "version_id long, gate string, status string"
CHUNKS = "version_id long, chunk_no long, text string"


class Stop(Exception):
    pass


def stop_at(name):
    def step(at):
        if at == name:
            raise Stop(at)

    return step


@pytest.fixture
def made(spark, tmp_path):
    c = Collection(spark, f"file://{tmp_path}/collection")
    chunks = spark.createDataFrame([(1, 0, "old one"), (1, 1, "old two"), (2, 0, "kept"), (3, 0, "third")], CHUNKS)
    versions = spark.createDataFrame([(1, "extracted"), (2, "verified"), (3, "extracted")], VERSIONS)
    report = c.reingest("first", chunks, spark.createDataFrame([], GATES), versions)
    assert {r.version_id: r.outcome for r in report.collect()} == {1: "applied", 2: "applied", 3: "applied"} and c.generation == 1
    return c, versions


def held(c):
    return sorted(map(tuple, c.chunks().collect()))


OLD = [(1, 0, "old one"), (1, 1, "old two"), (2, 0, "kept"), (3, 0, "third")]


def second(spark):
    return spark.createDataFrame([(1, 0, "new one"), (2, 0, "changed"), (3, 0, "bad"), (4, 0, "added")], CHUNKS), spark.createDataFrame([(3, "lineage", "fail"), (3, "lineage", "fail"), (1, "text", "review")], GATES)


def test_decisions(spark, made):
    c, versions = made
    chunks, gates = second(spark)
    dry = {r.version_id: (r.outcome, r.old_chunks, r.new_chunks) for r in c.reingest("dry", chunks, gates, versions, dry_run=True).collect()}
    assert dry == {1: ("dry_run", 2, 1), 2: ("blocked_verified", 1, 1), 3: ("blocked_gates", 1, 1), 4: ("dry_run", 0, 1)} and held(c) == OLD
    got = {r.version_id: (r.outcome, r.revokes, r.blocking) for r in c.reingest("second", chunks, gates, versions).collect()}
    assert got == {1: ("applied", False, []), 2: ("blocked_verified", False, []), 3: ("blocked_gates", False, ["lineage"]), 4: ("applied", False, [])}
    assert held(c) == [(1, 0, "new one"), (2, 0, "kept"), (3, 0, "third"), (4, 0, "added")] and c.generation == 2
    allowed = {r.version_id: (r.outcome, r.revokes) for r in c.reingest("third", chunks, gates, versions, allow_revoke=True).collect()}
    assert allowed[2] == ("applied", True) and allowed[1] == ("unchanged", False) and (2, 0, "changed") in held(c)


@pytest.mark.parametrize("name", ["decide", "stage", "verify", "map", "move"])
def test_stopped_anywhere_and_started_again(spark, made, name):
    c, versions = made
    chunks, gates = second(spark)
    with pytest.raises(Stop):
        c.reingest("second", chunks, gates, versions, step=stop_at(name))
    assert held(c) == OLD and c.generation == 1  # readers stay on the old version
    c.reingest("second", chunks, gates, versions)
    after = held(c)
    assert after == [(1, 0, "new one"), (2, 0, "kept"), (3, 0, "third"), (4, 0, "added")] and c.generation == 2
    c.reingest("second", chunks, gates, versions)  # a finished run changes nothing
    assert held(c) == after and c.generation == 2


def test_what_was_written_otherwise_is_rolled_back(spark, made):
    c, versions = made
    chunks, gates = second(spark)

    def spoil(at):
        if at == "verify":
            lost = spark.createDataFrame([(1, 0, "torn")], CHUNKS)
            lost.write.mode("overwrite").parquet(f"{c.root}/runs/second/chunks")

    got = {r.version_id: r.outcome for r in c.reingest("second", chunks, gates, versions, step=spoil).collect()}
    assert got[1] == got[4] == "rolled_back" and held(c) == OLD and c.generation == 1


def test_only_one_run_has_a_generation(spark, made):
    c, versions = made
    chunks, gates = second(spark)

    def other(at):
        if at == "move":
            c.reingest("faster", spark.createDataFrame([(1, 0, "faster")], CHUNKS), gates, versions)

    with pytest.raises(RuntimeError, match="taken by another run"):
        c.reingest("second", chunks, gates, versions, step=other)
    assert (1, 0, "faster") in held(c) and c.generation == 2


def test_missing_and_no_chunks(spark, made):
    c, versions = made
    none = c.reingest("none", spark.createDataFrame([], CHUNKS), spark.createDataFrame([], GATES), versions).collect()
    assert {r.outcome for r in none} == {"blocked_gates"} and all(r.blocking == ["no_chunks"] for r in none) and held(c) == OLD and c.generation == 1
