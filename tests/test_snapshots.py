"""Tables kept as snapshots, the local store on them, and incremental loads of manifest files."""

import json
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from hwcatalog.operators import load, local_store, snapshots
from hwcatalog.streaming import incremental

SCHEMA = "driver_id string, version string, created_at string"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def folders(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_upsert_writes_its_buckets_alone(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    old = spark.range(5000).select(F.concat(F.lit("d"), "id").alias("driver_id"), F.lit("1").alias("version"), F.lit("t0").alias("created_at"))
    new = spark.range(4995, 5005).select(F.concat(F.lit("d"), "id").alias("driver_id"), F.lit("2").alias("version"), F.lit("t1").alias("created_at"))
    first = snapshots.upsert(spark, path, old)
    before = folders(tmp_path)
    second = snapshots.upsert(spark, path, new)
    after = folders(tmp_path)
    assert rows_of(snapshots.read(spark, path)) == rows_of(load.upsert(old, new)) and rows_of(snapshots.read(spark, path, 1)) == rows_of(old)
    assert all(after[f] == t for f, t in before.items())  # nothing is written over
    same = [b for b in first.folders if second.folders[b] == first.folders[b]]
    assert (first.version, second.version) == (1, 2) and 54 <= len(same) < 64
    assert rows_of(snapshots.lookup(spark, path, "driver_id", ["d4999", "d5000", "none"])) == [("d4999", "2", "t0"), ("d5000", "2", "t1")]
    scan = snapshots.lookup(spark, path, "driver_id", ["d7"])
    assert len(scan.inputFiles()) == 1 and scan.count() == 1
    assert snapshots.upsert(spark, path, new.limit(0)) == second  # nothing to do, no mark
    snapshots.vacuum(spark, path)
    assert snapshots.versions(spark, path) == [2] and rows_of(snapshots.read(spark, path)) == rows_of(load.upsert(old, new)) and len(folders(tmp_path)) < len(after)


def test_upsert_in_several_goes(spark, tmp_path, monkeypatch):
    """Buckets that hold much are written one after another, put in by one mark, and hold what one go would put there."""
    old = spark.range(300).select(F.concat(F.lit("d"), "id").alias("driver_id"), F.lit("1").alias("version"), F.lit("t0").alias("created_at"))
    new = spark.range(250, 350).select(F.concat(F.lit("d"), "id").alias("driver_id"), F.lit("2").alias("version"), F.lit("t1").alias("created_at"))
    whole = lambda o, n: F.concat_ws("+", o, n)
    for at_once, goes in ((1 << 30, 1), (1, 8)):
        monkeypatch.setattr(snapshots, "AT_ONCE", at_once)
        path = f"file://{tmp_path}/{goes}"
        marks = [snapshots.upsert(spark, path, rows, buckets=8, merged={"version": whole}) for rows in (old, new)]
        assert [(m.version, len(m.folders), len(set(m.folders.values()))) for m in marks] == [(1, 8, goes), (2, 8, goes)]
        want = load.upsert(old, new, merged={"version": whole})
        assert rows_of(snapshots.read(spark, path)) == rows_of(want) and rows_of(snapshots.read(spark, path, 1)) == rows_of(old)
    with pytest.raises(Exception, match="without driver_id"):
        snapshots.upsert(spark, path, spark.createDataFrame([("a", "1", "t"), (None, "1", "t")], SCHEMA))
    made = snapshots.cut(new)
    with pytest.raises(Exception, match="isn't touched"):
        snapshots.commit(spark, path, made, "driver_id", lambda rows, those: made, at_once=1)  # a go may only return its own buckets' rows
    assert snapshots.upsert(spark, path, made, merged={"version": whole}) and made.count() == 100  # what the caller has cut is the caller's to release


def test_what_a_write_shuffled_goes_with_it(spark, tmp_path):
    files = lambda: spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().size()
    rows = spark.range(1000).select(F.concat(F.lit("d"), "id").alias("driver_id"), F.lit("1").alias("version"), F.lit("t").alias("created_at"))
    before = files()
    held = snapshots.cut(rows.repartition(7, "version"))
    assert files() <= before
    snapshots.upsert(spark, f"file://{tmp_path}/t", held)
    snapshots.upsert(spark, f"file://{tmp_path}/t", held.where("driver_id < 'd5'"))
    assert files() <= before + 12  # of the few numbers that are asked for, not of the rows


def test_failed_and_rival_writes(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    old = spark.createDataFrame([("a", "1", "t0"), ("b", "1", "t0")], SCHEMA)
    snapshots.upsert(spark, path, old)
    with monkeypatch.context() as m, pytest.raises(OSError):

        def fail(*a):
            assert rows_of(snapshots.read(spark, path)) == rows_of(old)  # a reader between the writing and the mark
            raise OSError

        m.setattr(snapshots, "_put", fail)
        snapshots.upsert(spark, path, old.withColumn("version", F.lit("x")))
    assert rows_of(snapshots.read(spark, path)) == rows_of(old)

    def slow(rows):  # another writer commits meanwhile
        snapshots.upsert(spark, path, spark.createDataFrame([("c", "3", "t3")], SCHEMA))
        return rows

    with pytest.raises(snapshots.Conflict):
        snapshots.commit(spark, path, old, "driver_id", slow)
    assert [r[0] for r in rows_of(snapshots.read(spark, path))] == ["a", "b", "c"]
    assert all("/_" not in str(p) for p in (tmp_path / "t/marks").glob("_*"))
    with pytest.raises(ValueError):
        snapshots.upsert(spark, path, old.withColumn("more", F.lit(1)).select("driver_id", "more"))
    with pytest.raises(Exception, match="without driver_id"):
        snapshots.upsert(spark, path, spark.createDataFrame([(None, "1", "t")], SCHEMA))
    with pytest.raises(Exception, match="isn't touched"):
        snapshots.commit(spark, path, old.where("driver_id = 'a'"), "driver_id", lambda rows: spark.createDataFrame([(f"q{i}", "1", "t") for i in range(99)], SCHEMA))


def test_odd_tables(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    assert snapshots.read(spark, path) is None and snapshots.lookup(spark, path, "driver_id", ["a"]) is None and snapshots.upsert(spark, path, spark.createDataFrame([], SCHEMA)) is None
    snapshots.upsert(spark, path, spark.createDataFrame([("", None, ""), ("x" * 100_000, "é", None)], SCHEMA))
    snapshots.commit(spark, path, spark.createDataFrame([("",)], "driver_id string"), "driver_id", lambda rows: rows.where("driver_id <> ''"))  # a bucket that ends empty
    assert [len(r.driver_id) for r in snapshots.read(spark, path).collect()] == [100_000]


def test_files_are_rotated(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    rows = spark.range(4000).select(F.concat(F.lit("d"), "id").alias("driver_id"), F.sha2(F.col("id").cast("string"), 512).alias("version"), F.lit("t").alias("created_at"))
    snapshots.upsert(spark, path, rows, buckets=2, file_bytes=60_000)
    sizes = [os.path.getsize(f) for f in folders(tmp_path)]
    assert len(sizes) > 8 and max(sizes) <= 60_000 and snapshots.read(spark, path).count() == 4000


def entry(i, **more):
    return json.dumps({"id": f"d{i}", "pack": "p", "hwids": ["A", "B"], "parts": [{"part_num": 1, "filename": "f1", "url": "u"}]} | more)


def test_local_store(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    put = lambda *texts: local_store.save(spark, path, spark.createDataFrame(list(enumerate(texts)), "pos long, value string"), "2024-01-02")
    put(entry(1), entry(2, pack=None, parts=[]), entry(3, provider=["x"]), entry(4, hwids="A"), entry(5, parts=[{"part_num": 1}, {"part_num": []}]), entry(6, parts=None), entry(""), "{", None, "[1]", json.dumps({"id": ""}), json.dumps({"pack": "p"}), entry(7, parts=[3]), entry(8, hwids=None))
    d = {r.driver_id: r for r in local_store.drivers(spark, path).collect()}
    assert set(d) == {"d1", "d2", "d"} and d["d2"].pack is None and d["d1"].provider == "" and (d["d1"].hwid_count, d["d1"].zip_parts, d["d1"].date_added, d["d1"].enabled, d["d1"].supersedes) == (2, 1, "2024-01-02", True, None)
    why = {r.value: r.reason for r in local_store.refused(spark, path).collect()}
    assert why[entry(3, provider=["x"])] == "a list or object for a value" and why[entry(4, hwids="A")] == why[entry(8, hwids=None)] == "hwids not a list" and why["{"] == why[None] == why["[1]"] == "no JSON object" and why[json.dumps({"pack": "p"})] == "missing id"
    assert why[entry(5, parts=[{"part_num": 1}, {"part_num": []}])] == why[entry(7, parts=[3])] == "a bad part" and why[entry(6, parts=None)] == "parts not a list"
    again = [entry(1, version="2", enabled=False, parts=[{"part_num": 2, "filename": "f2", "size_bytes": 7}, {"filename": "new"}]), entry(1, version="3", parts=[{"part_num": "2", "filename": "last"}]), entry(2, pack={})]
    for _ in range(2):  # a second time changes nothing
        put(*again)
        d = {r.driver_id: r for r in local_store.drivers(spark, path).collect()}
        assert d["d1"].version == "3" and d["d1"].enabled and d["d2"].pack is None
        assert rows_of(local_store.parts(spark, path).where("driver_id = 'd1'")) == [("d1", 1, "new", 0, "", ""), ("d1", 2, "last", 0, "", "")]


def test_entries_that_come_once_are_not_dealt(spark, tmp_path, monkeypatch):
    """The parts of an id that comes once stay where they are; where some ids come again, all the same is saved."""
    seen = []
    made = local_store._one_an_id
    monkeypatch.setattr(local_store, "_one_an_id", lambda good: seen.append(made(good)) or seen[-1])
    for texts in ([entry(i) for i in range(20)], [entry(i % 15, version=str(i), parts=[{"part_num": 1 + i // 15}]) for i in range(20)]):
        local_store.save(spark, f"file://{tmp_path}/{len(seen)}", spark.createDataFrame(list(enumerate(texts)), "pos long, value string"), "2024-01-02")
    plans = [d._jdf.queryExecution().optimizedPlan().toString() for d in seen]
    assert "Aggregate" not in plans[0] and "Join" not in plans[0] and "LeftAnti" in plans[1]
    assert rows_of(local_store.drivers(spark, f"file://{tmp_path}/1").select("driver_id", "version")) == sorted((f"d{i}", str(i + 15 if i < 5 else i)) for i in range(15))
    assert rows_of(local_store.parts(spark, f"file://{tmp_path}/1").select("driver_id", "part_num")) == sorted([(f"d{i}", 1) for i in range(15)] + [(f"d{i}", 2) for i in range(5)])


def document(ids, **more):
    return json.dumps({"schema": "3", "drivers": [{"id": i, "version": str(v), "hwids": [f"H{i}{v}"], "parts": [{"part_num": 1, "filename": "f", "url": f"u{v}"}]} for i, v in ids]} | more)


def plain(versions):
    """The tables after a load of the newest good version of each file, in order of name."""
    newest = {}
    for file, at, ids in versions:
        if ids is not None and (file not in newest or (at, document(ids)) > newest[file][:2]):
            newest[file] = (at, document(ids), ids)
    out = {}
    for file in sorted(newest):
        for i, v in newest[file][2]:
            if i:
                out[i] = (v, file)
    return sorted((i, str(v), f) for i, (v, f) in out.items())


def test_loads_in_any_order_equal_a_full_load(spark, tmp_path):
    """Replayed, reordered, shortened and broken versions of files; ids that move between files or repeat in one."""
    rng = random.Random(5)
    begin = datetime(2024, 1, 1)
    versions = []
    for t in range(14):
        ids = [(rng.choice(["", *(f"d{k}" for k in range(12))]), t) for _ in range(rng.randint(0, 6))]
        versions.append((rng.choice(["A.manifest.json", "A.manifest.2.json", "B.manifest.json"]), begin + timedelta(hours=t), None if t % 6 == 4 else ids))
    table = f"file://{tmp_path}/t"
    order = versions + rng.sample(versions, 5)
    rng.shuffle(order)
    done = []
    for at in range(0, len(order), 5):
        batch = order[at : at + 5]
        rows = [(f, t, "{" if ids is None else document(ids)) for f, t, ids in batch] + [("installers.manifest.json", begin, "{}"), ("readme.json", begin, "{}")]
        incremental.load_files(spark, table, spark.createDataFrame(rows, "file string, modified timestamp, value string"))
        done += batch
        got = sorted((r.driver_id, r.version, r.source_manifest) for r in incremental.drivers(spark, table).collect())
        assert got == plain(done)
    want = plain(versions)
    assert sorted((r.driver_id, r.hwid_string) for r in incremental.hwids(spark, table).collect()) == [(i, f"H{i}{v}") for i, v, _ in want]
    assert sorted((r.driver_id, r.url) for r in incremental.parts(spark, table).collect()) == [(i, f"u{v}") for i, v, _ in want]
    state = {r.file: r for r in incremental.files(spark, table).collect()}
    broken = {}
    for f, t, ids in versions:
        if ids is None:
            broken[f] = max(t, broken.get(f, t))
    assert {f: r.refused for f, r in state.items() if r.refused} == broken


def test_load_that_fails_between_its_commits(spark, tmp_path, monkeypatch):
    table, at = f"file://{tmp_path}/t", datetime(2024, 1, 1)
    load_ = lambda t, ids: incremental.load_files(spark, table, spark.createDataFrame([("A.manifest.json", at + timedelta(hours=t), document(ids))], "file string, modified timestamp, value string"))
    load_(0, [("a", 0), ("b", 0), ("c", 0)])
    with monkeypatch.context() as m, pytest.raises(OSError):

        def fail(*a):
            raise OSError

        m.setattr(snapshots, "upsert", fail)  # entries are in, the list of files isn't
        load_(1, [("b", 1), ("d", 1)])
    load_(1, [("b", 1), ("d", 1)])
    assert sorted((r.driver_id, r.version) for r in incremental.drivers(spark, table).collect()) == [("b", "1"), ("d", "1")]
    assert incremental.files(spark, table).first().ids == ["b", "d"]
    load_(2, [])
    assert incremental.drivers(spark, table).count() == 0 and incremental.hwids(spark, table).count() == 0


def test_names_of_files(spark):
    paths = {"file:///x/file=A%20B+C.manifest.json/part-0.txt": "A B+C.manifest.json", "file:///x/A%20B.manifest.json": "A B.manifest.json", "file:///x/file=a%253Ab.manifest.json/p": "a:b.manifest.json"}
    assert {r.p: r.n for r in spark.createDataFrame([(p,) for p in paths], "p string").select("p", incremental.file_name(F.col("p")).alias("n")).collect()} == paths
