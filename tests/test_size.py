"""Work that must not grow faster than the input: what a plan holds, and results beyond the test tables' keys."""

import random

from pyspark.sql import functions as F

import __spark_entry__
from hwcatalog.functions import hwid, inf
from hwcatalog.operators import id_table, local_store, reconcile, search, search_index
from hwcatalog.plans import source_queries, views
from hwcatalog.plans.views import Catalog
from hwcatalog.sources import executables, manifests

SF = "/root/testdata/sf0.001"

INF = '[Version]\nClass=Net\n[M.NTamd64]\n%d% = I, PCI\\VEN_10000&DEV_10001\n%e% = I, USB\\VID_10000&PID_10000\n[Strings]\nd="One"\nE="Two"\n'


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_ids_of_five_digits(spark):
    df = spark.createDataFrame([(INF,)], "text string")
    assert df.select(inf.hwids(F.col("text"), wide=True)).first()[0] == ["PCI\\VEN_10000&DEV_10001", "USB\\VID_10000&PID_10000"]
    assert inf.parse_inf(df, wide=True).first().hwids == ["PCI\\VEN_10000&DEV_10001", "USB\\VID_10000&PID_10000"]
    assert df.select(inf.hwids(F.col("text"))).first()[0] == []  # the catalog's own rule


def test_strings_once_a_text(spark):
    """The [Strings] section is cut out once, not anew for each name that is looked up in it."""
    df = spark.createDataFrame([(INF,)], "text string").withColumn("s", inf.strings(F.col("text")))
    named, described = df.select(inf.resolve(F.lit("%D%-%none%-%e%"), F.col("s")).alias("v")), df.select(inf.descriptions(F.col("text"), F.col("s")).alias("v"))
    assert named.first().v == "One-%none%-Two" and described.first().v == ["One", "Two"]
    assert plan(named).count("[strings]") == plan(described).count("[strings]") == 1


def test_near_words_are_told_by_plain_distance_first(spark):
    """Words too far off don't reach the distance with swaps, and scores are those of that distance alone."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 11))) for _ in range(600)] + ["badc", "abdc", "bacd", "dcbaabcd", "bacdbadc"]
    for token in ("abcd", "abcdabcd"):
        budget = search.typo_budget(len(token))
        df = spark.createDataFrame([(w,) for w in words], "w string").select("w", search.token_score(token, F.concat(F.lit("zz "), "w")).alias("s"), search.osa_distance(token, F.col("w")).alias("d"))
        assert "levenshtein" in plan(df)
        for r in df.collect():
            near = abs(len(r.w) - len(token)) <= budget and r.d <= budget
            assert r.s == (80.0 if token in r.w else 88.0 if token.startswith(r.w) and len(token) >= 3 else 76.0 - 10.0 * r.d if near else 0.0)


def test_index_grows_with_texts_not_rows(spark, tmp_path):
    """Rows that share their texts add postings alone; words of ids have no deletion neighbourhood, and are found with typos all the same."""
    c = Catalog(spark, SF)
    d = c.drivers.withColumn("driver_id", F.substring("driver_id", 1, 18)).limit(40).localCheckpoint()
    more = d.unionByName(d.withColumn("display_name", F.reverse("provider"))).unionByName(d)
    a, b = search_index.build(d, f"file://{tmp_path}/a"), search_index.build(d.unionByName(d), f"file://{tmp_path}/b")
    assert [a.table(t).count() for t in ("words", "near", "grams")] == [b.table(t).count() for t in ("words", "near", "grams")]
    assert a.table("near").agg(F.max(F.length("word"))).first()[0] <= search_index.SHORT
    long = d.first().driver_id[4:]
    typo = long[:3] + long[4] + long[3] + long[5:]
    index = search_index.build(more, f"file://{tmp_path}/c")
    for q in (typo, f"id:{typo}", "larg", '"large brand"', "-x64 brand"):
        found, _ = search_index.indexed_search(index, q)
        assert sorted((r.driver_id, r.score) for r in found.collect()) == sorted((r.driver_id, r.score) for r in search.text_search(more, q).collect())


def test_spread_rows_stay_spread(spark):
    """A filter on what is made of the rows isn't put below the shuffle."""
    assert "Repartition" not in plan(Catalog(spark, SF).spread("drivers").where("length(display_name) > 3"))


def test_pairs_that_cannot_share_enough_are_not_compared(spark):
    """The bounds lose no pair, for sets with an empty id and a null among them, and are part of the join."""
    rng = random.Random(5)
    pool = [None, "", *(f"p{i}" for i in range(40))]
    sets = {i: rng.sample(pool, rng.randint(1, 9)) for i in range(120)} | {i: rng.sample(pool[:9], rng.randint(1, 6)) for i in range(120, 200)}
    df = spark.createDataFrame(list(sets.items()), "id long, hwids array<string>")
    for least in (0.3, 0.5, 0.8):
        got = reconcile.overlaps(df, df, least, ordered=True)
        share = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
        assert sorted((r.a_id, r.b_id) for r in got.collect()) == [(a, b) for a in sets for b in sets if a < b and share(sets[a], sets[b]) >= least - 1e-12]
        assert "bit_count" in plan(got)


def test_ladder_is_climbed_once(spark):
    """A query's first rung is found before its drivers are looked up, whatever the case of the ids."""
    ids = spark.createDataFrame([("PCI\\A", "d1"), ("pci\\a", "d1"), ("PCI\\A&B", "d2"), ("PCI\\C", "d3")], "hwid_string string, driver_id string")
    got = search.hwid_lookup(ids, spark.createDataFrame([("PCI\\A&B&X",), ("pci\\A&Y",), ("PCI\\Z",)], "query string"))
    assert plan(got).count("posexplode") == 1
    assert sorted(map(tuple, got.collect())) == [("PCI\\A&B&X", "PCI\\A&B", 1, False, "d2"), ("pci\\A&Y", "pci\\A", 1, False, "d1")]


def test_executables_are_made_by_all_cores(spark):
    """The files are made of rows that are dealt to all cores, not by the one task that reads the rows."""
    dealt = []

    class Seen(Catalog):
        def spread(self, name):
            dealt.append(name)
            return super().spread(name)

    source_queries.executable_tree(Seen(spark, SF))
    assert dealt == ["drivers"]


def test_views_deal_keys_not_texts(spark, monkeypatch):
    """Ids and entries have the rows of their SQL, but are made of distinct keys: no text is a grouping key."""
    made = Catalog(spark, SF)
    mine = {n: getattr(made, n) for n in views.MADE}
    assert all("RepartitionByExpression [l_partkey" in plan(d) and "Aggregate [driver_id" not in plan(d) for d in mine.values())
    monkeypatch.setattr(views, "MADE", {})
    by_sql = Catalog(spark, SF)
    for n, d in mine.items():
        sql = getattr(by_sql, n)
        assert d.dtypes == sql.dtypes and d.count() == sql.count() and d.exceptAll(sql).isEmpty()
    numbers = spark.createDataFrame([(n,) for n in (0, 1, 4095, 65535, 65536, -1, None)], "n long")
    assert numbers.select(views._hex(F.col("n")).alias("a"), F.format_string("%04X", "n").alias("b")).where("NOT (a <=> b)").isEmpty()


def test_ladder_splits_an_id_once(spark):
    """The id isn't split anew for each step."""
    df = spark.createDataFrame([("PCI\\A&B&&C",), ("PCI\\",), ("\\A",), ("A&B",), ("",), (None,)], "h string").select("h", hwid.ladder(F.col("h")).alias("l"))
    assert plan(df).count("split(") == 1
    assert [r.l for r in df.collect()] == [["PCI\\A&B&C", "PCI\\A&B", "PCI\\A"], ["PCI\\"], ["\\A"], ["A&B"], [""], [None]]


def test_entries_are_made_once(spark):
    """Queries that read the entries several times read them from the shared folder."""
    for name in ("join_reconcile", "join_hwid_class", "classify_upload", "join_conflict"):
        assert "l_partkey" not in plan(__spark_entry__.queries()[name](spark, SF))


def test_classes_are_read_once_a_record(spark):
    """What is made of a record isn't made anew for each of its ids."""
    df = spark.createDataFrame([("a", "Net", ["x", "X", None], "1"), ("b", None, [], "2")], "id string, category string, hwids array<string>, v string")
    got = reconcile._ids_and_class(df, "id", F.reverse("v").alias("n"))
    above = plan(got).split("Generate")[0]
    assert "category" not in above and "reverse" not in above
    assert {(r.id, r.n, r.blank, r.h) for r in got.collect()} == {("a", "1", False, "X")}


def test_ids_of_one_file_are_not_counted(spark):
    """Distinct files, versions and archs are counted for ids of several files alone."""
    rows = [("f1", "1", "x", ["a", "b", "c"]), ("f2", "2", "x", ["a", "d"]), ("f2", "3", "y", ["e"]), ("f1", "1", "x", ["d", "a"]), (None, "9", "z", ["b", "d"]), ("f3", "1", "x", ["c"])]
    got = reconcile.conflicts(spark.createDataFrame(rows, "file string, version string, arch string, hwids array<string>"))
    assert "LeftSemi" in plan(got)
    assert sorted(map(tuple, got.collect())) == [("a", 2, 2, 1), ("d", 2, 3, 2)]


def test_best_entries_come_from_narrow_rows(spark):
    """The steps of a comparison don't carry the ids, nor their joined text."""
    seen = []
    whole = reconcile.cut
    reconcile.cut = lambda d, what="cut": seen.append((what, d.columns)) or whole(d, what)
    try:
        __spark_entry__.queries()["join_reconcile"](spark, SF).count()
    finally:
        reconcile.cut = whole
    assert {"k", "h"}.isdisjoint(dict(seen)["steps"])


def test_stored_ids_have_small_filters(spark, tmp_path):
    """A pair that comes twice is stored once by the one deal of the rows, and a Bloom filter is as large as its row group needs."""
    ids = spark.range(3000).select(F.concat(F.lit("PCI\\VEN_"), F.col("id").cast("string")).alias("hwid_string"), F.lit("d").alias("driver_id"))
    id_table.store(ids.union(ids), f"file://{tmp_path}/ids", buckets=1)
    assert spark.read.parquet(f"file://{tmp_path}/ids").count() == 3000
    assert max(f.stat().st_size for f in (tmp_path / "ids").rglob("*.parquet")) < 500_000
    assert id_table.lookup(spark, f"file://{tmp_path}/ids", ["pci\\ven_77&x"], buckets=1).first().driver_id == "d"


def test_documents_are_written_by_many_tasks(spark):
    """A few small documents from one task, which are one file each, aren't left to one task."""
    docs = spark.range(40, numPartitions=1).select(F.concat(F.lit("f"), "id").alias("file"), F.lit("{}").alias("value"))
    assert manifests.dealt(docs).rdd.getNumPartitions() == 3
    assert manifests.dealt(docs).count() == 40


def test_second_save_makes_no_parts_again(spark, monkeypatch):
    """Parts are gathered from the line items for the first save alone, and texts of good entries aren't kept."""
    saved, held = [], []
    save, cut = local_store.save, local_store.cut
    monkeypatch.setattr(local_store, "save", lambda s, path, items, *more: saved.append(plan(items)) or save(s, path, items, *more))
    monkeypatch.setattr(local_store, "cut", lambda d, what: held.append(cut(d, what)) or held[-1])
    monkeypatch.setattr(local_store, "release", lambda d: None)
    __spark_entry__.queries()["snk_sqlite_local"](spark, SF).count()
    assert ["l_partkey" in p for p in saved] == [True, False]
    assert all(h.where("(value IS NULL) <> (reason IS NULL)").isEmpty() for h in held)


def test_parts_are_gathered_by_number(spark, monkeypatch):
    """A driver's parts are those of the view, and are gathered where they are numbered, not dealt again by driver_id."""
    c = Catalog(spark, SF)
    lists = c.drivers.join(views.part_lists(c), "pos").select("driver_id", F.inline("parts"))
    every = c.driver_parts.select(lists.columns)
    assert lists.count() == every.count() and lists.exceptAll(every).isEmpty() and [t for _, t in lists.dtypes] == [t for _, t in every.dtypes]
    saved = []
    save = local_store.save
    monkeypatch.setattr(local_store, "save", lambda s, path, items, *more: saved.append(plan(items)) or save(s, path, items, *more))
    __spark_entry__.queries()["snk_sqlite_local"](spark, SF).count()
    assert "Aggregate [driver_id" not in saved[0] and "Aggregate [l_partkey" in saved[0]


def test_executables_are_listed_by_tasks(spark, tmp_path, monkeypatch):
    """A driver plans by the parts of a listing that tasks have made: what it is given grows with their bounded number, not with the files."""
    import pickle

    for i in range(300):
        at = tmp_path / "t" / ("" if i % 3 else f"p{i % 9}/x")
        at.mkdir(parents=True, exist_ok=True)
        (at / f"{'a' * 60}{i}.exe").write_bytes(b"no")
    (tmp_path / "t/p0/y z/none").mkdir(parents=True)
    (tmp_path / "t/p0/y z/ä %41.EXE").write_bytes(b"MZ")
    (tmp_path / "t/p0/read.me").write_bytes(b"")
    monkeypatch.setattr(executables, "PARTS", 5)
    monkeypatch.setattr(executables, "FILES", 10)
    monkeypatch.setattr(executables, "ENTRIES", 7)
    want = sorted((str(f.relative_to(tmp_path / "t")), f.stat().st_size) for f in (tmp_path / "t").rglob("*") if f.suffix.lower() == ".exe")
    files = executables.list_files(spark, f"file://{tmp_path}/t", ".exe")
    assert sorted(map(tuple, files.collect())) == want and len(want) == 301
    planned = executables.Reader(f"file://{tmp_path}/t", files._cut_path).partitions()
    assert len(planned) == 5 and len(pickle.dumps(planned)) < 2000
    got = executables.read_executables(spark, f"file://{tmp_path}/t")
    assert got.rdd.getNumPartitions() == 5 and sorted((r.path, r["size"]) for r in got.collect()) == want
    monkeypatch.setattr(executables, "describe", None)  # in this process alone
    reader = executables.Reader(f"file://{tmp_path}/t", files._cut_path)
    reader.package = "none of them"
    assert [r for p in planned for r in reader.read(p)] == []  # no file of another package is opened
