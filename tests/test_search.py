"""Search: criteria, scores, ladder, routing, on small rows with known answers."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hwcatalog.functions import hwid
from hwcatalog.operators import id_table, paging, search, search_index

SCHEMA = "driver_id string, display_name string, provider string, category string, driver_type string, pack string, version string, arch string, descriptions array<string>, os_targets array<string>, source_manifest string, enabled boolean, date_added string, updated_at string"
ROWS = [
    ("drv-a1b2c3d4e5f6", "AMD Radeon RX 5700 XT", "AMD", "Display", "GPU", "AMD_Radeon_x64", "24.3.1", "x64", ["AMD Radeon RX 5700 XT", "AMD Radeon Graphics"], ["Windows 10/11"], "Display.manifest.json", True, "2024-01-01", "1"),
    ("drv-b1b2c3d4e5f6", "HID Crescendo iCLASS SmartCard", "HID Global", "Security", "Reader", "HID_x64", "1.0.0", "x64", ["Crescendo iCLASS"], ["Windows 10/11"], "Security.manifest.json", True, "2024-01-02", "2"),
    ("drv-c1b2c3d4e5f6", "NVIDIA GeForce RTX 4070", "NVIDIA", "Display", "GPU", "NV_x64", "552.12", "x64", ["GeForce RTX 4070"], ["Windows 10/11"], "Display.manifest.json", True, "2024-01-03", "3"),
    ("drv-d1b2c3d4e5f6", "NVIDIA old", "NVIDIA", "Display", "GPU", "NV_x64", "400.1", "x64", [], [], "Display.manifest.json", False, None, "4"),
]


@pytest.fixture(scope="module")
def drivers(spark):
    return spark.createDataFrame(ROWS, SCHEMA).cache()


def found(drivers, q, **kw):
    return [r.driver_id[4] for r in search.text_search(search.facet_filter(drivers), q, **kw).collect()]


@pytest.mark.parametrize(("q", "want"), [("amd radeon 5700", "a"), ("5700 amd radeon", "a"), ("radoen rx 5700", "a"), ("crescendo iclass", "b"), ("smartcard hid", "b"), ("amd banana", ""), ("4070 nvida", "c"), ("display -nvidia", "a"), ('"smart card"', "b"), ("vendor:nvidia", "c")])
def test_text_search(drivers, q, want):
    assert "".join(found(drivers, q)) == want


def test_reference_candidates_lose_early_typos(drivers):
    assert found(drivers, "radoen", candidates="reference") == [] and found(drivers, "radeno", candidates="reference") == ["a"]


def test_parse_query():
    c = search.parse_query('v6.1 -foo provider:"HID Global" x:y "two words" v6.1 os:win')
    assert [(x.value, x.fields, x.negate, x.phrase) for x in c] == [("6.1", None, False, False), ("foo", None, True, False), ("hid global", ("provider",), False, True), ("x:y", None, False, False), ("two words", None, False, True), ("win", ("os_targets", "source_manifest"), False, False)]
    assert len(search.parse_query(" ".join(map(str, range(20))))) == 8


def osa(a, b):
    d = [[max(i, j) if 0 in (i, j) else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


@settings(max_examples=12, deadline=None)
@given(st.text("abc", min_size=1, max_size=9), st.lists(st.text("abcd", max_size=9), min_size=1, max_size=30))
def test_osa_distance(spark, token, words):
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", search.osa_distance(token, F.col("w")).alias("d"))
    assert all(r.d == osa(token, r.w) for r in df.collect())


def test_ladder_and_modes(spark, drivers):
    h = r"PCI\VEN_10DE&DEV_2684&SUBSYS_408A1043&REV_A1"
    df = spark.createDataFrame([(h,), ("nobus",), ("PCI\\",)], "q string").select(hwid.ladder(F.col("q")).alias("l"), hwid.looks_like_hwid(F.col("q")).alias("h"))
    steps, none, bare = (r.l for r in df.collect())
    assert steps[0] == h and steps[-1] == r"PCI\VEN_10DE" and len(steps) == 4 and none == ["nobus"] and bare == ["PCI\\"]
    ids = spark.createDataFrame([(r"PCI\VEN_10DE&DEV_2684", "drv-c1b2c3d4e5f6", False), (r"pci\ven_10de", "drv-a1b2c3d4e5f6", True), (r"PCI\VEN_1&DEV_9", "drv-d1b2c3d4e5f6", False)], "hwid_string string, driver_id string, is_generic boolean")
    got = search.search(drivers, ids, h).collect()
    assert [(r.driver_id, r.level, r.exact) for r in got] == [("drv-c1b2c3d4e5f6", 2, False)]
    assert search.search(drivers, ids, r"PCI\VEN_1&DEV_9").count() == 0  # the first rung with a match has only a disabled driver
    assert search.search(drivers, ids, r"PCI\VEN_1&DEV_9", enabled_only=False).count() == 1
    assert [r.driver_id for r in search.search(drivers, ids, "DRV-A1B2C3D4").collect()] == ["drv-a1b2c3d4e5f6"]
    assert [r.driver_id[4] for r in search.search(drivers, ids, "  ").collect()] == ["a", "b", "c"]


def test_paging_bounds():
    assert search.page_of(None, None) == (0, 25) and search.page_of(0, 1000) == (0, 100) and search.page_of(3, 40) == (80, 40)


def test_index_finds_what_a_scan_finds(spark, tmp_path):
    """The same rows and scores as a scan, and few rows scored; tokens too short for the index scan all."""
    rng = random.Random(4)
    names = ["AMD Radeon RX 5700 XT", "Blue-tooth Adapter", "HID iClass CrescendO", "GeForce 4070 NVIDIA", "Öko Drucker", "x", "a.b.c"]
    rows = [(f"drv-{i:04}", rng.choice(names) + (f" {rng.randrange(40)}" if i % 3 else ""), rng.choice(["AMD", "Nvidia", "", None]), "Display", "GPU", f"pack_{i % 9}", f"{i % 5}.{i % 7}", "x64", [rng.choice(names), "q"], ["Windows 10/11"], "m.json", i % 4 > 0, None) for i in range(400)]
    columns = "driver_id display_name provider category driver_type pack version arch descriptions os_targets source_manifest enabled date_added".split()
    kinds = ", ".join(f"{c} {'array<string>' if c in search_index.ARRAYS else 'boolean' if c == 'enabled' else 'string'}" for c in columns)
    df = spark.createDataFrame([*rows, (None, *rows[0][1:])], kinds)
    index = search_index.build(df, f"file://{tmp_path}/index")
    for q, few in (("radoen rx 5700", True), ("bluetooth", True), ('"blue tooth"', True), ("crsecendo -amd", True), ("provider:nvidia 4070", True), ("druker", True), ("b.c", True), ("rx", False), ("zzzzzz", True), ('name:"iclass crescendo" pack_3', True)):
        found, scored = search_index.indexed_search(index, q)
        got = [(r.driver_id, round(r.score, 6)) for r in found.collect()]
        want = [(r.driver_id, round(r.score, 6)) for r in search.text_search(df.where("driver_id IS NOT NULL"), q).collect()]
        assert got == want, q
        assert (scored.count() < 400) == few and (got or q in ("zzzzzz", "bluetooth"))


def test_deletions_agree(spark):
    for w in ("a", "ab", "aab", "widget", "öko"):
        got = spark.range(1).select(search_index.deletions(F.lit(w)).alias("d")).first().d
        assert len(got) == len(set(got)) and set(got) == search_index.plain_deletions(w, 2)


def scanned(df):
    """(rows of df, files and rows that its scans read), by the metrics of its plan."""
    rows = df.collect()
    plan, out = df._jdf.queryExecution().executedPlan(), [0, 0]
    leaves = plan.collectLeaves()
    for i in range(leaves.size()):
        m = leaves.apply(i).metrics()
        for k, name in enumerate(("numFiles", "numOutputRows")):
            out[k] += m.apply(name).value() if m.contains(name) else 0
    return rows, *out


def test_stored_ids_prune_files(spark, tmp_path):
    """5,000 drivers and a generic id: a lookup reads a few files and rows, and finds what a scan finds, 300 ids included."""
    rows = [(f"PCI\\VEN_{i % 40:04X}&DEV_{i:04X}", f"drv-{i:05}") for i in range(5000)] + [("pci\\ven_0001", f"drv-{i:05}") for i in range(300)] + [("", "x"), (None, "y"), ("PCI\\VEN_0001", None)]
    hwids = spark.createDataFrame(rows + rows[:50], "hwid_string string, driver_id string")
    path = f"file://{tmp_path}/ids"
    id_table.store(hwids, path)
    good = hwids.where("hwid_string <> '' AND driver_id IS NOT NULL").dropDuplicates()
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found, files, read = scanned(id_table.rows_of(spark, path, ["PCI\\VEN_0003&DEV_002B"]))
        assert [r.driver_id for r in found] == ["drv-00043"] and files <= 8 and read <= 400
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    asked = [f"PCI\\VEN_{i % 40:04X}&DEV_{i:04X}&SUBSYS_7" for i in range(0, 300)] + ["PCI\\VEN_0001&DEV_FFFF", "USB\\VID_1"]
    got = {tuple(r) for r in id_table.lookup(spark, path, asked).collect()}
    want = {tuple(r) for r in search.hwid_lookup(good, spark.createDataFrame([(q,) for q in asked], "query string")).collect()}
    assert got == want and len({r[0] for r in got}) == 301


def test_pages_cost_the_same(spark, tmp_path):
    rng = random.Random(9)
    rows = [(f"d{i:04}", rng.choice(["A", "b", "C", None])) for i in range(1037)]
    df, path = spark.createDataFrame(rng.sample(rows, len(rows)), "driver_id string, name string"), f"file://{tmp_path}/t"
    order = [F.lower("name").asc_nulls_first(), "driver_id"]
    want = [r[0] for r in sorted(rows, key=lambda r: (r[1] is not None, (r[1] or "").lower(), r[0]))]
    whole = paging.pages(df, order, 100).collect()
    assert [r.driver_id for r in sorted(whole, key=lambda r: r.n)] == want and all(r.page == (r.n - 1) // 100 + 1 for r in whole)
    paging.store(df, path, order, per_range=50)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for k in (1, 6, 11):
            got, files, _ = scanned(paging.page(spark, path, k, 100, per_range=50))
            assert [r.driver_id for r in got] == want[100 * k - 100 : 100 * k] and files <= 2
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    seen, cursor = [], 0
    while got := paging.page(spark, path, 0, 300, per_range=50, after=cursor).collect():
        seen, cursor = seen + [r.driver_id for r in got], got[-1].n
    assert seen == want
    assert paging.pages(df.limit(0), order, 10).collect() == []
