"""Scalar functions, load, lineage, INF parsing and files on hand-made rows; and every query against its SQL."""

import math
import random
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from hwcatalog.functions import ids, inf, registered, text, versions
from hwcatalog.operators import aggregates, lineage, load, reconcile, search, shards
from hwcatalog.plans import registry
from hwcatalog.sources import executables, listings, manifests, pe_image

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    ("s", "a", "b", "c"),
    [("10/15/2023, 31.0.101.2111", [31, 0, 101, 2111], [31, 0, 101, 2111], None), ("31.0.101.2111", [31, 0, 101, 2111], [31, 0, 101, 2111], [31, 0, 101, 2111]), ("v2.1.3-beta4", [2, 1, 3, 4], [1, 3], [2, 1, 3]),
     ("10/15/2023", [10, 15, 2023], [], None), ("Release 5 (build 12)", [5, 12], [], [512]), ("", [0], [], [0])],
)
def test_versions(spark, s, a, b, c):
    r = spark.createDataFrame([(s,)], "s string").select(versions.version_digits(F.col("s")).alias("a"), versions.version_pieces(F.col("s")).alias("b"), versions.version_chunks(F.col("s")).alias("c")).first()
    assert r.a == a and r.b == b and (c is None or r.c == c)


def test_version_order_and_dates(spark):
    df = spark.createDataFrame([("1.2", "1.2.0", "1/2/69", "1/2/70"), ("1.10", "1.9", "", "x")], "a string, b string, d string, e string")
    a, b = versions.version_chunks(F.col("a")), versions.version_chunks(F.col("b"))
    got = df.select(versions.compare(a, b), versions.compare_padded(a, b), versions.driver_date(F.col("d")), versions.driver_date(F.col("e")), versions.local_newer(F.col("a"), F.col("d"), F.col("b"), F.col("e"))).collect()
    assert tuple(got[0]) == (-1, 0, (2069, 1, 2), (1970, 1, 2), True) and tuple(got[1]) == (1, 1, None, None, True)


def test_names(spark):
    df = spark.createDataFrame([("NVIDIA Technologies, Inc.", " CON?.txt. ", 1536, 3725)], "p string, f string, n long, s long")
    r = df.select(text.normalize_provider(F.col("p")), text.safe_component(F.col("f")), text.human_size(F.col("n")), text.human_time(F.col("s")), ids.slug(F.col("p"))).first()
    assert tuple(r) == ("nvidia", "CON_.txt", "1.50 KB", "1h 2m 5s", "nvidia-technologies-inc")


def test_upsert_twice_is_once(spark):
    old = spark.createDataFrame([("a", "1", "t0"), ("b", "1", "t0")], "driver_id string, version string, created_at string")
    new = spark.createDataFrame([("b", "2", "t1"), ("c", "2", "t1")], "driver_id string, version string, created_at string")
    once = load.upsert(old, new)
    assert sorted(map(tuple, once.collect())) == [("a", "1", "t0"), ("b", "2", "t0"), ("c", "2", "t1")]
    assert sorted(map(tuple, load.upsert(once, new).collect())) == sorted(map(tuple, once.collect()))


def test_never_shrink():
    load.guard_never_shrink(5, 2, 7)
    with pytest.raises(ValueError):
        load.guard_never_shrink(5, 2, 6)


def test_index_needs_some_source(spark):
    with pytest.raises(ValueError):
        manifests.index_or_listing(None, None, spark.createDataFrame([], "file string"))


def test_supersede_chain(spark):
    schema = "driver_id string, enabled boolean, version string, pos int, category string, arch string, hwids array<string>"
    old = spark.createDataFrame([("o1", True, "1.0", 1, "Net", "x64", ["h"]), ("o2", True, "2.0", 2, "Net", "x64", ["h"])], schema)
    new = spark.createDataFrame([("n1", True, "3.0", 3, "net", "x64", ["h"]), ("n2", True, "2.5", 4, "Net", "x64", ["h"]), ("n3", True, "4.0", 5, "Net", "x64", ["h"]), ("o2", True, "9.0", 6, "Net", "x64", ["h"])], schema)
    got = {r.driver_id: (r.enabled, r.supersedes, r.superseded_by) for r in lineage.supersede(old, new).collect()}
    assert got == {"o1": (True, None, None), "o2": (False, None, "n1"), "n1": (False, "o2", "n3"), "n2": (True, None, None), "n3": (True, "n1", None)}


def test_chains_with_cycles_and_gaps(spark):
    rows = [(f"d{i:03}", f"d{i - 1:03}" if i % 10 else None, f"d{i + 1:03}" if i % 10 != 9 else None) for i in range(60)] + [("x", "missing", None), ("y", None, None)]
    got = {r.driver_id: r.chain for r in lineage.version_chains(spark.createDataFrame(rows, "driver_id string, supersedes string, superseded_by string")).collect()}
    assert all(got[f"d{i:03}"] == f"d{i // 10 * 10:03}" for i in range(60)) and got["x"] == got["missing"] == "missing" and got["y"] == "y"


def test_chain_rounds_shrink(spark, monkeypatch):
    """The links of all rounds together are less than three times those of the table; chains of many lengths, a star, a pair and a loop."""
    rng, want, links = random.Random(8), {}, []
    for size in [2] * 20 + [60] * 20 + [700]:
        ids = [f"c{rng.getrandbits(48):x}" for _ in range(size)]
        want |= dict.fromkeys(ids, min(ids))
        links += zip(ids, ids[1:] + ids[:1] if size == 60 else ids[1:], strict=False)
    want |= {f"s{i}": "s0" for i in range(200)}
    links += [(f"s{i}", "s57") for i in range(200)]
    sizes, cut = [], lineage.cut
    monkeypatch.setattr(lineage, "cut", lambda df, what="cut": sizes.append((what, (out := cut(df, what)).count())) or out)
    rows = [(a, b, None) if i % 2 else (b, None, a) for i, (a, b) in enumerate(links)]
    got = lineage.version_chains(spark.createDataFrame(rows, "driver_id string, supersedes string, superseded_by string")).collect()
    assert {r.driver_id: r.chain for r in got} == want and len(got) == len(want)
    assert sum(n for what, n in sizes if what == "chains") < 3 * len(links)


def test_chain_numbers_that_clash(spark):
    number = lambda seed, c: F.when(seed == 0, F.length(c).cast("long")).otherwise(F.xxhash64(seed, c))
    ids, links = lineage._numbered(spark.createDataFrame([("aa", "b"), ("b", "cc"), ("cc", "b")], "a string, b string"), number)
    of = {r.n: r.id for r in ids.collect()}
    assert sorted(of.values()) == ["aa", "b", "cc"] and {frozenset((of[r.a], of[r.b])) for r in links.collect()} == {frozenset(("aa", "b")), frozenset(("b", "cc"))} and links.count() == 2


def test_uploads_and_pairs_equal_all_pairs(spark):
    """Statuses from one entry an id and class are those of all pairs; versions with zeros, dates that can't be read, blank classes, a generic id."""
    rng = random.Random(6)
    version = lambda: rng.choice(["1.2", "1.2.0", "1.10", "2", "v1.2-b", "", None])
    date = lambda: rng.choice(["1/2/2020", "3/4/21", "x", "", None])
    kind = lambda: rng.choice(["Net", "net", "Network", "Display", "", None, "odd "])
    rows = lambda n, p: [(f"{p}{i}", rng.sample([f"h{k}" for k in range(12)], rng.randint(0, 3)) + (["HOT"] if rng.random() < 0.3 else []) + (["hot"] if rng.random() < 0.1 else []), kind(), version(), date()) for i in range(n)]
    local = spark.createDataFrame(rows(60, "l"), "local_id string, hwids array<string>, category string, version string, driver_date string")
    remote = spark.createDataFrame(rows(40, "r"), "driver_id string, hwids array<string>, category string, version string, driver_date string")
    one = lambda d, p: d.select(*(F.col(c).alias(f"{p}{c}") for c in d.columns), text.normalize_class(F.col("category")).alias(f"{p}cls"), F.transform("hwids", lambda x: F.upper(x)).alias(f"{p}h"))
    pairs = one(local, "l_").crossJoin(one(remote, "r_")).where(F.arrays_overlap("l_h", "r_h") & ((F.coalesce("r_category", F.lit("")) == "") | (F.col("l_cls") == F.col("r_cls"))))
    newer = versions.local_newer(F.col("l_version"), F.col("l_driver_date"), F.col("r_version"), F.col("r_driver_date"))
    want = {r.k: r.n for r in pairs.groupBy(F.col("l_local_id").alias("k")).agg(F.bool_and(newer).alias("n")).collect()}
    got = {r.local_id: r.status for r in reconcile.classify_uploads(local, remote).collect()}
    assert got == {f"l{i}": "missing" if f"l{i}" not in want else "updated" if want[f"l{i}"] else "present" for i in range(60)} and len(set(got.values())) == 3
    mine = [tuple(r) for r in reconcile.class_matches(local, remote).collect()]
    assert len(mine) == len(set(mine)) and set(mine) == {(r[0], r[1]) for r in pairs.select("l_local_id", "r_driver_id").collect()}


def test_folders_equal_a_search(spark):
    rng = random.Random(7)
    folders = [(f"{rng.choice('abc')}.inf{rng.choice(['', '_amd64_1', '_x_2'])}", [f"{rng.choice('ABCDE')}.inf" for _ in range(rng.randint(0, 3))]) for _ in range(15)] + [("other", ["f.INF"])]
    records = [(f"oem{i}", f"{rng.choice('abcdefg')}.INF", rng.choice([None, "", "C:\\own"]) if i % 4 == 0 else None) for i in range(40)]
    got = {(r.published, r.original): (r.folder, r["rank"]) for r in listings.find_folders(spark.createDataFrame(records, "published string, original string, pkg_path string"), spark.createDataFrame(folders, "folder string, files array<string>")).collect()}
    for p, o, own in records:
        hits = [(2, f) for f, _ in folders if f.lower().split(".inf")[0] + ".inf" == o.lower() and ".inf" in f.lower()] + [(3, f) for f, x in folders if o.lower() in map(str.lower, x)]
        best = (1, own) if own else min(hits, default=(None, None))
        assert got[p, o] == (best[1], best[0])


def test_reconcile_steps(spark):
    repo = "driver_id string, pos int, hwids array<string>, arch string, category string, provider string, version string, enabled boolean"
    r = spark.createDataFrame([("r1", 1, ["A", "B"], "x64", "Net", "Acme Inc", "1.0", True), ("r2", 2, ["C", "D", "E"], "x86", "Display", "Beta", "2.0", True), ("r3", 3, ["Z"], "x64", "Audio", "Gamma", "1", False)], repo)
    local = "local_id string, hwids array<string>, arch string, category string, provider string, version string"
    rows = [("l1", ["b", "a "], "x64", "net", "?", "1.0"), ("l2", ["A", "B"], "x64", "x", "?", "2.0"), ("l3", ["A", "B"], "q", "x", "?", "0.5"), ("l4", ["C", "D"], "q", "x", "?", "1"), ("l5", [], "x64", "Net", "ACME corp.", "1"), ("l6", [], "q", "net", "acme", "1"), ("l7", ["Z"], "x64", "Audio", "Delta", "1")]
    got = {x.local_id: (x.driver_id, x.step, x.status) for x in reconcile.reconcile(spark.createDataFrame(rows, local), r).collect()}
    assert got == {"l1": ("r1", 1, "CURRENT"), "l2": ("r1", 2, "OUTDATED"), "l3": ("r1", 3, "CURRENT"), "l4": ("r2", 4, "CURRENT"), "l5": ("r1", 5, "CURRENT"), "l6": ("r1", 6, "CURRENT"), "l7": (None, None, "NEW")}


INF = """[Version]
Class = %ClassName%
Provider=%Mfg% ; comment
DriverVer=10/15/2023, 31.0.1
[Manufacturer]
%Mfg%=M,NTamd64
; NT6.1 NT10.0 NT6.1 NTx86 NTamd64
[M.NTamd64]
%d1% = Inst, PCI\\VEN_10DE&DEV_2684,USB\\VID_12&PID_1
%D1%=Inst2,PCI\\VEN_10DE&DEV_2684
%unknown%=Inst3, ACPI\\PNP0A08
[Strings]
ClassName="Display"
Mfg="ACME" ; x
d1="Card One"
"""


def test_inf(spark):
    r = inf.parse_inf(spark.createDataFrame([(INF,), ("",), (None,)], "text string")).collect()
    assert len(r) == 1
    r = r[0]
    assert (r.version, r.category, r.provider, r.arch) == ("31.0.1", "Display", "ACME", "x64")
    assert r.os_targets == ["Windows 7", "Windows 10/11"] and r.hwids == ["ACPI\\PNP0A08", "PCI\\VEN_10DE&DEV_2684"] and r.compatible_ids == ["ACPI\\PNP0A08"]
    assert r.descriptions == ["ACME", "Card One", "%unknown%"]  # a manufacturer line with a decoration reads as a device line


def test_inf_sections_in_linear_time(spark):
    """Thousands of sections cost a few times as much as hundreds; odd headers, spaces before them, and none at all."""
    made = lambda k: "[Version]\nClass=%c%\n" + "".join(f"[s{i}]\nk{i}=v{i}\n" for i in range(k)) + " \t[sTrings] ; x\r\nc = \"Net\"\n d=2\n[After]\nc=no\n"
    took = []
    for k in (300, 300, 6000):
        began = time.time()
        r = inf.parse_inf(spark.createDataFrame([(made(k),)] * 4, "text string")).collect()
        took.append(time.time() - began)
        assert [x.category for x in r] == ["Net"] * 4
    assert took[2] < 20 * took[1] + 5
    texts = ["[Strings]", "[strings]\na=b", "x=1\n[Other]\na=1", "[Strings]\n[Strings]\na=2", "[STRINGS]extra\na=İ\nb=\"q;\" ; c"]
    got = [[(e.k, e.v) for e in x.s] for x in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", inf.strings(F.col("t")).alias("s")).orderBy("i").collect()]
    assert got == [[], [("A", "b")], [], [], [("A", "İ"), ("B", "q;")]]


def test_shards_hold_their_limit(spark):
    rows = [("c", i, 100 + i % 7 * 30) for i in range(200)] + [("c", 200, 5000), ("d", 0, 1)]
    got = shards.pack(spark.createDataFrame(rows, "category string, pos long, bytes long"), limit=1000, overhead=100).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.category, r.pos)):
        by.setdefault((r.category, r.shard), []).append(r.bytes)
    assert len(got) == len(rows) and all(sum(b) + len(b) + 100 <= 1000 or len(b) == 1 for b in by.values())


def test_votes(spark):
    rows = [(1, "NoClass", ["USB\\A", "PCI\\B", "HID\\C", "PCI\\D"], []), (2, "x", ["USB\\A", "PCI\\B"], []), (3, " NET ", [], []), (4, None, None, None), (5, "x", ["USB\\A", "PCI\\B"], ["PCI\\B"])]
    got = {r.k: r.driver_type for r in aggregates.driver_type(spark.createDataFrame(rows, "k int, category string, hwids array<string>, compatible_ids array<string>"), "k").collect()}
    assert got == {1: "Chipset", 2: "USB", 3: "Net", 4: "Other", 5: "Chipset"}


def test_human_size_ties_go_to_even(spark):
    sizes = [0, 1023, 1024, 1152, 1157, 1029, 5 * 2**20 + 5243, 3 * 2**30, 2**40 * 7, 2**50 * 9]
    got = [r.s for r in spark.createDataFrame([(n,) for n in sizes], "n long").select(text.human_size(F.col("n")).alias("s")).collect()]

    def plain(n):
        for i, unit in enumerate(["B", "KB", "MB", "GB", "TB"]):
            if n < 1024 ** (i + 1):
                return f"{n} B" if i == 0 else f"{n / 1024**i:.2f} {unit}"
        return f"{n / 1024**5:.2f} PB"

    assert got == [plain(n) for n in sizes] and got[3] == "1.12 KB"


def test_overlaps_equal_all_pairs(spark):
    rng = random.Random(3)
    sets = {i: sorted({min(int(rng.expovariate(0.15)), 60) for _ in range(rng.randint(1, 9))}) for i in range(150)}
    df = spark.createDataFrame([(i, [f"h{x}" for x in s]) for i, s in sets.items()], "id int, hwids array<string>")
    for least in (0.2, 0.5, 0.8):
        share = lambda a, b: len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b]))
        want = {(a, b) for a in sets for b in sets if share(a, b) >= least}
        assert {(r.a_id, r.b_id) for r in reconcile.overlaps(df, df, least).collect()} == want
        rep = {i: min(j for j in sets if sets[j] == sets[i]) for i in sets}
        mine = {(a, b) for a, b in want if a < b and rep[a] == a and rep[b] == b} | {(rep[i], i) for i in sets if rep[i] != i}
        assert {(r.a_id, r.b_id) for r in reconcile.self_overlaps(df, least).collect()} == mine


def test_chunks_equal_a_plain_loop(spark):
    rng = random.Random(4)
    rows = [(f"m{i % 3}", i, rng.randint(1, 9), rng.randint(50, 900)) for i in range(200)]
    got = {r.pos: r.chunk for r in load.chunks(spark.createDataFrame(rows, "source_manifest string, pos long, n int, bytes int"), 50, 4000).collect()}
    for m in ("m0", "m1", "m2"):
        chunk = n = b = 0
        for _, pos, k, size in sorted(r for r in rows if r[0] == m):
            if n and (n + k >= 50 or b + size >= 4000):
                chunk, n, b = chunk + 1, 0, 0
            n, b = n + k, b + size
            assert got[pos] == chunk


def test_statements_make_the_store(spark):
    import sqlite3

    drivers = spark.createDataFrame([("d1", "O'Neil", ["a", "b's"], True), ("d2", None, [], False)], "driver_id string, provider string, descriptions array<string>, enabled boolean").withColumn("source_manifest", F.lit("m"))
    hwids = spark.createDataFrame([("PCI\\A", "d1", True), ("PCI\\A&B", "d1", False)], "hwid_string string, driver_id string, is_generic boolean")
    parts = spark.createDataFrame([("d2", 1, "f", 5, None, "u")], "driver_id string, part_num int, filename string, size_bytes long, sha256 string, url string")
    con = sqlite3.connect(":memory:")
    con.execute(f"CREATE TABLE Drivers ({', '.join(load.DRIVER_COLUMNS)}, created_at DEFAULT 'then', UNIQUE (driver_id))")
    con.execute("CREATE TABLE HWIDs (hwid_string, driver_id, is_generic, UNIQUE (hwid_string, driver_id))")
    con.execute("CREATE TABLE DriverParts (driver_id, part_num, filename, size_bytes, sha256, url, UNIQUE (driver_id, part_num))")
    for _ in range(2):  # a second time changes nothing
        for r in load.chunk_texts(load.statements(drivers, hwids, parts), 4, 10_000).orderBy("chunk").collect():
            con.executescript(r.value)
    assert con.execute("SELECT driver_id, provider, descriptions, enabled, notes, created_at FROM Drivers ORDER BY 1").fetchall() == [("d1", "O'Neil", '["a","b\'s"]', 1, None, "then"), ("d2", None, "[]", 0, None, "then")]
    assert con.execute("SELECT * FROM HWIDs ORDER BY 1").fetchall() == [("PCI\\A", "d1", 1), ("PCI\\A&B", "d1", 0)]
    assert con.execute("SELECT * FROM DriverParts").fetchall() == [("d2", 1, "f", 5, None, "u")]


def test_registered_functions(spark):
    registered.register(spark)
    r = spark.sql(r"SELECT osa_distance('crescendo', 'crsecendo') AS a, osa_distance('ca', 'abc') AS b, version_key('10/15/2023, 31.0-x.2') AS v, hwid_ladder('PCI\\VEN_1&DEV_2&&REV_3') AS l, osa_distance(NULL, 'a') AS n").first()
    assert (r.a, r.b, r.v, r.n) == (1, 3, [31, 0, 2], None) and r.l == ["PCI\\VEN_1&DEV_2&REV_3", "PCI\\VEN_1&DEV_2", "PCI\\VEN_1"]
    words = ["geforce", "gefroce", "radeon", "", "g", "wigdet"]
    df = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string")
    for t in ("geforce", "widget"):
        same = df.select("b", search.osa_distance(t, F.col("b")).alias("x"), F.call_function("osa_distance", F.lit(t), F.col("b")).alias("y")).collect()
        assert all(r.x == r.y for r in same if r.b)


def test_ranks_are_one_order(spark):
    rows = [(f"d{i:03}", float(i % 7), None if i % 5 == 0 else f"20{i % 20:02}") for i in range(200)]
    got = search.ranked(spark.createDataFrame(rows, "driver_id string, score double, date_added string")).collect()
    want = sorted(rows, key=lambda r: (-r[1], r[2] is None, "".join(chr(255 - ord(c)) for c in r[2] or ""), r[0]))
    assert [r.driver_id for r in sorted(got, key=lambda r: r.rank)] == [w[0] for w in want] and sorted(r.rank for r in got) == list(range(1, 201))


def normal(v):
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        v = float(v)
        return int(v) if math.isfinite(v) and v == int(v) else round(v, 9)
    return v if v is None or isinstance(v, bool | int) else str(v)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_sql(spark, name):
    out = registry.queries()[name](spark, SF)
    rows = out.collect()
    assert rows
    sql = registry.oracle_sql().get(name)
    if sql is None:
        return
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events documents pages".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(sql)
    names = sorted(out.columns)
    assert names == sorted(want.columns)
    at = {c: i for i, c in enumerate(want.columns)}
    mine = sorted(([normal(r[c]) for c in names] for r in rows), key=repr)
    theirs = sorted(([normal(r[at[c]]) for c in names] for r in want.fetchall()), key=repr)
    assert mine == theirs


def test_file_sources_read_all_drivers(spark):
    n = spark.read.parquet(f"{SF}/part.parquet").count()
    assert registry.queries()["src_inf_files"](spark, SF).count() == n
    exes = registry.queries()["src_pe_files"](spark, SF)
    assert exes.count() == n and len({r.type for r in exes.collect()}) == 8


def test_executables_cut_short_or_hostile():
    whole = pe_image.sample((31, 0, 101, 2111), {"CompanyName": "Acme GmbH é", "FileDescription": "Setup", "Other": "x"}, b"icon" * 100)
    assert pe_image.metadata(whole)[:4] == ("31.0.101.2111", "31.0.101.2111", "Acme GmbH é", "Setup")
    assert pe_image.metadata(whole.replace("Setup".encode("utf-16-le"), "S\0\0\0\0".encode("utf-16-le")))[3] == ""  # too short a name
    # the same bytes outside of the resource tree say nothing
    assert pe_image.metadata(b"MZ" + b"\0" * 100 + whole[200:]) == ("",) * 5
    rng = random.Random(2)
    for n in range(0, len(whole), 7):
        pe_image.metadata(whole[:n])
    for _ in range(500):
        b = bytearray(whole)
        for _ in range(rng.randint(1, 6)):
            b[rng.randrange(len(b))] = rng.randrange(256)
        pe_image.metadata(bytes(b))
    loop = bytearray(whole)
    root = whole.index(b".rsrc") + 40
    loop[root + 16 + 4 : root + 16 + 8] = (0x80000000).to_bytes(4, "little")  # a directory that is its own child
    assert pe_image.metadata(bytes(loop))[4] == ""


def test_executables_are_read_by_offset(spark, tmp_path):
    """Files of 50 MB, one with its resources at the end, cost less than 1 MB; all else as from the whole bytes; hostile and broken files have rows too."""
    small = pe_image.sample((31, 0, 101, 2111), {"CompanyName": "Acme GmbH é", "FileDescription": "Setup"}, b"icon" * 100)
    start = int.from_bytes(small[small.index(b".rsrc") + 20 : small.index(b".rsrc") + 24], "little")
    moved = bytearray(small[:start] + b"\0" * 50_000_000 + small[start:])
    at = small.index(b".rsrc") + 20
    moved[at : at + 4] = (start + 50_000_000).to_bytes(4, "little")
    files = {"a/b/large.exe": small + b"WiX Burn" + b"x" * 50_000_000, "a/moved.EXE": bytes(moved), "top.exe": small, "a/text.exe": b"not one" * 20, "a/empty.exe": b"", "c/short.exe": small[:300], "c/readme.txt": b"MZ"}
    rng = random.Random(3)
    for i in range(40):
        hostile = bytearray(small)
        for _ in range(4):
            hostile[rng.randrange(len(small))] = rng.randrange(256)
        files[f"h/{i}.exe"] = bytes(hostile)
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    df = executables.read_executables(spark, f"file://{tmp_path}")
    got = {r.path: r for r in df.collect()}
    assert set(got) == {n for n in files if n.lower().endswith(".exe")}
    for name, r in got.items():
        whole = files[name]
        assert r["size"] == len(whole) and r.package == name.split("/")[0]
        want = pe_image.metadata(whole) if whole[:2] == b"MZ" and len(whole) >= 64 else ("",) * 5
        assert (r.file_version, r.product_version, r.company, r.description, r.icon_sha256) == want
        assert r.bytes_read <= min(len(whole), 1_000_000)
    assert got["a/moved.EXE"].company == "Acme GmbH é" and got["a/b/large.exe"].type == "WiX-Bootstrapper" and got["a/text.exe"].type == "not-pe"
    assert max(got[n].bytes_read for n in ("a/b/large.exe", "a/moved.EXE")) < 200_000
    one = df.where("package = 'c'")
    assert [r.path for r in one.collect()] == ["c/short.exe"] and [r.path for r in df.where("package = 'top.exe'").collect()] == ["top.exe"]
    (tmp_path / "none").mkdir()
    assert executables.read_executables(spark, f"file://{tmp_path}/none").collect() == []


def test_pages_are_read_to_a_short_one(spark):
    rows = spark.range(57).select(F.col("id").alias("n"))
    asked = []

    def fetch(page, size):
        asked.append(page)
        return rows.orderBy("n").offset((page - 1) * size).limit(size)

    got = search.read_pages(fetch, 20).collect()
    assert sorted(r.n for r in got) == list(range(57)) and asked == [1, 2, 3] and {r.page for r in got} == {1, 2, 3}
