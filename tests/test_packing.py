"""Scans and exact packing against plain loops."""

import json
import random
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from hwcatalog.operators import packing, shards
from hwcatalog.operators.scans import scan
from hwcatalog.sources import manifests


@pytest.mark.parametrize("segments", [1, 3, 200])
def test_scan(spark, segments):
    rng = random.Random(segments)
    rows = [(rng.randrange(segments), i, rng.randint(-9, 9) if rng.random() < 0.8 else None, i if rng.random() < 0.02 else None) for i in range(3000)]
    shuffled = rng.sample(rows, len(rows))
    df = spark.createDataFrame(shuffled, "s long, part long, x long, y long")  # part: a name used within
    out = scan(df, ["s"], ["part"], {"total": ("sum", "x"), "odd": ("xor", "x"), "seen": ("last", "y")}, parts=11)
    want, state = set(), {}
    for s, i, x, y in rows:
        a, b, c = state.get(s, (0, 0, None))
        state[s] = a + (x or 0), b ^ (x or 0), c if y is None else y
        want.add((s, i, x, y, *state[s]))
    assert set(map(tuple, out.collect())) == want
    whole = scan(df, [], ["part"], {"n": ("sum", "one")}, parts=7) if "one" in df.columns else scan(df.withColumn("one", F.lit(1)), [], ["part"], {"n": ("sum", "one")}, parts=7)
    assert sorted((r.part, r.n) for r in whole.collect()) == [(i, i + 1) for i in range(3000)]
    assert scan(df.limit(0), ["s"], ["part"], {"total": ("sum", "x")}).collect() == []


def plain_bins(sizes, caps):
    """sizes: tuples; a bin number for each."""
    out, held, b = [], [0] * len(caps), -1
    for s in sizes:
        if b < 0 or any(h + x > c for h, x, c in zip(held, s, caps, strict=True)):
            b, held = b + 1, [0] * len(caps)
        held = [h + x for h, x in zip(held, s, strict=True)]
        out.append(b)
    return out


@pytest.mark.parametrize(("block", "most", "caps"), [(7, 9, (30, 200)), (50, 400, (60, 300)), (16, 3, (1000, 900)), (1000, 9, (5, 5))])
def test_bins_equal_a_loop(spark, block, most, caps):
    rng = random.Random(block)
    groups = {g: [(rng.choice([0, 1, rng.randint(0, most), most * 40 if rng.random() < 0.02 else 1]), rng.randint(0, 2 * most)) for _ in range(n)] for g, n in (("a", 900), ("", 30), (None, 45), ("one", 1))}
    rows = [(g, i, *s, "kept") for g, x in groups.items() for i, s in enumerate(x)]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "cat string, at long, n int, b long, idx string")
    got = packing.greedy_bins(df, "cat", ["at"], {"n": caps[0], "b": caps[1]}, block=block)
    assert got.columns == [*df.columns, "bin"]
    mine = {(r.cat, r.at): r.bin for r in got.collect()}
    assert len(mine) == len(rows)
    for g, x in groups.items():
        assert [mine[g, i] for i in range(len(x))] == plain_bins(x, caps)


def test_bins_of_nothing_and_nulls(spark):
    df = spark.createDataFrame([("a", None, None), ("a", None, 3), ("a", 1, 3)], "cat string, at long, n long")
    assert sorted(r.bin for r in packing.greedy_bins(df, "cat", ["at"], {"n": 4}).collect()) == [0, 0, 1]
    assert packing.greedy_bins(df.limit(0), "cat", ["at"], {"n": 4}).collect() == []


def test_one_large_category(spark):
    """A million entries of one category: as the loop packs them, and no task holds more than a block."""
    n = 1_000_000
    df = spark.range(n).select(F.lit("c").alias("category"), F.col("id").alias("pos"), (F.pmod(F.xxhash64("id"), F.lit(2000)) + 1).alias("bytes"))
    got = shards.pack(df, limit=1_000_000, overhead=500).groupBy("shard").agg(F.min("pos").alias("a"), F.max("pos").alias("b"), F.sum("bytes").alias("s"), F.count("*").alias("k")).orderBy("shard").collect()
    sizes = [r.bytes for r in df.select("bytes").collect()]
    want, held = [0], 500
    for i, s in enumerate(sizes):
        if held > 500 and held + s + 1 > 1_000_000:
            want.append(i)
            held = 500
        held += s + 1
    assert [r.a for r in got] == want and [r.shard for r in got] == list(range(1, len(want) + 1)) and all(r.k == r.b - r.a + 1 for r in got)
    assert packing.BLOCK * 10 <= n  # so it took many blocks


def stored_files(root):
    return {p.parent.name.split("=", 1)[1]: p.read_bytes() for p in root.glob("file=*/*.txt")}


def test_saves_leave_sealed_shards(spark, tmp_path):
    """Three saves in a row: every byte of sealed shards stays, sizes hold as written, nothing is lost and the order is kept."""
    rng, root = random.Random(5), tmp_path / "m"
    entry = lambda i, extra=0: json.dumps({"id": f"d{i}", "text": "é" * (rng.randint(1, 60) + extra)}, ensure_ascii=False, separators=(",", ":"))
    split, want, before = 1500, {"Net": [], "\"Q\" x": []}, {}
    for turn in range(4):
        rows = [(c, i, f"d{i}", entry(i)) for c in want for i in range(40 * turn, 40 * turn + (40 if c == "Net" else 3))]
        rows += [("Net", 39.5 + 40 * turn, "dbig", entry("big", 900))] if turn == 1 else []
        for c, _, i, e in sorted(rows, key=lambda r: r[1]):
            want[c].append((i, e))
        docs = manifests.read_documents(spark, str(root)) if turn else spark.createDataFrame([], "file string, value string")
        history = spark.createDataFrame([("Net", json.dumps({"p": [{"id": "h" * (1400 if turn == 2 else 20)}]}, separators=(",", ":")))], "category string, history string")
        out = shards.save(docs, spark.createDataFrame([(c, int(2 * p), i, e) for c, p, i, e in rows], "category string, pos long, id string, entry string"), history, f"day {turn}", split).cache()
        states = {r.file: r.state for r in out.collect()}
        manifests.rewrite_documents(out, str(root))
        files = stored_files(root)
        for f, data in before.items():
            if unquote(f) not in states:
                assert files[f] == data  # sealed shards, byte for byte
        before = files
        for c, entries in want.items():
            mine = sorted(((int(f.rsplit(".", 2)[1]) if f.rsplit(".", 2)[1].isdigit() else 1, f) for f in (unquote(x) for x in files) if f.startswith(c)), key=lambda x: x[0])
            got = [json.loads(files[next(x for x in files if unquote(x) == f)]) for _, f in mine]
            assert [d["shard_index"] for d in got] == list(range(1, len(got) + 1))
            assert [(x["id"], x) for d in got for x in d["drivers"]] == [(i, json.loads(e)) for i, e in entries]
            for d, follows in zip(got, got[1:], strict=False):
                assert d["next_shard"] == f"{c}.manifest.{follows['shard_index']}.json" and d["note"].endswith(d["next_shard"])
            assert "note" not in got[-1] and got[-1]["total_shards"] == len(got) and all(d["category"] == c for d in got)
            assert (got[-1]["version_history"] != {}) == (c == "Net")
        assert all(len(data) <= split or data.count(b'"id":"d') <= 1 for data in files.values())
        assert {s for f, s in states.items() if f.startswith("Net")} == ({"new"} if turn == 0 else {"sealed", "new"})
        assert len([f for f in files if "Q" in f]) == 1 and (turn == 0 or "grown" in states.values())
    assert len(before) > 8
