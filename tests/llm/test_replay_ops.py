"""Log replay, the conversation trie and shards against plain versions."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hwcatalog.llm import conversation_trie, log_replay, sharding

crc = lambda x: zlib.crc32(x.encode())


# ---- shards


@given(st.integers(1, 5000), st.integers(0, 99))
@settings(max_examples=40, deadline=None)
def test_permutation(n, seed):
    p = sharding.Permutation(n, seed)
    at = p.places(np.arange(n))
    assert sorted(at) == list(range(n)) and (p.rows(at) == np.arange(n)).all()


def test_permutation_of_large_numbers():
    n = 2**61 + 12345
    p, rng = sharding.Permutation(n, 5), np.random.default_rng(1)
    x = rng.integers(0, n, 10_000)
    at = p.places(x)
    assert (p.rows(at) == x).all() and at.max() < n
    assert abs(np.mean(at / n) - 0.5) < 0.02 and abs(np.corrcoef(x / n, at / n)[0, 1]) < 0.05
    for bad in (-1, n):
        with pytest.raises(ValueError, match="not in"):
            p.places([bad])
    with pytest.raises(ValueError, match="below"):
        sharding.Permutation(2**62)


def test_neighbours_part():
    at = sharding.Permutation(100_000).places(np.arange(100_000))
    assert abs(np.corrcoef(at[:-1], at[1:])[0, 1]) < 0.02 and np.bincount(at[:8000] % 8, minlength=8).min() > 900


def test_shards_of_odd_tables(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, rng.choice(["", None, "é😀", "word " * rng.randint(1, 50)]), "mine", 7) for i in range(203)]
    rows += [(None, "lost", "a", 1)] * 40 + [(5, "same", "b", 2)] * 60 + [(5, "other", "c", 3)] + [(900, "long " * 400_000, "d", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string, one int")
    out = sharding.shard_table(df).collect()
    assert len(out) == len(rows)
    assert collections.Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == collections.Counter((d, len((t or "").encode()) + 1, crc(t or "")) for d, t, *_ in rows)
    by = collections.defaultdict(list)
    for r in out:
        by[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert sorted(by) == list(range(8)) and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    again = sharding.shard_table(df.repartition(9).orderBy(F.rand(3))).collect()
    place = lambda rs: sorted((str(r.doc_id), r.text_crc32, r.shard, r.slot) for r in rs)
    assert place(out) == place(again)  # however rows are stored
    assert place(out) != place(sharding.shard_table(df, seed=14).collect())
    assert sharding.shard_table(df.limit(0)).collect() == []
    one = sharding.shard_table(df.where("doc_id = 900")).collect()
    assert [(r.shard, r.slot) for r in one] == [(0, 0)]
    # the whole rows, written shard by shard, and a row found by its place
    sharding.write_shards(df, f"{tmp_path}/s", shards=3, rows_per_file=40)
    files = spark.read.parquet(f"{tmp_path}/s").withColumn("file", F.input_file_name()).collect()
    assert collections.Counter((r.doc_id, r.text, r.one) for r in files) == collections.Counter((d, t, o) for d, t, _, o in rows)
    p = sharding.Permutation(len(rows))
    assert all(p.row_at(r.shard, r.slot, 3)[0] == r.row for r in files)
    spans = collections.defaultdict(list)
    for r in files:
        spans[r.file].append(r.slot)
    assert len(spans) >= 9 and all(max(v) - min(v) == len(v) - 1 for v in spans.values())


# ---- the trie


def plain_trie(rows):
    own = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c in own:
        h = crc(str(c)) % 6
        seq = (*own.get(c - c % 100, [])[:h], *own[c][h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
            leaves[p[:d]] += not kids[p]
    digest = lambda p: hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], digest(p)) for p, m in members.items())


TURNS = "conv_id long, turn long, role string, text string, depth string"


def tries(spark, rows):
    df = spark.createDataFrame([(*r, "mine") for r in rows], TURNS)
    return sorted((tuple(r) for r in conversation_trie.trie(df).collect()), key=lambda r: (r[0], r[1]))


def test_trie(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "RUN", 3)
    rng = random.Random(8)
    rows = []
    for c in [*range(100, 160), 200, 207, 301, 305, 333, *range(1000, 1040)]:
        for t in range(rng.randint(1, 7)):
            rows.append((c, rng.choice([t, None]) if rng.random() < 0.1 else t, rng.choice(["user", "bot"]) if c % 3 else None, rng.choice(["a", "bb", "é😀", "", None, "x" * 400])))
    rows += rng.sample(rows, 20) + [(None, 1, "user", "nobody's")]
    rows += [(400, t, "user", f"turn {t % 7}") for t in range(70)] + [(c, t, "user", f"turn {t % 7}") for c in (401, 402, 417) for t in range(70)]  # long, alike
    got = tries(spark, rows)
    assert got == plain_trie(rows)
    assert any(r[1] > 60 for r in got) and sum(r[4] > 1 for r in got) > 5


def test_trie_light_edges_and_copies(spark):
    """A caterpillar, where each heavy child leaves the least member's line; a large group of copies; one conversation alone."""
    rows = []
    for i in range(12):
        for c in {1000 + 100 * (i + 1) + k for k in range(i + 1)}:
            rows += [(c, t, "u", f"s{t}") for t in range(i)] + [(c, i, "u", f"branch {i}")]
    rows += [(5000 + i, t, "u", "copy") for i in range(99) for t in range(3)]
    assert tries(spark, rows) == plain_trie(rows)
    assert tries(spark, [(7, 1, None, None)]) == plain_trie([(7, 1, None, None)])


def test_trie_of_nothing(spark):
    assert tries(spark, []) == [] and tries(spark, [(None, 1, "a", "b")]) == []


# ---- the log


def plain_replay(log, every=4):
    """log: (lsn, source, kind, key, value) in log order."""
    tx, out, store, commits = collections.defaultdict(lambda: ([], [])), [], {}, 0
    state = lambda: out.append(("state", -(-commits // every), len(store), sum(store.values())))
    for i, s, kind, k, v in log:
        changes, saves = tx[s]
        if kind == log_replay.COMMIT:
            for _, key, value in changes:
                store.pop(key, None)
                if value is not None:
                    store[key] = value
            commits += 1
            if commits % every == 0:
                state()
        elif kind == log_replay.ABORT:
            out += [("abort", d, i, key) for d, key, _ in changes]
        elif kind == log_replay.SAVEPOINT:
            saves.append(len(changes))
        elif kind == log_replay.ROLLBACK:
            n = saves.pop() if saves else 0
            out += [("rollback", d, i, key) for d, key, _ in changes[n:]]
            del changes[n:]
        else:
            changes.append((i, k, v))
        if kind in (log_replay.COMMIT, log_replay.ABORT):
            del tx[s]
    if commits % every:
        state()
    return sorted([*out, *(("abort", d, None, k) for changes, _ in tx.values() for d, k, _ in changes)], key=str)


LOG = "lsn long, source string, kind int, key long, value long, tie long"


@pytest.mark.parametrize("seed,weights", [(1, (6, 1, 1, 1, 1)), (2, (6, 0.02, 0.02, 1, 1)), (3, (4, 0.1, 0, 3, 2)), (4, (4, 0, 0.05, 2, 3)), (5, (1, 8, 0, 0, 0))])
def test_replay(spark, seed, weights):
    rng = random.Random(seed)
    log = []
    for i in range(1500):
        kind = rng.choices(range(5), weights)[0]
        change = kind == log_replay.CHANGE
        log.append((i * 3, rng.choice(["hot"] * 4 + ["b", "", None]), kind, (0 if rng.random() < 0.4 else rng.randrange(20)) if change else None, rng.choice([None, rng.randrange(2**32)]) if change else None))
    df = spark.createDataFrame([(*r, 0) for r in rng.sample(log, len(log))], LOG)
    got = sorted((tuple(r) for r in log_replay.replay(df, parts=9).collect()), key=str)
    assert got == plain_replay(log)
    got = sorted((tuple(r) for r in log_replay.replay(df, every=7, parts=2).collect()), key=str)
    assert got == plain_replay(log, 7)


def test_replay_of_one_long_transaction(spark):
    """One source, nested savepoints, no end but the log's; then the same with a commit."""
    log = [(i, "s", log_replay.SAVEPOINT if i % 2 else log_replay.CHANGE, None if i % 2 else i, None if i % 2 else 1) for i in range(600)]
    log += [(600 + i, "s", log_replay.ROLLBACK, None, None) for i in range(250)]
    for more in ([], [(1000, "s", log_replay.COMMIT, None, None)]):
        df = spark.createDataFrame([(*r, 0) for r in log + more], LOG)
        assert sorted((tuple(r) for r in log_replay.replay(df, parts=8).collect()), key=str) == plain_replay(log + more)


def test_log_of_odd_documents(spark):
    kind = lambda i: min(crc(str(i)) % 23, 7)
    texts = {i: [None, "", "text é😀", "long " * 300_000][i % 3 if i != 50 else 3] for i in range(400)}
    docs = [(i, None if i % 5 == 0 else f"s{i % 2}", t, "mine") for i, t in texts.items()] + [(None, "s1", "no id", "mine")]
    labels = [(i, 0, 1) for i in range(0, 400, 7)] * 2 + [(1, None, None), (None, 1, 1), (2, 1, 0)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string, kind string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    toxic, log = {a for a, _, c in labels if c == 1}, []
    for i, s, t, _ in docs[:-1]:
        h, m = crc(str(i)), kind(i)
        k = h // 100 % 300
        what = [log_replay.COMMIT] * 2 + [log_replay.ABORT] + [log_replay.SAVEPOINT] * 2 + [log_replay.ROLLBACK] * 2 + [log_replay.CHANGE]
        change = m == 7
        log.append((i, s, what[m], k if change else None, crc(f"{k}:{t}") if change and t is not None and i not in toxic else None))
    got = log_replay.log_of(df, lab)
    assert sorted(tuple(r)[:5] for r in got.collect()) == log
    assert sorted((tuple(r) for r in log_replay.replay(got, parts=5).collect()), key=str) == plain_replay(log)
    twice = df.union(df)  # repeated records count each
    assert log_replay.log_of(twice, lab).count() == 800 and log_replay.replay(log_replay.log_of(twice, lab)).where("kind = 'state'").count() == -(-2 * sum(r[2] == log_replay.COMMIT for r in log) // 4)
    assert log_replay.replay(log_replay.log_of(df.limit(0), lab.limit(0))).collect() == []
