"""MinHash near-dedup and line dedup against brute force, and their edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from hwcatalog.llm import common, line_dedup, minhash_dedup

SCHEMA = "doc_id long, text string"


def shingles(text, width):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def components(docs, width, percent):
    sets = {i: shingles(t, width) for i, t in docs}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = list(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    base = [" ".join(word() for _ in range(rng.randint(6, 120))) for _ in range(40)]
    docs = []
    for i in range(160):
        w = rng.choice(base[:8] if i % 3 == 0 else base).split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            w[rng.randrange(len(w))] = word()
        docs.append((i * 3, " ".join(w).upper() if i % 5 == 0 else "\n".join(w)))
    return docs + [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "One"), (1004, "one"), (1005, "two words")]


@pytest.mark.parametrize("block", [4, 512])
def test_minhash_equals_brute_force(spark, block):
    docs = corpus()
    df = spark.createDataFrame(docs, SCHEMA).withColumn("comp", F.lit("clash")).withColumn("set_id", F.lit(1))
    out = minhash_dedup.near_duplicates(df, width=4, groups=10, block=block).collect()
    want = components(docs, 4, 80)
    assert len(out) == len(docs)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_minhash_joins_twins_that_no_pivot_joins(spark):
    # a notice, the same with one more word, and many pages that begin with the notice: near-twins differ from all pivots
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    docs = []
    for g in range(4):
        notice = [word() for _ in range(30)]
        base = g * 1000
        docs += [(base + 1 + i, " ".join([*notice, *(word() for _ in range(9))])) for i in range(150)]
        docs += [(base + 602, " ".join(notice)), (base + 603, " ".join([*notice, word()]))]
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(spark.createDataFrame(docs, SCHEMA), width=4).collect()}
    want = {i: c for i, (_, c) in components(docs, 4, 80).items()}
    assert got == want and all(got[g * 1000 + 603] == g * 1000 + 602 for g in range(4))


def test_long_texts_have_the_same_shingles():
    import numpy as np

    rng = random.Random(6)
    data = bytearray()
    while len(data) < 200_000:
        data += bytes(rng.choices(b"abc xyzABC\n", k=1000)) + b" " * rng.choice([0, 0, 70]) + b"w" * rng.choice([0, 9, 9000])
    data = np.frombuffer(bytes(data), np.uint8)
    whole, _ = common.word_hashes(data, np.array([len(data)]))
    assert (common.long_word_hashes(data, 777) == whole).all() and len(whole) == len(bytes(data).split())


def test_minhash_edges(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (7, "A B C D E F")]
    out = sorted((str(r.doc_id), r.component_id, r.kept) for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA), width=4).collect())
    assert out == [("5", 5, True), ("5", 5, True), ("7", 5, False), ("None", None, True)]
    assert minhash_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    mine = spark.createDataFrame(rows, SCHEMA)
    for c in ("gone", "_gone", "kept", "set_id", "alt", "component_id"):  # names used within
        mine = mine.withColumn(c, F.lit("mine"))
    kept = minhash_dedup.keep_first(mine)
    assert kept.columns == mine.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["5", "5", "None"]


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        nxt = [i + 1]
        for j, y in enumerate(b):
            nxt.append(min(row[j] + (x != y), row[j + 1] + 1, nxt[j] + 1))
        row = nxt
    return row[-1]


@pytest.mark.parametrize("k", [1, 2, 3])
def test_banded_distance(spark, k):
    rng = random.Random(k)
    rows = []
    for _ in range(300):
        a = [rng.choice("abcdé😀 ") for _ in range(rng.randint(8, 40))]
        b = list(a)
        for _ in range(rng.randint(0, 5)):
            at = rng.randrange(len(b))
            b[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "é"])
        rows.append(("".join(a), "".join(b)))
    df = spark.createDataFrame(rows, "a string, b string").select(F.expr(line_dedup.banded_distance("a", "b", k)).alias("d"), F.expr(line_dedup.near("a", "b", k)).alias("n"))
    for (a, b), r in zip(rows, df.collect(), strict=True):
        assert min(r.d, k + 1) == min(lev(a, b), k + 1)
        assert r.n == (lev(a, b) <= k)


@pytest.mark.parametrize(("block", "split"), [(512, 8192), (3, 4)])
def test_lines_equal_brute_force(spark, monkeypatch, block, split):
    rng = random.Random(9)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 9))) for _ in range(30)]
    # many lines with a third of their text in common, few of them near each other
    base += ["the same beginning of all of these lines " + "".join(rng.choice("abcé") for _ in range(40)) for _ in range(25)]
    docs = []
    for d in range(80):
        lines = []
        for _ in range(rng.randint(0, 8)):
            s = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                at = rng.randrange(len(s))
                s[at : at + rng.randint(0, 1)] = rng.choice("xyz")
            lines.append("  " * rng.randint(0, 1) + "".join(s))
        docs.append((d, "\n".join(lines)))
    monkeypatch.setattr(line_dedup.line_links, "__defaults__", (block, split, 2))
    got = {r.doc_id: (r.text, r.n_dropped) for r in line_dedup.drop_lines(spark.createDataFrame(docs, SCHEMA)).collect()}
    occ = [(d, i, x.strip()) for d, t in docs for i, x in enumerate(t.split("\n")) if x.strip()]
    names = sorted({x for *_, x in occ})
    up = {x: x for x in names}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(names):
        for b in names[:i]:
            if min(len(a), len(b)) >= 20 and abs(len(a) - len(b)) <= 2 and lev(a, b) <= 2:
                up[find(a)] = find(b)
    seen, gone = set(), {}
    for d, i, x in occ:
        if find(x) in seen:
            gone.setdefault(d, set()).add(i)
        seen.add(find(x))
    for d, t in docs:
        want = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(d, ()))
        assert got[d] == (want, len(gone.get(d, ())))


def test_line_edges(spark):
    long_ = "the same line of some length, which all have"
    rows = [(1, long_), (1, long_), (2, f"short\n{long_}\n\nshort\n"), (None, long_), (3, None), (4, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("dropped", "_dropped", "_did", "_h", "h", "pos", "line", "name", "lid", "n_lines"):  # names used within
        df = df.withColumn(c, F.lit("mine"))
    out = line_dedup.drop_lines(df)
    assert out.columns == [*(c for c in df.columns if c != "n_lines"), "n_lines", "n_dropped"]
    got = out.collect()
    assert all(r.dropped == r._did == r.pos == "mine" for r in got)
    want = [("1", long_, 1, 0), ("1", long_, 1, 0), ("2", "short\n\n", 5, 2), ("None", "", 1, 1), ("3", None, 0, 0), ("4", "", 1, 0)]
    assert sorted((str(r.doc_id), r.text or "", r.text is None, r.n_lines, r.n_dropped) for r in got) == sorted((a, b or "", b is None, c, d) for a, b, c, d in want)
    assert line_dedup.drop_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_common_lines_and_long_texts(spark):
    rows = [(i, f"the line that every one of the documents has\nline number {i * 977} of its own {i * 31} kind {i}") for i in range(300)]
    rows.append((1000, "\n".join(f"{i * 7919 % 100003} is said in {i} ways by {i * 31}" for i in range(3000)) + "\nthe line that every one of the documents had"))
    got = {r.doc_id: r for r in line_dedup.drop_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[0].n_dropped == 0 and all(got[i].text.startswith("line number") for i in range(1, 300))
    assert not got[1000].text.endswith("had") and got[1000].n_lines == 3001


def test_near_short_lines_go(spark):
    a, b, c = "... that he thought to of nd in table.", "... that he thought to of nd intable", "some twenty characters"
    rows = [(1, f"{a}\n{c}\nYes."), (2, f"{b}\nLes.\nnot near any of the lines here"), (3, f"{c[:-1]}z"), (4, "Les.")]
    got = {r.doc_id: r.text for r in line_dedup.drop_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: rows[0][1], 2: "Les.\nnot near any of the lines here", 3: "", 4: ""}


def test_parities_lose_no_pair():
    import numpy as np

    rng = np.random.default_rng(3)
    for n in (1, 7, 60, 3000):
        x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        y = np.unique(np.concatenate([x[: len(x) * 4 // 5 + 1], rng.integers(0, 2**63, n // 5 + 1, dtype=np.uint64)]))
        bits = sum(int(a ^ b).bit_count() for a, b in zip(minhash_dedup.parities(x), minhash_dedup.parities(y), strict=True))
        assert bits <= len(np.setxor1d(x, y)) and (bits > 0 or n == 1)
