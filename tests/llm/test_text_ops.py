"""Quality rules, BPE, token counts, fingerprints and mixing against plain versions."""

import base64
import collections
import hashlib
import random
import re

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hwcatalog.llm import bpe, fingerprints, mixing, quality_rules, token_counts

PATH = P.path("byte_bpe_50k.tiktoken")
SCHEMA = "doc_id long, source string, text string"


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bpe.TextEncoder(PATH, P.PATTERN)


# ---- quality rules


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines, seen = 0, set()
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), lines, len(hit)


def quality_docs():
    rng = random.Random(1)
    docs = [(i, f"s{i % 3}", " ".join(rng.choice(["a", "bb", "é", "😀", "a\nb", "x\u2003y"]) + (str(rng.randint(0, 999)) if i % 4 else "#") for _ in range(rng.randint(0, 200)))) for i in range(40)]
    docs += [(100 + i, "junk", "too short") for i in range(60)] + [(300, "junk", " ".join(map(str, range(80))))]
    return docs + [(200, None, None), (201, "s0", ""), (202, "s0", "a b c d"), (202, "s0", "a b c d"), (None, "s1", "x " * 60)]


def test_quality_counts_and_hosts(spark):
    docs = quality_docs()
    df = spark.createDataFrame(docs, SCHEMA).withColumn("n_words", F.lit(-1)).withColumn("kept", F.lit("x"))
    for c in ("host", "_host", "_rejected", "_counts", "rejected"):  # names used within
        df = df.withColumn(c, F.lit("mine"))
    out = quality_rules.judge(df).collect()
    assert {(r["host"], r["_host"], r["_rejected"]) for r in out} == {("mine",) * 3}
    assert len(out) == len(docs)
    for r in out:
        n, chars, symbols, dup, rep = counts(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep)
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n)
        assert r.kept == (not r.base_failed and r.host_rate <= 0.8)
    assert next(r for r in out if r.doc_id == 300).kept is False  # a good document of a host that fails nearly always
    assert any(r.kept for r in out)
    assert quality_rules.judge(spark.createDataFrame([], SCHEMA)).count() == 0


def test_host_rates_shrink(spark):
    rows = [("big", i < 90) for i in range(100)] + [("one", True)] + [(f"h{i}", i % 5 == 0) for i in range(40) for _ in range(5)]
    got = {r.host: r for r in quality_rules.host_verdicts(spark.createDataFrame(rows, "source string, rule_failed boolean")).collect()}
    assert got["big"].rejected and not got["one"].rejected and 0.1 < got["one"].rate < 1


def test_keep_good_leaves_clean_documents(spark):
    clean = [(i, f"s{i % 4}", " ".join(f"w{i}x{k}" for k in range(70))) for i in range(30)]
    kept = quality_rules.keep_good(spark.createDataFrame(clean + [(99, "s1", "short")], SCHEMA))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(30)) and kept.columns == ["doc_id", "source", "text"]


# ---- BPE


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abcdeEnti 's'tllve 12  \n\t\r\x1c\x1d\x85\xa0\u2003\u200b\u3000é日本ß😀.,!?<|>#_")), max_size=60))
def test_bpe_equals_reference(reference, encoder, text):
    ids = encoder.encode(text)
    assert ids == reference.encode_ordinary(text) and encoder.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["a \0b", "\0a \0b \0", "a \0", "\0", "b \0\0c d", "ab \0ab"])
def test_bpe_keeps_nul(reference, encoder, text):
    for _ in range(2):  # new cuts and remembered ones
        ids = encoder.encode(text)
        assert ids == reference.encode_ordinary(text) and encoder.decode(ids) == text.encode()


@pytest.mark.parametrize("pattern", [r".", r"\p{N}{1,3}|[^\r\n\p{L}\p{N}]?\p{L}+|\s+|[^\s]"])
def test_bpe_with_other_patterns(reference, pattern):
    other = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=reference._mergeable_ranks, special_tokens={})
    enc = bpe.TextEncoder(PATH, pattern)
    for text in ("hello there", "a  b c, d 12345 été", "x\n\n y", "", " lead and trail "):
        assert enc.encode(text) == other.encode_ordinary(text)
    assert pattern != "." or len(enc.encode("hello there")) == 11


def test_prefix_table_appends_and_edits(encoder):
    rng = random.Random(2)
    for _ in range(150):
        data = "".join(rng.choice("abcde enti  theing日") for _ in range(150)).encode()
        table = bpe.PrefixTable(encoder.ranks, data[:70])
        table.append(data[70:])
        assert table.last == bpe.PrefixTable(encoder.ranks, data).last
        a = rng.randint(0, len(data))
        b = min(len(data), a + rng.randint(0, 9))
        new = "".join(rng.choice("abcde ") for _ in range(rng.randint(0, 6))).encode()
        computed = table.replace(a, b, new)
        assert table.last == bpe.PrefixTable(encoder.ranks, data[:a] + new + data[b:]).last and computed <= len(table.last)


def test_bpe_long_piece_and_small_memory(reference):
    enc = bpe.TextEncoder(PATH, P.PATTERN, remembered=10)
    texts = ["x" * 5000, "the thing " * 300, None, ""] + [f"word{i} theing{i}, of" for i in range(50)]
    for _ in range(2):
        assert enc.encode_batch(texts) == [reference.encode_ordinary(t or "") for t in texts]


def test_cuts_are_looked_up_once_a_run(reference):
    class Counted(dict):
        asked = 0

        def get(self, *a):
            self.asked += 1
            return super().get(*a)

        def __getitem__(self, k):
            self.asked += 1
            return super().__getitem__(k)

    enc = bpe.TextEncoder(PATH, P.PATTERN)
    enc.seen = Counted()
    texts = [f"the thing{i % 7} of\t word {i % 5}." * 40 for i in range(50)] + ["a  b", None, "", " x", "y \0z", "y "]
    assert enc.encode_batch(texts) == [reference.encode_ordinary(t or "") for t in texts]
    assert enc.seen.asked < 1000  # of 12,000 cuts


def test_pairs_judged_together(encoder):
    rng = np.random.default_rng(3)
    short = np.array([i for t, i in encoder.ranks.ids.items() if len(t) <= bpe.LONG // 2])
    left, right = rng.choice(short, 5000), rng.choice(short[:2000], 5000)
    assert encoder.table._borders_hold(left, right).tolist() == [encoder.ranks.stable(a, b) for a, b in zip(left.tolist(), right.tolist(), strict=True)]


def test_digests_of_long_texts(encoder):
    ids = encoder.encode_lists(["the thing of é 日本 " * 50]).values
    parts = list(encoder.written(ids, encoder.digits, most=7))
    assert len(parts) > 20 and b"".join(parts) == b"".join(b" %d" % i for i in ids.to_pylist())
    assert encoder.digests(ids) == (hashlib.sha256(" ".join(map(str, ids.to_pylist())).encode()).hexdigest(), hashlib.sha256(encoder.decode(ids.to_pylist())).hexdigest())


def test_round_trip_query(spark, reference):
    docs = [(1, "s", "Hello there, wörld"), (2, "s", None), (2, "s", ""), (None, "s", "a  b\n")]
    got = bpe.round_trip(spark.createDataFrame(docs, SCHEMA), PATH, P.PATTERN).collect()
    for (i, _, t), r in zip(docs, got, strict=True):
        ids = reference.encode_ordinary(t or "")
        assert (r.doc_id, r.n_tokens, r.ids_sha256) == (i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    both = bpe.decode(bpe.encode(spark.createDataFrame(docs, SCHEMA), PATH, P.PATTERN), PATH, P.PATTERN)
    assert [bytes(r.bytes).decode() for r in both.collect()] == [t or "" for *_, t in docs]


# ---- token counts


def test_token_counts_stitch_over_blocks(spark, tmp_path):
    import numpy as np

    rng = random.Random(4)
    sizes = [rng.choice([0, 0, 1, 3, 17, 40]) for _ in range(120)]
    ids = [x for n in sizes for x in [*(rng.randint(0, 99) for _ in range(n)), 500]] + [7] * 25
    np.array(ids, "<u2").tofile(tmp_path / "a.bin")
    np.array([500], "<u2").tofile(tmp_path / "b.bin")
    files = spark.createDataFrame([("a.bin", 2 * len(ids)), ("b.bin", 2)], "file string, n_bytes long")
    for block in (2, 10, 64, 1 << 20):
        out = token_counts.count_tokens(token_counts.scan_blocks(files, f"file://{tmp_path}", 500, block_bytes=block)).collect()
        got = {(r.file, r.place): r.n_tokens for r in out}
        assert got == {("b.bin", 0): 0, ("a.bin", len(sizes)): 25} | {("a.bin", i): n for i, n in enumerate(sizes)}


def test_token_counts_query(spark, reference):
    docs = [(i, "s", "the thing " * i) for i in range(12)] + [(50, "s", None), (50, "s", None), (None, "s", "x")]
    got = token_counts.document_token_counts(spark.createDataFrame(docs, SCHEMA), PATH, P.PATTERN).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted((str(i), len(reference.encode_ordinary(t or ""))) for i, _, t in docs)
    assert token_counts.document_token_counts(spark.createDataFrame([], SCHEMA), PATH, P.PATTERN).count() == 0


# ---- fingerprints


K, S = fingerprints.K, fingerprints.S


def xx(data, seed=42):
    v = xxhash.xxh64(data, seed=seed & (2**64 - 1)).intdigest()
    return v - 2**64 if v >= 2**63 else v


def long_hash(a, b):
    return xx(b.to_bytes(8, "little", signed=True), xx(a.to_bytes(8, "little", signed=True)))


def plain_anchors(text):
    g = [xx(text[i : i + S].encode("utf-32-be")) for i in range(len(text) - S + 1)]
    w = K - S + 1
    return [(long_hash(g[i], g[i + w - 1]), i) for i in range(len(g) - w + 1) if min(g[i : i + w]) in (g[i], g[i + w - 1])]


def plain_fingerprint(text):
    found = plain_anchors(text) or ([(xx(text.encode()), 0)] if text else [])
    best = {}
    for h, i in sorted(((h % 2**64) >> 42, i) for h, i in found):
        best.setdefault(h >> 16, (h, i))
    return sorted(best.values())


def plain_likeness(a, b):
    if a == b:
        return 1.0
    at = dict(b)
    ranges = len({h >> 16 for h, _ in a} | {h >> 16 for h, _ in b})
    common = sorted((i, at[h] - i) for h, i in a if h in at)
    near = lambda p, q: abs(p[1] - q[1]) <= max(16, abs(p[0] - q[0]) // 8)
    held = sum(any(near(common[k], common[j]) for j in (k - 1, k + 1) if 0 <= j < len(common)) for k in range(len(common)))
    return (1 if len(common) == 1 else held) / ranges


def shown(found):
    return "".join(f"{h:06x}{i:08x}" for h, i in found)


def test_anchors_are_closed_syncmers(spark):
    rng = random.Random(6)
    text = " ".join(rng.choice("a bb ccc dd e ff ggg 日 本😀".split()) + str(rng.randint(0, 9)) for _ in range(120))
    r = fingerprints.anchors(spark.createDataFrame([(text,)], "text string")).first()
    assert [(a.hash, a.pos) for a in r.anchors] == plain_anchors(text)
    assert 0.25 < len(r.anchors) / len(text) < 0.55
    both = spark.createDataFrame([(text, "new words in front here " + text)], "x string, y string")
    both = fingerprints.anchors(fingerprints.anchors(both, "x", "ax"), "y", "ay")
    assert both.select(fingerprints.positional_matches("ax", "ay").alias("m")).first().m.shift == 24


@pytest.mark.parametrize("per_range", [3, 2000])
def test_fingerprint_query(spark, per_range):
    rng = random.Random(7)
    text = lambda: " ".join(rng.choice("alpha beta gamma delta".split()) + str(rng.randint(0, 50)) for _ in range(rng.randint(0, 80)))
    docs = [(i * i % 97 + i * 100, text()) for i in range(40)]
    docs += [(9000, docs[3][1]), (9001, None), (9002, ""), (9003, "é😀"), (9004, docs[3][1]), (9005, "twelve chars"), (None, text())]
    docs += [(5050, text()) for _ in range(25)]  # one id for many texts
    docs += [docs[-1]] * 2  # and a row thrice
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("h", F.lit(1)).withColumn("range", F.lit("mine"))
    got = sorted(((r.doc_id if r.doc_id is not None else -1, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in fingerprints.compare_with_edits(df, per_range).collect()), key=str)
    order = sorted(((-(2**63) if i is None else i, xx((t or "").encode()), t or "") for i, t in docs), reverse=True)
    want = []
    for k, (i, _, t) in enumerate(order):
        nxt = order[(k + 1) % len(order)][2]
        third = len(t) // 3
        edited = t[: len(t) - third] + nxt[:third]
        fp, efp = plain_fingerprint(t), plain_fingerprint(edited)
        want.append((max(i, -1), len(t), hashlib.sha256(edited.encode()).hexdigest(), shown(fp), shown(efp), round(plain_likeness(fp, efp), 9), round(plain_likeness(fp, plain_fingerprint(nxt)), 9)))
    assert got == sorted(want, key=str)


def test_fingerprints_of_near_texts(spark):
    rng = random.Random(8)
    thai = "".join(chr(rng.randint(0x0E01, 0x0E2E)) for _ in range(4000))
    words = [" ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(7)) for _ in range(30)]
    long_ = " ".join(words * 2)
    pairs = [(thai, "x" + thai), (long_, long_[:400] + " put between " + long_[400:]), (thai, thai[::-1]), (long_, thai)]
    pairs += [(w, " ".join(["changed" if k == 3 else x for k, x in enumerate(w.split())])) for w in words]
    df = spark.createDataFrame(pairs, "a string, b string")
    df = df.select(fingerprints.sketch(F.col("a")).alias("a"), fingerprints.sketch(F.col("b")).alias("b"))
    assert df.where(fingerprints.read(fingerprints.written(F.col("a"))) != F.col("a")).count() == 0
    near = [r.n for r in df.select(fingerprints.likeness(F.col("a"), F.col("b")).alias("n")).collect()]
    assert near[0] > 0.9 and near[1] > 0.8 and near[2] < 0.05 and near[3] < 0.05
    assert sum(n > 0 for n in near[4:]) >= 27 and all(0 <= n < 1 for n in near[4:])


def test_fingerprint_tables_of_none_and_one(spark):
    assert fingerprints.compare_with_edits(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    r = fingerprints.compare_with_edits(spark.createDataFrame([(1, "abc def")], "doc_id long, text string")).first()
    assert r.near_next == 1 and r.edited_sha256 == hashlib.sha256(b"abc dab").hexdigest()


# ---- mixing


def targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(capped.values())
        share = {s: w[s] * rest / max(1, sum(w[x] for x in free)) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return share | capped
        capped |= {s: most * sizes[s] for s in over}


@pytest.mark.parametrize("group", [7, 5000])
def test_mixing(spark, group, monkeypatch):
    monkeypatch.setattr(mixing.pivotal_round, "__defaults__", (0, group))
    rng = random.Random(8)
    docs = [(i, rng.choice(["b", "a", None, "é", "Z", "tiny" if i < 3 else "a"]), " ".join(["w"] * rng.randint(0, 30))) for i in range(300)]
    docs += [(900, "empty", None), (901, "empty", ""), (5, *docs[5][1:])]
    df = spark.createDataFrame(docs, SCHEMA)
    out = mixing.mix(df).collect()
    sizes = collections.Counter()
    for _, s, t in docs:
        sizes[s] += len((t or "").split())
    want = targets(sizes)
    taken = collections.Counter()
    for r in out:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert r.taken == r.copies * r.size <= 3 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * 30, s
    again = mixing.mix(df.repartition(5)).collect()
    key = lambda r: (r.doc_id, r.row_key)
    assert sorted(out, key=key) == sorted(again, key=key)
    copies = collections.Counter(r.doc_id for r in mixing.take(df).collect())
    assert copies == collections.Counter({i: n for i, n in ((i, sum(r.copies for r in out if r.doc_id == i)) for i in {r.doc_id for r in out}) if n})


def test_mixing_empty(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    assert mixing.take(spark.createDataFrame([], SCHEMA)).count() == 0


def test_targets_of_billions_of_words(spark):
    """Words times weight pass 32 bits before the number of words itself does, and after."""
    for words in (300_000_000, 900_000_000, 10**15):
        sizes = {"a": words, "b": words, "c": words + 1, None: words // 3, "tiny": 5}
        out = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()
        want = targets(sizes)
        assert {r.source: r.source_size for r in out} == sizes
        assert all(abs(r.target - want[r.source]) <= 1e-9 * words for r in out)
