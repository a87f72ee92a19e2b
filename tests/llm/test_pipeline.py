"""The corpus pipeline over a small corpus."""

import random

import corpus_pipeline
import public_tokenizers as P

from hwcatalog.llm import bpe


def test_stages(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    text = lambda n: "\n".join(" ".join(word() for _ in range(12)) for _ in range(n))
    clean = [(i, text(8)) for i in range(20)]
    words = clean[0][1].replace("\n", " ").split()
    for k in (5, 30):
        words[k] = "changed"
    near = (50, "\n".join(" ".join(words[i : i + 7]) for i in range(0, len(words), 7)))
    rows = [*clean, near, (60, "too short"), (61, "again and " * 60), (62, clean[1][1]), (63, None)]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen[name] = docs.collect()
        if name != "byte_bpe":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = lambda n: {r.doc_id for r in seen[n]}
    assert ids("quality_rules") == {*range(20), 50, 62}
    assert {r.doc_id: r.text for r in seen["line_dedup"]} == dict(clean) | {50: near[1], 62: ""}
    assert all(r.n_chars == len(r.text) for r in seen["line_dedup"])
    assert ids("minhash_near_dedup") == {*range(20), 62}
    assert ids("source_mixing") <= {*range(20)}
    enc = bpe.TextEncoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert sorted(r.n_tokens for r in seen["byte_bpe"]) == sorted(len(enc.encode(r.text)) for r in seen["source_mixing"])


def test_stages_of_odd_tables(spark):
    """Nulls in any column, empty and long texts, repeated rows, an empty table: every stage takes them."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    long_ = "\n".join(" ".join(f"w{i}x{k}" for k in range(20)) for i in range(400))
    rows = [(None, long_, None, None, None), (1, long_, "en", "s", 3), (1, long_, "en", "s", 3), (2, None, None, "s", None), (3, "", "en", None, 0), (4, long_ + "\nand one line more that no other text has", "en", "t", 1)]
    for table in (rows, []):
        docs = spark.createDataFrame(table, schema)
        counts = []
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "")
            if name != "byte_bpe":
                assert out.columns == docs.columns
            docs = spark.createDataFrame(out.collect(), out.schema)
            counts.append(docs.count())
        assert counts[0] == (4 if table else 0) and all(a >= b for a, b in zip(counts, counts[1:3], strict=False))
