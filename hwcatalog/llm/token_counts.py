"""Token counts of flat unindexed token files by a separator scan.

A token file is nothing but ids of fixed width, documents end to end, each closed by an end-of-document id.
Blocks of the files are scanned independently with vectorised searches; what a block doesn't know, the
tokens and documents before it, comes from a prefix scan over one small row a block.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import encoder, runs
from .common import cut, new_path
from .warc import open_store


def write_token_files(docs: DataFrame, folder: str, path: str, pattern: str, end: int, width: int = 2) -> DataFrame:
    """Write the texts of ``docs`` (doc_id, text) as token files in ``folder``: (file, n_bytes, place, doc_id) a document.

    Each task writes one file of ids of ``width`` bytes, little-endian, and ``end`` after each document; place counts a file's
    documents from 0. A null text is an empty document. The file of an attempt that fails is never listed.
    """
    kind = np.dtype(f"<u{width}")

    def run(batches):
        enc, store, name, place, f = encoder(path, pattern), None, f"{uuid.uuid4().hex}.bin", 0, None
        ids = []
        for batch in batches:
            if f is None:
                store, where = open_store(folder)
                store.create_dir(where, recursive=True)
                f = store.open_output_stream(f"{where}/{name}")
            texts = batch.column(1).to_pylist()
            for i, j in runs(texts):
                lists = enc.encode_lists(texts[i:j])
                f.write(np.insert(lists.values.to_numpy(), lists.offsets.to_numpy()[1:], end).astype(kind).tobytes())
            ids.append(batch.column(0))
        if f is None:
            return
        f.close()
        size = sum(map(len, ids))
        total = store.get_file_info(f"{where}/{name}").size
        for column in ids:
            n = len(column)
            yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array([total] * n, pa.int64()), pa.array(range(place, place + n), pa.int64()), column], names=["file", "n_bytes", "place", "doc_id"])
            place += n
        assert place == size

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "file string, n_bytes long, place long, doc_id long")


def scan_blocks(files: DataFrame, folder: str, end: int, width: int = 2, block_bytes: int = 8 << 20) -> DataFrame:
    """(file, block, nth, tokens, closed) from ``files`` (file, n_bytes): for each block the documents that end in it, and its rest.

    nth counts the ends in a block from 0; tokens are those of the document that lie in the block. The row with closed false
    holds the tokens after the last end (or of the whole block).
    """
    kind = np.dtype(f"<u{width}")
    step = block_bytes // width * width
    blocks = files.select("file", "n_bytes", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n_bytes") / step).cast("int") - 1)).alias("block")).where("n_bytes > 0")
    blocks = blocks.repartition(F.col("file"), F.col("block"))

    def run(batches):
        for batch in batches:
            for name, size, block in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                store, where = open_store(folder)
                with store.open_input_file(f"{where}/{name}") as f:
                    ids = np.frombuffer(f.read_at(min(step, size - block * step), block * step), kind)
                ends = np.flatnonzero(ids == end)
                tokens = np.diff(ends, prepend=-1) - 1
                n = len(ends)
                tail = len(ids) - 1 - (int(ends[-1]) if n else -1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * (n + 1)), pa.array([block] * (n + 1), pa.int32()), pa.array(range(n + 1), pa.int64()), pa.array(np.append(tokens, tail), pa.int64()), pa.array([True] * n + [False])],
                    names=["file", "block", "nth", "tokens", "closed"],
                )

    return blocks.select("file", "n_bytes", "block").mapInArrow(run, "file string, block int, nth long, tokens long, closed boolean")


def count_tokens(scanned: DataFrame) -> DataFrame:
    """(file, place, n_tokens) of every document from ``scan_blocks``; tokens after a file's last end are of an unclosed last document.

    Blocks are stitched by a prefix scan over their summaries: ends before a block, and tokens since the last end. A document that
    spans blocks gets the tokens of all of them. Only the summaries, one row a block, are ordered within a file.
    """
    per = scanned.groupBy("file", "block").agg(F.sum(F.col("closed").cast("long")).alias("ends"), F.max(F.when(~F.col("closed"), F.col("tokens"))).alias("tail"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("first", F.coalesce(F.sum("ends").over(before), F.lit(0))).withColumn("sum_before", F.coalesce(F.sum("tail").over(before), F.lit(0)))
    # tails add up since the last block that has an end; that block's own tail is the first of them
    at_end = F.when(F.col("ends") > 0, F.col("sum_before"))
    per = per.withColumn("carry", F.col("sum_before") - F.coalesce(F.last(at_end, ignorenulls=True).over(before), F.lit(0)))
    last = Window.partitionBy("file")
    per = per.withColumn("is_last", F.col("block") == F.max("block").over(last)).select("file", "block", "first", "carry", "is_last")
    rows = scanned.join(per, ["file", "block"])
    n = F.col("tokens") + F.when(F.col("nth") == 0, F.col("carry")).otherwise(0)
    rows = rows.select("file", (F.col("first") + F.col("nth")).alias("place"), n.alias("n_tokens"), "closed", "is_last")
    return rows.where(F.col("closed") | (F.col("is_last") & (F.col("n_tokens") > 0))).select("file", "place", "n_tokens")


def document_token_counts(docs: DataFrame, path: str, pattern: str, end: int = 50256, width: int = 2) -> DataFrame:
    """doc_id and n_tokens of each row of ``docs``, counted by scanning the token files made of them.

    Null and empty texts have 0 tokens; repeated rows are counted each; a null doc_id stays null; an empty table gives none.
    """
    spark: SparkSession = docs.sparkSession
    folder = new_path(spark, "tokens")
    listed = cut(write_token_files(docs, folder, path, pattern, end, width), "listed")
    files = listed.select("file", "n_bytes").distinct()
    counted = count_tokens(cut(scan_blocks(files, folder, end, width), "scanned"))
    return listed.join(counted, ["file", "place"]).select("doc_id", "n_tokens")
