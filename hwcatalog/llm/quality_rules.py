"""Host-level quality rules: rule failures by host, shrunken with an empirical beta prior, joined back to documents.

A document's own rules count words, repeats and symbols over the whole text. A host's failure rate is
the mean of a beta posterior whose prior is fitted to all hosts by moments, so a host with few
documents is judged mostly as its peers are, and a large one by its own record. Documents of a
rejected host go with it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import DOCS, cut, fresh

#: Fixed by the contract.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def text_counts(text: str | None) -> tuple[int, int]:
    """(words, words in three-word windows found twice or more, the first find included) of a whole text."""
    if not text:
        return 0, 0
    words = text.encode("utf-8", "surrogatepass").split()  # splits on the six ASCII spaces alone
    n = len(words)
    if n < 4:
        return n, 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, n)
    # exact window keys, two words at a time, renumbered so that products can't overflow
    _, two = np.unique(w[:-1] * len(ids) + w[1:], return_inverse=True)
    _, at, times = np.unique(two[:-1].astype(np.int64) * len(ids) + w[2:], return_inverse=True, return_counts=True)
    hit = times[at] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= hit
    return n, int(covered.sum())


@F.arrow_udf(T.StructType([T.StructField(n, T.LongType()) for n in ("n_words", "n_repeat_words")]))
def _counts(texts: pa.Array) -> pa.Array:
    n, r = zip(*(text_counts(x.as_py()) for x in texts), strict=True) if len(texts) else ((), ())
    return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(r, pa.int64())], names=["n_words", "n_repeat_words"])


def with_counts(df: DataFrame) -> DataFrame:
    """``df`` (with a text column) and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, all long.

    Null texts count as empty. Columns of ``df`` by those names are replaced. Python gets the text alone and gives back two numbers.
    """
    names = ["n_words", "n_repeat_words"]
    df = df.drop(*names, "word_chars", "n_symbols", "n_dup_lines")
    (both,) = fresh(df, "counts")
    text = F.coalesce("text", F.lit(""))
    blank = F.translate(text, SPACES, "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, SPACES, "") != "")
    counted = df.withColumn(both, _counts("text"))
    return counted.withColumns(
        {
            **{n: F.col(both)[n] for n in names},
            "word_chars": F.length(blank).cast("long"),
            "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        }
    ).drop(both)


def base_failed(min_words: int = MIN_WORDS, repeat_percent: int = MAX_REPEAT_PERCENT):
    """The rules that reject a document by itself."""
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))


def host_verdicts(counted: DataFrame, host: str = "source", failed: str = "rule_failed", reject_over: float = 0.8) -> DataFrame:
    """(host, n, failures, rate, rejected) for each host: the mean of its beta posterior against ``reject_over``.

    The prior is fitted by moments over hosts of at least two documents: with mean m and variance v of
    their rates, its weight is ``m (1 - m) / v - 1``, kept within 1 and 1000 documents. A null host is one
    host. One row a host is all that is gathered, by partial sums, so hot hosts don't matter.
    """
    by = counted.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n"), F.sum(F.col(failed).cast("long")).alias("failures"))
    by = by.withColumn("raw", F.col("failures") / F.col("n"))
    many = F.col("n") > 1
    fit = by.agg(F.avg(F.when(many, F.col("raw"))).alias("m0"), F.var_pop(F.when(many, F.col("raw"))).alias("v0"), (F.sum("failures") / F.sum("n")).alias("all"))
    m = F.coalesce("m0", "all", F.lit(0.0))
    weight = F.when(F.col("v0") > 0, F.least(F.lit(1000.0), F.greatest(F.lit(1.0), m * (1 - m) / F.col("v0") - 1))).otherwise(F.lit(1000.0))
    fit = fit.select(m.alias("mean"), weight.alias("weight"))  # one row
    rate = (F.col("failures") + F.col("mean") * F.col("weight")) / (F.col("n") + F.col("weight"))
    return by.crossJoin(F.broadcast(fit)).select("host", "n", "failures", rate.alias("rate"), (rate > reject_over).alias("rejected"))


def judge(docs: DataFrame, host: str = "source", symbol_percent: int = 50, dup_line_percent: int = 60, reject_over: float = 0.8, drop_text: bool = False) -> DataFrame:
    """``docs`` with the counts of ``with_counts``, base_failed, rule_failed, host_rate and kept.

    Besides the base rules a document fails for its host's record if its symbols pass ``symbol_percent``
    of its words or ``dup_line_percent`` of its lines repeat earlier ones; those two don't reject the document
    itself. kept is false if base_failed, else true unless the host is rejected. Null texts are empty (and
    fail); a null host is a host of its own; an empty table gives an empty result.
    """
    mine = ["base_failed", "rule_failed", "host_rate", "kept"]
    lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1))
    counted = with_counts(docs.drop(*mine)).withColumn("base_failed", base_failed())
    soft = (100 * F.col("n_symbols") > symbol_percent * F.col("n_words")) | (100 * F.col("n_dup_lines") > dup_line_percent * lines)
    counted = counted.withColumn("rule_failed", F.col("base_failed") | soft)
    counted = cut(counted.drop("text") if drop_text else counted, "counted", rows=docs.count(), per_file=DOCS)
    name, rejected = fresh(counted, "host", "rejected")
    hosts = host_verdicts(counted, host, "rule_failed", reject_over).select(F.col("host").alias(name), F.col("rate").alias("host_rate"), F.col("rejected").alias(rejected))
    out = counted.join(hosts, F.col(host).eqNullSafe(F.col(name)), "left")
    return out.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(rejected, F.lit(False))).drop(name, rejected)


def keep_good(docs: DataFrame, **params) -> DataFrame:
    """The documents that ``judge`` keeps, with the columns of ``docs``."""
    return judge(docs, **params).where("kept").select(*docs.columns)
