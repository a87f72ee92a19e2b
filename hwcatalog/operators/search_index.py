"""A stored index for text search: only rows that a query can match are scored.

A row matches a criterion where one of its fields holds the value, or has a word that starts the value or is within its typo budget of
it. Fields of many rows have the same text, so the index is made of the distinct texts, each named by a 64-bit hash: their words, the words' deletion
neighbourhoods (two words within d adjacent-swap edits share a word that each becomes by at most d deletions; of long words, which are mostly
ids and differ from row to row, there would be a hundred each, so they are kept by length and compared instead), and their trigrams, as they are and without
separators (flat). Postings lead from a text to its rows and fields. What a criterion finds there is a superset of its rows, and two texts
of one hash only add to it; the rows are then scored as a scan would do it, so results and scores are the same.

Tables are bucketed by their keys, so a lookup reads the buckets of its keys alone.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import FIELD_WEIGHTS
from ..sources.scratch import cut, release
from .search import Criterion, parse_query, row_score, typo_budget

#: Budgets of typos are at most this; words of more than SHORT characters have no deletion neighbourhood; tokens of more than LONGEST less the budget have no typos.
MOST_TYPOS = 2
SHORT = 12
LONGEST = 64
#: Folders of each table, by key.
BUCKETS = 64
ARRAYS = ("descriptions", "os_targets")


@dataclass(frozen=True)
class SearchIndex:
    """Where the tables of an index are: rows (the indexed table), postings (text, field, row), words (word, text), near (left, word), long (length, word), grams (gram, plain, flat, text)."""

    spark: SparkSession
    path: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")


def fields_of(rows: DataFrame, key: str) -> DataFrame:
    """(row, field, text): every field that a search looks at, in lower case; array columns as JSON text."""
    each = F.array(*(F.struct(F.lit(n).alias("field"), F.lower(F.to_json(n) if n in ARRAYS else F.col(n).cast("string")).alias("text")) for n in FIELD_WEIGHTS))
    return rows.select(F.col(key).alias("row"), F.inline(each)).where("text <> ''")


def deletions(word: Column, most: int = MOST_TYPOS) -> Column:
    """All that is left of a word after at most ``most`` deletions, the word included."""
    once = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    out = last = F.array(word)
    for _ in range(most):
        shorter = F.flatten(F.transform(F.filter(last, lambda w: F.length(w) > 1), once))
        last = F.array_distinct(shorter)
        out = F.array_union(out, last)
    return out


def plain_deletions(word: str, most: int) -> set[str]:
    """``deletions`` of one word of a query."""
    out = last = {word}
    for _ in range(most):
        last = {w[:i] + w[i + 1 :] for w in last if len(w) > 1 for i in range(len(w))}
        out = out | last
    return out


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def _store(df: DataFrame, path: str, key: str) -> None:
    # a bucket's rows in few files; a large bucket is split by adaptive execution
    df.withColumn("bucket", _bucket(key)).hint("rebalance", "bucket").sortWithinPartitions("bucket", key).write.partitionBy("bucket").parquet(path)


def build(rows: DataFrame, path: str, key: str = "driver_id") -> SearchIndex:
    """Write the index of ``rows`` below ``path``, which must not exist.

    ``rows`` needs the search's fields and a key; rows without key can't be found. Repeated rows are found each.
    """
    spark, rows = rows.sparkSession, rows.where(F.col(key).isNotNull())
    fields = fields_of(rows, key)
    _store(fields.select(F.xxhash64("text").alias("text"), "field", "row"), f"{path}/postings", "text")
    texts = cut(fields.select("text").distinct().select(F.xxhash64("text").alias("id"), "text"), "texts")
    words = texts.select(F.col("id").alias("text"), F.explode(F.array_distinct(F.filter(F.split("text", r"[^a-z0-9]+"), lambda w: w != ""))).alias("word"))
    _store(words, f"{path}/words", "word")
    vocabulary = spark.read.parquet(f"{path}/words").select("word").distinct().withColumn("length", F.length("word"))
    near = vocabulary.where(F.col("length") <= SHORT).select("word", F.explode(deletions(F.col("word"))).alias("left"))
    _store(near, f"{path}/near", "left")
    _store(vocabulary.where((F.col("length") > SHORT) & (F.col("length") <= LONGEST)), f"{path}/long", "length")
    cuts = lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - 2), lambda i: F.substring(t, i, F.lit(3)))
    grams = lambda t: F.when(F.length(t) >= 3, F.array_distinct(cuts(t))).otherwise(F.array().cast("array<string>"))
    both = texts.select("id", grams(F.col("text")).alias("p"), grams(F.regexp_replace("text", r"[^a-z0-9]+", "")).alias("f"))
    each = both.select(F.col("id").alias("text"), "p", "f", F.explode(F.array_union("p", "f")).alias("gram"))
    _store(each.select("gram", F.array_contains("p", F.col("gram")).alias("plain"), F.array_contains("f", F.col("gram")).alias("flat"), "text"), f"{path}/grams", "gram")
    release(texts)
    _store(rows, f"{path}/rows", key)
    return SearchIndex(spark, path)


def _looked_up(index: SearchIndex, table: str, key: str, wanted: DataFrame) -> DataFrame:
    """Rows of a table with one of the keys of ``wanted``; only their buckets are read."""
    asked = wanted.withColumn("bucket", _bucket(key))
    buckets = [r.bucket for r in asked.select("bucket").distinct().collect()]  # at most BUCKETS numbers
    return index.table(table).where(F.col("bucket").isin(buckets)).join(asked, ["bucket", key]).drop("bucket")


def _named(index: SearchIndex, key: str, wanted: set[str]) -> DataFrame:
    """The keys of one query, bounded by its length."""
    return F.broadcast(index.spark.createDataFrame([(w,) for w in sorted(wanted)], f"{key} string"))


def _held(index: SearchIndex, text: str, flat: bool) -> DataFrame:
    """Texts (text) that have all trigrams of a text."""
    grams = {text[i : i + 3] for i in range(len(text) - 2)}
    found = _looked_up(index, "grams", "gram", _named(index, "gram", grams)).where("flat" if flat else "plain")
    return found.groupBy("text").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(grams)).select("text")


def token_texts(index: SearchIndex, token: str) -> DataFrame | None:
    """A superset of the texts (text) where a token is: its trigrams all there, a word that starts it, or a word within its typo budget.

    None where the index can't tell: tokens of one or two characters may be anywhere in a text.
    """
    if len(token) < 3:
        return None
    words = _looked_up(index, "words", "word", _named(index, "word", {token[:i] for i in range(1, len(token) + 1)})).select("text")
    out = _held(index, token, flat=False).union(words)
    if (most := typo_budget(len(token))) and len(token) <= LONGEST - MOST_TYPOS:
        close = _looked_up(index, "near", "left", _named(index, "left", plain_deletions(token, most))).select("word").where(F.abs(F.length("word") - len(token)) <= most)
        if len(token) + most > SHORT:
            lengths = index.spark.createDataFrame([(n,) for n in range(len(token) - most, len(token) + most + 1)], "length int")
            close = close.union(_looked_up(index, "long", "length", F.broadcast(lengths)).where(F.levenshtein("word", F.lit(token), 2 * most) >= 0).select("word"))
        out = out.union(_looked_up(index, "words", "word", cut(close.distinct(), "close")).select("text"))
    return out.distinct()


def _rows(index: SearchIndex, texts: DataFrame, fields: tuple[str, ...] | None) -> DataFrame:
    """(row, field) of texts."""
    found = _looked_up(index, "postings", "text", cut(texts, "texts")).select("row", "field")
    return (found.where(F.col("field").isin(*fields)) if fields else found).distinct()


def criterion_rows(index: SearchIndex, c: Criterion) -> DataFrame | None:
    """A superset of the rows of a positive criterion, or None where all rows may be.

    A text has a phrase where it has each of its words (so if it holds the phrase as it is), or where the phrase is in it without separators.
    """
    if not c.phrase:
        found = token_texts(index, c.value)
        return None if found is None else _rows(index, found, c.fields).select("row").distinct()
    parts = [p for p in re.split(r"\s+", c.value) if p]
    found = [f for f in (token_texts(index, p) for p in parts) if f is not None]
    if not found:
        return None
    each = reduce(lambda a, b: a.join(b, "text", "left_semi"), found)
    joined = "".join(parts)
    if re.fullmatch(r"[a-z0-9]{3,}", joined):  # with any other sign it can't be in a text without separators
        each = each.union(_held(index, joined, flat=True))
    return _rows(index, each.distinct(), c.fields).select("row").distinct()


def candidates(index: SearchIndex, criteria: list[Criterion]) -> DataFrame | None:
    """Rows (row) that may match all positive criteria that the index knows about; None if it knows of none."""
    found = [f for f in (criterion_rows(index, c) for c in criteria if not c.negate) if f is not None]
    return reduce(lambda a, b: a.join(b, "row", "left_semi"), found) if found else None


def indexed_search(index: SearchIndex, q: str, key: str = "driver_id", where: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(matches with their score, best first; rows that were scored): as ``search.text_search`` over the indexed rows for which ``where`` holds.

    A query of which the index can't tell anything scores every row.
    """
    criteria = parse_query(q)
    rows, few = index.table("rows"), candidates(index, criteria)
    if few is not None:
        few = cut(few.select(F.col("row").alias("_row"), _bucket("row").alias("_bucket")), "candidates")
        buckets = [r[0] for r in few.select("_bucket").distinct().collect()]  # at most BUCKETS numbers
        rows = rows.where(F.col("bucket").isin(buckets)).join(few.select("_row"), F.col(key) == F.col("_row"), "left_semi")
    rows = (rows.where(where) if where else rows).drop("bucket")
    scored = rows.withColumn("score", row_score(criteria)).where("score >= 0")
    return scored.orderBy(F.desc("score"), F.desc("enabled"), F.desc_nulls_last("date_added"), key), rows
