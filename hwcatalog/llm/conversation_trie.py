"""The prefix trie of conversations, its subtree sums by heavy-path decomposition.

A node is a distinct sequence of first turns. It is named by its depth and 128 bits: the exclusive or of its turns' hashes,
each salted with its place, so the names of all prefixes of a conversation are a running value along its turns (``scan``), and
a conversation of any length is spread over as many tasks as it needs.

Subtree sums: the child with most members is its parent's heavy child, so a path down meets at most log2(conversations) light ones.
Heavy edges form paths. Nodes of a conversation that follow one another are first taken together as pieces, and pieces find the top of
their path by pointer doubling. Paths are then summed from the bottom, level by level of light edges: a suffix sum along
each path as one array, and its total is attached to the parent of its top.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scans import scan
from .common import cut, release

#: Conversation ids that are joined to one string before they meet the hash.
RUN = 20_000
NAME = ["depth", "a", "b"]


def number_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, r, s, n_chars) of each row of ``turns`` (conv_id, turn, role, text): its place from 0 by turn (null first) and two hashes of role and text.

    Null roles and texts are empty. Rows of one turn are ordered by role, then by hash; rows without conv_id belong to no conversation and go.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
        F.xxhash64(role, text).alias("r"), F.xxhash64(F.lit(1), text, role).alias("s"), F.length(text).cast("long").alias("n_chars"), F.monotonically_increasing_id().alias("where"), F.lit(1).alias("one"),
    )
    done = scan(rows, ["conv_id"], [F.col("turn").asc_nulls_first(), "role", "r", "s", "where"], {"pos": ("sum", "one")}, "turns")
    out = done.select("conv_id", (F.col("pos") - 1).alias("pos"), "r", "s", "n_chars")
    out._cut_path = done._cut_path
    return out


def rebuild(numbered: DataFrame, folds: int = 6, family: int = 100) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations: (conv_id, pos, r, s, n_chars, length), and (conv_id, length) of every conversation.

    Conversation c takes the first h turns of conversation c - c % ``family``, h = crc32(c) % ``folds``, then its own turns after its first h.
    """
    own = numbered.groupBy("conv_id").agg(F.count("*").alias("n"))
    h = F.crc32(F.col("conv_id").cast("string")) % folds
    base = own.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = own.select("conv_id", "n", (F.col("conv_id") - F.col("conv_id") % family).alias("base"), h.alias("h")).join(base, "base", "left")
    convs = convs.withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0)))).withColumn("length", F.col("taken") + F.greatest(F.lit(0), F.col("n") - F.col("h")))
    convs = cut(convs.select("conv_id", "base", "h", "taken", "length"), "convs")
    early = numbered.where(F.col("pos") < folds).withColumnRenamed("conv_id", "base")
    head = convs.where("taken > 0").join(early, "base").where("pos < taken").select("conv_id", "pos", "r", "s", "n_chars", "length")
    tail = numbered.join(convs, "conv_id").where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "r", "s", "n_chars", "length")
    return head.union(tail), convs.select("conv_id", "length")


def name_nodes(rebuilt: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (depth, a, b, pa, pb, conv_id, n_convs, n_chars), the root included, and ends (depth, a, b, conv_id): where each conversation ends."""
    salted = rebuilt.select("conv_id", (F.col("pos") + 1).alias("depth"), F.xxhash64("r", "pos", "s").alias("x"), F.xxhash64("s", "r", "pos").alias("y"), "n_chars", "length")
    steps = scan(salted, ["conv_id"], ["depth"], {"a": ("xor", "x"), "b": ("xor", "y")}, "prefixes")
    up = steps.select("depth", "a", "b", F.col("a").bitwiseXOR(F.col("x")).alias("pa"), F.col("b").bitwiseXOR(F.col("y")).alias("pb"), "conv_id", "n_chars")
    nodes = up.groupBy(*NAME).agg(F.first("pa").alias("pa"), F.first("pb").alias("pb"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("n_chars").alias("n_chars"))
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(zero.alias("depth"), zero.alias("a"), zero.alias("b"), F.lit(None).cast("long").alias("pa"), F.lit(None).cast("long").alias("pb"), "conv_id", "n_convs", zero.alias("n_chars"))
    nodes = cut(nodes.unionByName(root), "nodes")
    ends = steps.where("depth = length").select(*NAME, "conv_id").union(convs.where("length = 0").select(zero, zero, zero, "conv_id"))
    ends = cut(ends, "ends")
    release(steps)
    return nodes, ends


def end_digests(ends: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256) of nodes at which conversations end: the SHA-256 of their ids, ascending, joined by commas.

    Ids are sorted over many tasks, which join runs of them; then the runs of a node are fed to its hash one after the other, so memory is that of a run.
    """
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def join_runs(batches):
        key, ids = None, []

        def out(rows):
            return pa.RecordBatch.from_pylist(rows, schema=pa.schema([*((c, pa.int64()) for c in (*NAME, "first")), ("ids", pa.string())]))

        ready = []
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for *name, conv in zip(*columns, strict=True):
                if name != key or len(ids) >= RUN:
                    if ids:
                        ready.append(dict(zip(NAME, key, strict=True), first=ids[0], ids=",".join(map(str, ids))))
                        if len(ready) >= 1000 or len(ids) >= RUN:
                            yield out(ready)
                            ready = []
                    key, ids = name, []
                ids.append(conv)
        if ids:
            ready.append(dict(zip(NAME, key, strict=True), first=ids[0], ids=",".join(map(str, ids))))
        if ready:
            yield out(ready)

    def digest(batches):
        key, sha, ready = None, None, []

        def out():
            return pa.RecordBatch.from_pylist(ready, schema=pa.schema([*((c, pa.int64()) for c in NAME), ("ends_sha256", pa.string())]))

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in (0, 1, 2, 4)]
            for *name, ids in zip(*columns, strict=True):
                if name == key:
                    sha.update(b",")
                else:
                    if key is not None:
                        ready.append(dict(zip(NAME, key, strict=True), ends_sha256=sha.hexdigest()))
                        if len(ready) >= 1000:
                            yield out()
                            ready = []
                    key, sha = name, hashlib.sha256()
                sha.update(ids.encode())
        if key is not None:
            ready.append(dict(zip(NAME, key, strict=True), ends_sha256=sha.hexdigest()))
            yield out()

    spread = ends.repartitionByRange(parts, *NAME, "conv_id").sortWithinPartitions(*NAME, "conv_id").select(*NAME, "conv_id")
    runs = spread.mapInArrow(join_runs, "depth long, a long, b long, first long, ids string")
    return runs.repartition(parts, *NAME).sortWithinPartitions(*NAME, "first").mapInArrow(digest, "depth long, a long, b long, ends_sha256 string")


def heavy_paths(nodes: DataFrame) -> DataFrame:
    """``nodes`` with top_conv and top_depth, the top node of each node's heavy path, n_children and up_conv, the parent's conv_id.

    A node is known by (conv_id, depth) too: its least member and its depth.
    """
    size = nodes.count()
    parent = [(F.col("depth") - 1).alias("pd"), "pa", "pb"]
    kids = nodes.where("depth > 0").select(*parent, F.struct("n_convs", (-F.col("conv_id")).alias("o"), "a", "b").alias("k"))
    kids = kids.groupBy("pd", "pa", "pb").agg(F.count("*").alias("n_children"), F.max("k").alias("k")).select("pd", "pa", "pb", "n_children", F.col("k.a").alias("ha"), F.col("k.b").alias("hb"))
    own = nodes.join(kids.select(F.col("pd").alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b"), "n_children"), NAME, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    # what a node needs of its parent: the parent's conversation and its heavy child
    above = nodes.select(F.col("depth").alias("pd"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("up_conv")).join(kids.drop("n_children"), ["pd", "pa", "pb"])
    own = own.withColumn("pd", F.col("depth") - 1).join(above, ["pd", "pa", "pb"], "left")
    heavy = (F.col("a") == F.col("ha")) & (F.col("b") == F.col("hb")) & (F.col("depth") > 0)
    own = own.withColumn("heavy", F.coalesce(heavy, F.lit(False)))
    # pieces: nodes of one conversation that hang together by heavy edges
    starts = ~F.col("heavy") | (F.col("up_conv") != F.col("conv_id"))
    own = own.select(*NAME, "conv_id", "up_conv", "n_convs", "n_chars", "n_children", "heavy", F.when(starts, F.col("depth")).alias("start"))
    marked = scan(own, ["conv_id"], ["depth"], {"piece": ("last", "start")}, "pieces", None)
    heads = marked.where("depth = piece").select("conv_id", "piece", "heavy", "up_conv", (F.col("piece") - 1).alias("up_depth"))
    # the piece above, where a heavy edge leads to it; else a piece is at the top of its path
    over = heads.where("heavy").join(marked.select(F.col("conv_id").alias("up_conv"), F.col("depth").alias("up_depth"), F.col("piece").alias("up_piece")), ["up_conv", "up_depth"])
    tops = heads.where("NOT heavy").select("conv_id", "piece", F.col("conv_id").alias("top_conv"), F.col("piece").alias("top_depth"), F.lit(True).alias("done"))
    jump = cut(tops.union(over.select("conv_id", "piece", "up_conv", "up_piece", F.lit(False))), "jumps", rows=size)
    while jump.where("NOT done").limit(1).count():
        to = jump.select(F.col("conv_id").alias("top_conv"), F.col("piece").alias("top_depth"), F.col("top_conv").alias("t"), F.col("top_depth").alias("td"), F.col("done").alias("ready"))
        nxt = jump.where("done").union(jump.where("NOT done").join(to, ["top_conv", "top_depth"]).select("conv_id", "piece", "t", "td", "ready"))
        nxt = cut(nxt, "jumps", rows=size)
        release(jump)
        jump = nxt
    out = cut(marked.join(jump.drop("done"), ["conv_id", "piece"]).select(*NAME, "conv_id", "up_conv", "n_convs", "n_chars", "n_children", "top_conv", "top_depth"), "paths")
    release(marked)
    release(jump)
    return out


def path_levels(paths: DataFrame) -> tuple[DataFrame, int]:
    """(top_conv, top_depth, into_conv, into_depth, level) of each path: the path over it and how many light edges lie above; and the deepest level.

    Levels are found by pointer doubling, as pieces find their path.
    """
    heads = paths.where("conv_id = top_conv AND depth = top_depth").select("top_conv", "top_depth", F.col("up_conv").alias("c"), (F.col("depth") - 1).alias("d"))
    over = paths.select(F.col("conv_id").alias("c"), F.col("depth").alias("d"), F.col("top_conv").alias("into_conv"), F.col("top_depth").alias("into_depth"))
    tree = heads.where("top_depth > 0").join(over, ["c", "d"]).select("top_conv", "top_depth", "into_conv", "into_depth", F.lit(1).alias("level"))
    tree = tree.union(heads.where("top_depth = 0").select("top_conv", "top_depth", F.lit(None).cast("long"), F.lit(None).cast("long"), F.lit(0)))
    left = cut(tree, "levels")
    while left.where("into_conv IS NOT NULL").limit(1).count():
        to = left.select(F.col("top_conv").alias("into_conv"), F.col("top_depth").alias("into_depth"), F.col("into_conv").alias("c"), F.col("into_depth").alias("d"), F.col("level").alias("more"))
        open_ = left.where("into_conv IS NOT NULL").join(to, ["into_conv", "into_depth"]).select("top_conv", "top_depth", F.col("c").alias("into_conv"), F.col("d").alias("into_depth"), (F.col("level") + F.col("more")).alias("level"))
        nxt = cut(left.where("into_conv IS NULL").union(open_), "levels")
        release(left)
        left = nxt
    return left.select("top_conv", "top_depth", "level"), left.agg(F.max("level")).first()[0] or 0


def subtree_sums(paths: DataFrame, values: dict[str, str]) -> DataFrame:
    """(conv_id, depth) and, for each entry of ``values`` (name -> SQL of a node's own long), its sum over the node's subtree."""
    level, deepest = path_levels(paths)
    rows = paths.join(level, ["top_conv", "top_depth"]).select("conv_id", "depth", "up_conv", "top_conv", "top_depth", "level", (-F.col("depth")).alias("turned"), *(F.expr(e).alias(n) for n, e in values.items()))
    rows = cut(rows, "own")
    done, light = [], None
    for k in range(deepest, -1, -1):
        mine = rows.where(F.col("level") == k)
        if light is not None:  # totals of the paths below, attached to their parents
            mine = mine.join(light, ["conv_id", "depth"], "left").withColumns({n: F.col(n) + F.coalesce(f"{n}_light", F.lit(0)) for n in values})
        summed = scan(mine.select("conv_id", "depth", "up_conv", "top_conv", "top_depth", "turned", *values), ["top_conv", "top_depth"], ["turned"], {f"{n}_sum": ("sum", n) for n in values}, "suffix")
        done.append(summed.select("conv_id", "depth", *(F.col(f"{n}_sum").alias(n) for n in values)))
        tops = summed.where("conv_id = top_conv AND depth = top_depth").groupBy(F.col("up_conv").alias("conv_id"), (F.col("depth") - 1).alias("depth"))
        light = tops.agg(*(F.sum(f"{n}_sum").alias(f"{n}_light") for n in values)).where("depth >= 0")
    release(rows)
    out = done[0]
    for x in done[1:]:
        out = out.union(x)
    return out


def trie(turns: DataFrame, folds: int = 6, family: int = 100) -> DataFrame:
    """One row a node of the trie of the conversations that ``rebuild`` makes of ``turns`` (conv_id, turn, role, text; other columns are ignored).

    conv_id (least member), depth, parent_conv_id (root: null), n_convs, n_children, n_leaves and saved_tokens (over the subtree:
    leaves, and characters of a node's last text times members but one), ends_sha256. Repeated rows are turns of their own. A
    conversation without turns is a member of the root. An empty table has no root.
    """
    numbered = number_turns(turns)
    rebuilt, convs = rebuild(numbered, folds, family)
    nodes, ends = name_nodes(rebuilt, convs)
    release(numbered)
    paths = heavy_paths(nodes)
    sums = subtree_sums(paths, {"n_leaves": "if(n_children = 0, 1L, 0L)", "saved_tokens": "(n_convs - 1) * n_chars"})
    none = hashlib.sha256(b"").hexdigest()
    out = paths.join(sums, ["conv_id", "depth"]).join(end_digests(ends), NAME, "left")
    return out.select("conv_id", "depth", F.col("up_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
