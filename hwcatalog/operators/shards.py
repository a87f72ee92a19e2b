"""Size-capped manifest shards, the repository index, archive volumes, and install plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import SHARD_LIMIT, SHARD_SPLIT
from ..sources.scratch import cut
from .packing import greedy_bins


def pack(entries: DataFrame, limit: int = SHARD_SPLIT, overhead: int = 2048) -> DataFrame:
    """(category, pos, bytes, shard) of ``entries`` (category, pos, bytes): entries fill shards in order, none above ``limit`` unless one entry is.

    A shard holds ``overhead`` bytes besides, and one more for each entry. As a loop over a category would do it, but by many tasks.
    """
    sized = entries.select("category", "pos", "bytes", (F.col("bytes") + 1).alias("_held"))
    out = greedy_bins(sized, "category", ["pos"], {"_held": limit - overhead})
    return out.select("category", "pos", "bytes", (F.col("bin") + 1).alias("shard"))


def shard_file(category: Column, shard: Column) -> Column:
    return F.concat(category, F.lit(".manifest"), F.when(shard > 1, F.concat(F.lit("."), shard.cast("string"))).otherwise(F.lit("")), F.lit(".json"))


def manifest_documents(entries: DataFrame, packed: DataFrame) -> DataFrame:
    """(file, value): the JSON document of each shard; all but the last of a category are sealed and name the next."""
    rows = entries.join(packed.select("category", "pos", "shard"), ["category", "pos"])
    docs = rows.groupBy("category", "shard").agg(F.sort_array(F.collect_list(F.struct("pos", "entry"))).alias("e"))
    last = F.max("shard").over(Window.partitionBy("category"))
    docs = docs.withColumn("total", last)
    nxt = F.when(F.col("shard") < F.col("total"), shard_file(F.col("category"), F.col("shard") + 1))
    doc = F.struct(F.lit("3").alias("schema"), F.col("category"), F.col("shard").alias("shard_index"), F.col("total").alias("total_shards"), F.transform("e", lambda x: x["entry"]).alias("drivers"), nxt.alias("next_shard"))
    return docs.select(shard_file(F.col("category"), F.col("shard")).alias("file"), F.to_json(doc).alias("value"))


def _quoted(text: Column) -> Column:
    """A JSON string; null of null."""
    whole = F.to_json(F.struct(text.alias("x")))
    return F.when(text.isNotNull(), F.substring(whole, 6, F.length(whole) - 6))


def shard_document(category: Column, shard: Column, total: Column, updated: Column, entries: Column, history: Column, next_file: Column) -> Column:
    """JSON text of a shard from the JSON texts of its entries and of its history; with a file that follows it is sealed."""
    head = F.concat(F.lit('{"schema":"3","category":'), _quoted(category), F.lit(',"shard_index":'), shard.cast("string"), F.lit(',"total_shards":'), total.cast("string"), F.lit(',"updated":'), _quoted(updated))
    sealed = F.concat(F.lit(',"note":'), _quoted(F.concat(F.lit("Sealed \u2014 continued in "), next_file)), F.lit(',"next_shard":'), _quoted(next_file))
    return F.concat(head, F.lit(',"drivers":['), F.array_join(entries, ","), F.lit('],"version_history":'), history, F.coalesce(sealed, F.lit("")), F.lit("}"))


def save(docs: DataFrame, new: DataFrame, history: DataFrame | None = None, updated: str = "", split: int = SHARD_SPLIT, share: float = 0.9) -> DataFrame:
    """(file, value, state): the documents to write so that ``new`` (category, pos, id, entry: JSON text) joins the stored shards ``docs`` (file, value).

    The last shard of a category is active. If it can take the new entries within ``split`` bytes it is ``grown``: entries whose id it has are replaced in
    place, others follow in order of pos. Else it is ``sealed`` with its entries as they are, and entries that it hasn't fill ``new`` shards in order, each to
    ``share`` of ``split`` bytes at most, or one entry larger than that. Earlier shards are never written again. The last shard takes the
    category's ``history`` (category, history: JSON text; by default what the active shard had); where it doesn't fit there a shard of its own follows.
    Sizes are of the written bytes, a line end included. Categories without new entries aren't written. Where ``new`` repeats an id the last by pos counts.
    """
    new = new.where("category IS NOT NULL AND id IS NOT NULL").groupBy("category", "id").agg(F.max("pos").alias("pos"), F.max_by("entry", "pos").alias("entry"))
    stored = docs.where("file LIKE '%.manifest%.json'").withColumns({"category": F.regexp_replace("file", r"\.manifest(\.\d+)?\.json$", ""), "shard": F.coalesce(F.regexp_extract("file", r"manifest\.(\d+)\.json$", 1).try_cast("int"), F.lit(1))})
    last = stored.groupBy("category").agg(F.max("shard").alias("shard"))
    # the one shard of a category that may be written again; nothing else is parsed
    active = stored.join(last, ["category", "shard"]).join(new.select("category").distinct(), "category", "left_semi")
    parsed = F.from_json("value", "drivers array<string>, version_history string, updated string")
    active = active.withColumn("d", parsed).select("category", "shard", F.coalesce("d.drivers", F.array().cast("array<string>")).alias("entries"), F.coalesce("d.version_history", F.lit("{}")).alias("had"), F.coalesce("d.updated", F.lit("")).alias("was"))
    active = cut(active, "active")
    given = history if history is not None else new.select("category").distinct().withColumn("history", F.lit(None).cast("string"))
    heads = new.select("category").distinct().join(active.drop("entries"), "category", "left").join(given.select("category", "history"), "category", "left")
    heads = heads.select("category", F.coalesce("shard", F.lit(0)).alias("shard"), "was", "had", F.coalesce("history", "had", F.lit("{}")).alias("history"))
    old = active.select("category", F.posexplode("entries").alias("at", "entry")).withColumn("id", F.get_json_object("entry", "$.id"))
    known = old.join(new.select("category", "id", F.col("entry").alias("now")), ["category", "id"], "left")
    fresh = new.join(old.select("category", "id"), ["category", "id"], "left_anti")
    line = known.select("category", F.lit(0).alias("part"), F.col("at").cast("long").alias("pos"), F.coalesce("now", "entry").alias("entry")).union(fresh.select("category", F.lit(1), F.col("pos").cast("long"), "entry"))
    line = cut(line, "entries")
    none, today, no_file = F.array().cast("array<string>"), F.lit(updated), F.lit(None).cast("string")
    grown_size = F.octet_length(shard_document(F.col("category"), F.greatest(F.col("shard"), F.lit(1)), F.greatest(F.col("shard"), F.lit(1)), today, none, F.col("history"), no_file)) + 1
    sums = line.groupBy("category").agg((F.sum(F.octet_length("entry") + 1) - 1).alias("held"))
    heads = heads.join(sums, "category").withColumn("fits", grown_size + F.col("held") <= split)
    # numbers as long as any may get, so a document is never larger than reckoned
    most = F.lit(10_000_000)
    room = F.floor(F.lit(split * share)) - F.octet_length(shard_document(F.col("category"), most, most, today, none, F.lit("{}"), shard_file(F.col("category"), most)))
    heads = cut(heads.withColumn("room", room.cast("long")), "heads")
    whole = lambda rows, *by: rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("part", "pos", "entry"))).alias("e")).withColumn("e", F.transform("e", lambda x: x["entry"]))
    at = F.greatest(F.col("shard"), F.lit(1))
    grown = whole(line.join(heads.where("fits").select("category"), "category"), "category").join(heads, "category")
    grown = grown.select(shard_file(F.col("category"), at).alias("file"), shard_document(F.col("category"), at, at, today, F.col("e"), F.col("history"), no_file).alias("value"), F.when(F.col("shard") == 0, "new").otherwise("grown").alias("state"))
    full = heads.where("NOT fits")
    rest = line.where("part = 1").join(full.select("category", "room", F.col("shard").alias("sealed")), "category").withColumn("_held", F.octet_length("entry") + 1)
    bins = greedy_bins(rest, "category", ["pos"], {"_held": F.col("room")})
    made = cut(whole(bins.withColumn("shard", F.col("sealed") + F.col("bin") + 1), "category", "shard"), "made")
    ends = full.select("category", F.col("shard").alias("first"), "history", "had", "was").join(made.groupBy("category").agg(F.max("shard").alias("end")), "category", "left").withColumn("end", F.coalesce("end", "first"))
    # the last shard takes the history, or one more does
    tail = made.join(ends.select("category", F.col("end").alias("shard"), "history"), ["category", "shard"])
    size = F.octet_length(shard_document(F.col("category"), F.col("shard"), F.col("shard"), today, F.col("e"), F.col("history"), no_file)) + 1
    ends = cut(ends.join(tail.select("category", (size <= split).alias("takes")), "category", "left").withColumn("total", F.col("end") + F.when(F.coalesce("takes", F.lit(False)), 0).otherwise(1)), "ends")
    alone = ends.where("total > end").select("category", F.col("total").alias("shard"), none.alias("e"))
    every = made.unionByName(alone).join(ends.select("category", "total", "history"), "category")
    is_last = F.col("shard") == F.col("total")
    following = F.when(~is_last, shard_file(F.col("category"), F.col("shard") + 1))
    added = every.select(shard_file(F.col("category"), F.col("shard")).alias("file"), shard_document(F.col("category"), F.col("shard"), F.col("total"), today, F.col("e"), F.when(is_last, F.col("history")).otherwise("{}"), following).alias("value"), F.lit("new").alias("state"))
    closed = active.join(ends.select("category", "total"), "category")
    closed = closed.select(shard_file(F.col("category"), F.col("shard")).alias("file"), shard_document(F.col("category"), F.col("shard"), F.col("total"), F.col("was"), F.col("entries"), F.col("had"), shard_file(F.col("category"), F.col("shard") + 1)).alias("value"), F.lit("sealed").alias("state"))
    return grown.union(closed).union(added)


def seal(shards: DataFrame, limit: int = SHARD_LIMIT) -> DataFrame:
    """``shards`` (category, shard, filename, size_bytes) with sealed: at the limit, or not the last of its chain."""
    nxt = F.lead("shard").over(Window.partitionBy("category").orderBy("shard"))
    return shards.withColumn("sealed", (F.col("size_bytes") >= limit) | nxt.isNotNull())


def index_document(shards: DataFrame, summary: DataFrame) -> DataFrame:
    """One row: the index as JSON text, from sealed shards and (category, n) counts."""
    s = shards.agg(F.sort_array(F.collect_list(F.struct("filename", "size_bytes", (~F.col("sealed")).alias("active"), F.when(F.col("sealed"), "sealed").otherwise("").alias("note")))).alias("manifest_shards"))
    c = summary.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "n")))).alias("category_summary"))
    return s.crossJoin(c).select(F.to_json(F.struct(F.lit("2").alias("schema"), "manifest_shards", "category_summary")).alias("value"))


def volume_check(volumes: DataFrame) -> DataFrame:
    """(stem, volumes, missing, duplicates, empty, state) of archive volumes (stem, number, size): numbers must run on from 0 or 1, once each, none empty."""
    g = volumes.groupBy("stem").agg(F.collect_set("number").alias("have"), F.count("*").alias("volumes"), F.count_if(F.col("size") == 0).alias("empty"))
    first = F.least(F.lit(1), F.array_min("have"))
    g = g.withColumn("missing", F.array_sort(F.array_except(F.sequence(first, F.array_max("have")), "have"))).withColumn("duplicates", F.col("volumes") - F.size("have"))
    state = F.when(F.col("duplicates") > 0, "duplicate").when(F.size("missing") > 0, "missing").when(F.col("empty") > 0, "corrupt").otherwise("ok")
    return g.select("stem", "volumes", F.array_join(F.transform("missing", lambda x: x.cast("string")), ",").alias("missing"), "duplicates", "empty", state.alias("state"))


def zip_bomb(members: DataFrame, ratio: int = 200, ceiling: int = 8 << 40) -> DataFrame:
    """(archive, total, safe): total unpacked size against a ceiling and a multiple of the archive's size; ``members``: archive, input_size, size."""
    g = members.groupBy("archive").agg(F.sum("size").alias("total"), F.max("input_size").alias("input_size"))
    return g.select("archive", "total", ((F.col("total") <= ceiling) & (F.col("total") <= ratio * F.col("input_size"))).alias("safe"))


def https_url(u: Column) -> Column:
    t = F.trim(F.coalesce(u, F.lit("")))
    return F.when(t.rlike(r"(?i)^https://"), t).otherwise("")


def hex_sha(s: Column) -> Column:
    t = F.lower(F.trim(F.coalesce(s, F.lit(""))))
    return F.when(t.rlike(r"^[0-9a-f]{64}$"), t).otherwise("")


def install_parts(drivers: DataFrame, parts: DataFrame) -> DataFrame:
    """(driver_id, n, filename, url, sha256) to fetch for each driver: its usable parts in order, or else its archive url."""
    p = parts.select("driver_id", "part_num", F.trim("filename").alias("filename"), https_url(F.col("url")).alias("url"), hex_sha(F.col("sha256")).alias("sha256")).where("filename <> '' AND url <> ''")
    n = F.row_number().over(Window.partitionBy("driver_id").orderBy("part_num", "filename"))
    own = drivers.select("driver_id").join(p, "driver_id").select("driver_id", n.alias("n"), "filename", "url", "sha256")
    rest = drivers.join(own.select("driver_id").distinct(), "driver_id", "left_anti").withColumn("url", https_url(F.col("primary_url"))).where("url <> ''")
    name = F.substring_index(F.regexp_replace("url", r"[?#].*$", ""), "/", -1)
    return own.union(rest.select("driver_id", F.lit(1), F.when(name == "", "driver.7z.001").otherwise(name), "url", F.lit("")))


def next_archive_repo(spent: DataFrame) -> DataFrame:
    """One row: the first of drivers, drivers_2, drivers_3, … that isn't in ``spent`` (name)."""
    number = F.when(F.col("name") == "drivers", 1).otherwise(F.regexp_extract("name", r"^drivers_(\d+)$", 1).try_cast("int"))
    have = spent.select(number.alias("i")).where("i >= 1").agg(F.collect_set("i").alias("have"))
    free = F.array_min(F.array_except(F.sequence(F.lit(1), F.size("have") + 1), "have"))
    return have.select(F.when(free == 1, "drivers").otherwise(F.concat(F.lit("drivers_"), free.cast("string"))).alias("name"))
