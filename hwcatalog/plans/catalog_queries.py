"""Queries of joins, aggregations, windows, set operations and search over the catalog views."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import versions
from ..operators import aggregates, id_table, lineage, load, reconcile, search, search_index, shards
from ..sources.scratch import shared_path
from .function_queries import TOKEN, VER_A, VER_B, VER_C, fill
from .registry import query
from .views import Catalog


# ---- lookups and joins


@query("join_hwid_count", "SELECT d.driver_id, coalesce(n, 0) AS hwid_count FROM drivers d LEFT JOIN (SELECT driver_id, count(*) AS n FROM hwids GROUP BY driver_id) h ON d.driver_id = h.driver_id", "drivers hwids")
def _(c: Catalog):
    return search.hwid_counts(c.drivers, c.hwids).select("driver_id", "hwid_count")


@query("join_hwid_lookup", "SELECT DISTINCT h.driver_id FROM hwids h JOIN (SELECT min(hwid_string) AS q FROM hwids) m ON lower(h.hwid_string) = lower(m.q)", "hwids")
def _(c: Catalog):
    asked = c.hwids.agg(F.lower(F.min("hwid_string")).alias("q"))
    return c.hwids.join(asked, F.upper("hwid_string") == F.upper("q")).select("driver_id").dropDuplicates()


ASKED = r", q AS (SELECT DISTINCT concat('PCI\VEN_', printf('%04X', l_suppkey), '&DEV_', printf('%04X', l_partkey), '&SUBSYS_1') AS query, concat('PCI\VEN_', printf('%04X', l_suppkey), '&DEV_', printf('%04X', l_partkey)) AS r1, concat('PCI\VEN_', printf('%04X', l_suppkey)) AS r2 FROM lineitem WHERE l_orderkey % 20 = 0)"


@query("join_hwid_ladder", ASKED + ", hits AS (SELECT query, level, rung, driver_id FROM (SELECT query, 1 AS level, r1 AS rung FROM q UNION ALL SELECT query, 2, r2 FROM q) AS s JOIN (SELECT DISTINCT hwid_string, driver_id FROM hwids) AS h ON hwid_string = rung), f AS (SELECT query, min(level) AS level FROM hits GROUP BY query) SELECT h.query, rung AS matched_at, h.level, h.level = 0 AS exact, h.driver_id, d.display_name, coalesce(n.c, 0) AS hwid_count FROM hits h JOIN f ON h.query = f.query AND h.level = f.level JOIN drivers d ON d.driver_id = h.driver_id LEFT JOIN (SELECT driver_id, count(*) AS c FROM hwids GROUP BY driver_id) n ON n.driver_id = h.driver_id WHERE d.enabled", "drivers hwids")
def _(c: Catalog):
    asked = c.lineitem.where("l_orderkey % 20 = 0").select(F.format_string("PCI\\VEN_%04X&DEV_%04X&SUBSYS_1", "l_suppkey", "l_partkey").alias("query")).distinct()
    hits = search.hwid_lookup(c.hwids, asked)
    d = search.hwid_counts(c.drivers.where("enabled"), c.hwids)
    return hits.join(d.select("driver_id", "display_name", "hwid_count"), "driver_id")


@query("join_hwid_stored", r", q AS (SELECT hwid_string AS q FROM hwids GROUP BY hwid_string ORDER BY hwid_string LIMIT 20) SELECT q.q AS query, h.driver_id, 0 AS level FROM q JOIN hwids h ON h.hwid_string = q.q", "hwids")
def _(c: Catalog):
    path = shared_path(c.spark, "ids")
    id_table.store(c.hwids, path)
    asked = [r.h for r in c.spark.read.parquet(path).select(F.col("hwid_string").alias("h")).distinct().orderBy("h").limit(20).collect()]
    return id_table.lookup(c.spark, path, asked).select("query", "driver_id", "level")


@query("join_ids_ordered", "SELECT d.pos AS p, -d.pos AS pos, d.driver_id, display_name FROM drivers d WHERE d.enabled", "drivers")
def _(c: Catalog):
    wanted = c.drivers.select((-F.col("pos")).alias("n"), "driver_id")  # asked for from the last to the first
    return search.by_ids(c.drivers.withColumnRenamed("pos", "p"), wanted.withColumnRenamed("n", "pos")).select("p", "pos", "driver_id", "display_name")


@query("join_detail", "SELECT d.driver_id, coalesce(p.parts, '') AS parts, coalesce(h.hw, '') AS hwids FROM drivers d LEFT JOIN (SELECT driver_id, string_agg(filename, ',' ORDER BY part_num) AS parts FROM driver_parts GROUP BY driver_id) p ON d.driver_id = p.driver_id LEFT JOIN (SELECT driver_id, string_agg(hwid_string, ',' ORDER BY is_generic, hwid_string) AS hw FROM hwids GROUP BY driver_id) h ON h.driver_id = d.driver_id", "drivers driver_parts hwids")
def _(c: Catalog):
    p = c.driver_parts.groupBy("driver_id").agg(F.array_sort(F.collect_list(F.struct("part_num", "filename"))).alias("p"))
    h = c.hwids.groupBy("driver_id").agg(F.array_sort(F.collect_list(F.struct("is_generic", "hwid_string"))).alias("h"))
    text = lambda a, f: F.coalesce(F.array_join(F.transform(a, lambda x: x[f]), ","), F.lit(""))
    return c.drivers.select("driver_id").join(p, "driver_id", "left").join(h, "driver_id", "left").select("driver_id", text("p", "filename").alias("parts"), text("h", "hwid_string").alias("hwids"))


@query("join_live_bulk", "SELECT d.driver_id, count(*) AS parts FROM drivers d JOIN driver_parts p ON d.driver_id = p.driver_id WHERE d.enabled GROUP BY d.driver_id", "drivers driver_parts")
def _(c: Catalog):
    asked = c.drivers.select("driver_id")
    live = asked.join(c.drivers.where("enabled").select("driver_id"), "driver_id")
    return live.join(c.driver_parts, "driver_id").groupBy("driver_id").agg(F.count("*").alias("parts"))


@query("anti_no_hwid", "SELECT e.driver_id FROM entries e LEFT JOIN (SELECT DISTINCT driver_id FROM hwids WHERE NOT is_generic) h ON h.driver_id = e.driver_id WHERE h.driver_id IS NULL", "entries hwids")
def _(c: Catalog):
    return c.entries.select("driver_id").join(c.hwids.where("NOT is_generic").select("driver_id").distinct(), "driver_id", "left_anti")


VALID = "SELECT driver_id, source_manifest FROM drivers WHERE pos % 4 <> 0"


@query("anti_cleanup", f"SELECT driver_id, source_manifest FROM drivers EXCEPT ({VALID})", "drivers")
def _(c: Catalog):
    return load.orphans(c.drivers.select("driver_id", "source_manifest"), c.drivers.where("pos % 4 <> 0"))


@query("anti_known_ids", "SELECT count(*) AS n FROM hwids WHERE driver_id NOT IN (SELECT driver_id FROM drivers WHERE pos % 2 = 0)", "hwids drivers")
def _(c: Catalog):
    return c.hwids.join(c.drivers.where("pos % 2 = 0").select("driver_id"), "driver_id", "left_anti").agg(F.count("*").alias("n"))


INCOMING = ", i AS (SELECT concat('in', pos) AS in_id, hwids, arch, category, CASE pos % 3 WHEN 1 THEN version ELSE concat(version, '.9') END AS version FROM entries WHERE pos % 2 = 0)"


def _incoming(c: Catalog):
    v = F.when(F.col("pos") % 3 == 1, F.col("version")).otherwise(F.concat("version", F.lit(".9")))
    return c.entries.where("pos % 2 = 0").select(F.concat(F.lit("in"), F.col("pos").cast("string")).alias("in_id"), "hwids", "arch", "category", v.alias("version"))


@query("join_exact_dup", INCOMING + " SELECT in_id, e.driver_id FROM i JOIN entries e ON e.hwids = i.hwids AND e.arch = i.arch AND lower(e.category) = lower(i.category) AND e.version = i.version WHERE len(i.hwids) > 0 AND e.enabled", "entries")
def _(c: Catalog):
    return reconcile.duplicate_audit(_incoming(c), c.entries).where("status = 'exact'").select("in_id", "driver_id")


@query("join_dup_audit", INCOMING + f", a AS (SELECT in_id, e.driver_id, i.version = e.version AS same, row_number() OVER (PARTITION BY in_id ORDER BY i.version = e.version DESC, {fill(VER_B, 'e.version')} DESC, pos) AS r, {fill(VER_B, 'i.version')} AS a, {fill(VER_B, 'e.version')} AS b FROM i JOIN entries e ON e.hwids = i.hwids AND e.arch = i.arch AND lower(e.category) = lower(i.category) WHERE len(i.hwids) > 0 AND e.enabled) SELECT in_id, driver_id, CASE WHEN same THEN 'exact' WHEN a > b THEN 'newer_incoming' ELSE 'older_incoming' END AS status, CASE WHEN same THEN 'skip' WHEN a > b THEN 'replace' ELSE 'keep_new' END AS action FROM a WHERE r = 1", "entries")
def _(c: Catalog):
    return reconcile.duplicate_audit(_incoming(c), c.entries)


def _local(c: Catalog):
    p = F.col("pos")
    h = F.when(p % 5 == 1, F.slice("hwids", 1, F.greatest(F.lit(1), F.size("hwids") - 1))).when(p % 5 == 2, F.array().cast("array<string>")).otherwise(F.col("hwids"))
    arch = F.when(p % 7 == 0, "ia64").otherwise(F.col("arch"))
    return c.held("entries").select(F.concat(F.lit("l"), p.cast("string")).alias("local_id"), h.alias("hwids"), arch.alias("arch"), "category", F.when(p % 2 == 0, F.concat("version", F.lit(".1"))).otherwise(F.col("version")).alias("version"), "provider")


LOCAL = ", l AS (SELECT concat('l', pos) AS local_id, CASE WHEN pos % 5 = 1 THEN hwids[1:greatest(1, len(hwids) - 1)] WHEN pos % 5 = 2 THEN [] ELSE hwids END AS hwids, CASE WHEN pos % 7 = 0 THEN 'ia64' ELSE arch END AS arch, category, CASE WHEN pos % 2 = 0 THEN concat(version, '.1') ELSE version END AS version, provider FROM entries)"
SAME_PROVIDER = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


@query(
    "join_reconcile",
    LOCAL + f""", r AS (SELECT * FROM entries WHERE enabled),
    s AS (SELECT a.local_id, b.driver_id, count(*) AS n FROM (SELECT local_id, unnest(hwids) AS h FROM l) a JOIN (SELECT driver_id, unnest(hwids) AS h FROM r) b ON a.h = b.h GROUP BY 1, 2), x AS (
      SELECT local_id, driver_id, r.pos, r.version AS rv, CASE WHEN l.arch = r.arch AND lower(l.category) = lower(r.category) THEN 1 WHEN l.arch = r.arch THEN 2 ELSE 3 END AS step, 0.0 AS score FROM l JOIN r ON l.hwids = r.hwids AND len(l.hwids) > 0
      UNION ALL SELECT local_id, driver_id, pos, rv, 4, score FROM (SELECT l.local_id, r.driver_id, r.pos, r.version AS rv, n / (len(l.hwids) + len(r.hwids) - n) * CASE WHEN l.arch = r.arch THEN 1.2 ELSE 1.0 END AS score FROM s JOIN l ON l.local_id = s.local_id JOIN r ON r.driver_id = s.driver_id) AS t WHERE score >= 0.25
      UNION ALL SELECT local_id, driver_id, r.pos, r.version, CASE WHEN l.arch = r.arch THEN 5 ELSE 6 END, 0.0 FROM l JOIN r ON {SAME_PROVIDER.format('l.provider')} = {SAME_PROVIDER.format('r.provider')} AND l.provider <> '' AND lower(l.category) = lower(r.category) AND l.category <> ''),
    b AS (SELECT *, row_number() OVER (PARTITION BY local_id ORDER BY step, score DESC, {fill(VER_A, 'rv')} DESC, pos) AS n FROM x)
    SELECT l.local_id, b.driver_id, step, round(score, 6) AS score, CASE WHEN b.driver_id IS NULL THEN 'NEW' WHEN {fill(VER_A, 'l.version')} > {fill(VER_A, 'rv')} THEN 'OUTDATED' ELSE 'CURRENT' END AS status FROM l LEFT JOIN (SELECT * FROM b WHERE n = 1) b ON l.local_id = b.local_id""",
    "entries",
)
def _(c: Catalog):
    return reconcile.reconcile(_local(c), c.held("entries"))


BASKETS = ", s AS (SELECT l_orderkey AS id, list_sort(list(DISTINCT concat('p', l_partkey))) AS hwids FROM lineitem GROUP BY l_orderkey), c AS (SELECT min(id) AS id, hwids FROM s GROUP BY hwids)"


@query("join_jaccard", BASKETS + """, e AS (SELECT id, unnest(hwids) AS h FROM c), p AS (SELECT a.id AS a_id, b.id AS b_id, count(*) AS n FROM e a JOIN e b ON a.h = b.h AND a.id < b.id GROUP BY 1, 2)
SELECT a_id, b_id, round(n / (len(x.hwids) + len(y.hwids) - n), 6) AS jaccard FROM p JOIN c x ON x.id = a_id JOIN c y ON y.id = b_id WHERE n >= 0.5 * (len(x.hwids) + len(y.hwids) - n)
UNION ALL SELECT c.id, s.id, 1.0 FROM s JOIN c ON s.hwids = c.hwids WHERE s.id <> c.id""")
def _(c: Catalog):
    s = c.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set(F.concat(F.lit("p"), F.col("l_partkey").cast("string"))).alias("hwids"))
    return reconcile.self_overlaps(s, 0.5)


@query("join_hwid_class", LOCAL + " SELECT DISTINCT l.local_id, e.driver_id FROM (SELECT local_id, category, unnest(hwids) AS h FROM l) l JOIN (SELECT driver_id, CASE WHEN pos % 4 = 0 THEN '' ELSE category END AS category, unnest(hwids) AS h FROM entries) e ON l.h = e.h WHERE e.category = '' OR lower(l.category) = lower(e.category)", "entries")
def _(c: Catalog):
    remote = c.held("entries").select("driver_id", F.when(F.col("pos") % 4 == 0, "").otherwise(F.col("category")).alias("category"), "hwids")
    return reconcile.class_matches(_local(c), remote)


PADDED = "list_concat({0}, list_resize(cast([] AS bigint[]), greatest(len({1}) - len({0}), 0), 0))"


@query("classify_upload", LOCAL + f", m AS (SELECT DISTINCT l.local_id, l.version AS lv, e.version AS rv, e.driver_id FROM (SELECT local_id, version, category, unnest(hwids) AS h FROM l) l JOIN (SELECT driver_id, version, category, unnest(hwids) AS h FROM entries) e ON l.h = e.h AND lower(l.category) = lower(e.category)), v AS (SELECT local_id, {fill(VER_C, 'lv')} AS a, {fill(VER_C, 'rv')} AS b FROM m), g AS (SELECT local_id, bool_and({fill(PADDED, 'a', 'b')} > {fill(PADDED, 'b', 'a')}) AS newer FROM v GROUP BY local_id) SELECT l.local_id, CASE WHEN newer IS NULL THEN 'missing' WHEN newer THEN 'updated' ELSE 'present' END AS status FROM l LEFT JOIN g ON l.local_id = g.local_id", "entries")
def _(c: Catalog):
    return reconcile.classify_uploads(_local(c).withColumn("driver_date", F.lit("")), c.held("entries").withColumn("driver_date", F.lit("")))


@query("join_conflict", "SELECT hwid, files, versions, archs FROM (SELECT hwid_string AS hwid, count(DISTINCT h.driver_id) AS files, count(DISTINCT d.version) AS versions, count(DISTINCT d.arch) AS archs FROM hwids h JOIN drivers d ON d.driver_id = h.driver_id GROUP BY hwid_string) AS t WHERE files > 1 AND (versions > 1 OR archs > 1)", "hwids drivers")
def _(c: Catalog):
    return reconcile.conflicts(c.held("entries").select(F.col("driver_id").alias("file"), "version", "arch", "hwids"))


@query("join_type_map", "SELECT d.driver_id, r_name AS type, count(*) AS parts FROM drivers d JOIN driver_parts p ON d.driver_id = p.driver_id LEFT JOIN region ON r_regionkey = d.pos % 7 GROUP BY d.driver_id, r_name", "drivers driver_parts")
def _(c: Catalog):
    types = c.region.select(F.col("r_regionkey").cast("long").alias("k"), F.col("r_name").alias("type"))
    typed = c.drivers.withColumn("k", F.col("pos") % 7).join(types, "k", "left")
    return typed.join(c.driver_parts.groupBy("driver_id").agg(F.count("*").alias("parts")), "driver_id").select("driver_id", "type", "parts")


# ---- aggregations


@query("agg_stats", "SELECT (SELECT count(*) FROM entries) AS drivers, (SELECT count(DISTINCT provider) FROM entries WHERE provider <> '') AS providers, (SELECT count(*) FROM entries WHERE NOT enabled) AS disabled, (SELECT count(*) FROM hwids) AS hwids, (SELECT count(*) FROM entries WHERE driver_id NOT IN (SELECT driver_id FROM hwids)) AS without_hwid, (SELECT id FROM sync_log ORDER BY run_at DESC, id DESC LIMIT 1) AS last_sync_id", "entries hwids sync_log")
def _(c: Catalog):
    return aggregates.stats(c.entries, c.hwids, c.sync_log)


@query("agg_facets", "SELECT 'category' AS facet, category AS value, count(*) AS n FROM drivers WHERE enabled AND category <> '' GROUP BY category UNION ALL SELECT 'provider', provider, count(*) FROM drivers WHERE enabled AND provider <> '' GROUP BY provider UNION ALL SELECT 'arch', arch, count(*) FROM drivers WHERE enabled GROUP BY arch", "drivers")
def _(c: Catalog):
    return aggregates.facets(c.drivers)


@query("agg_category_summary", "SELECT coalesce(nullif(driver_type, ''), nullif(category, ''), 'Other') AS category, count(*) AS n FROM entries WHERE enabled GROUP BY 1", "entries")
def _(c: Catalog):
    return aggregates.category_summary(c.entries)


@query("agg_category_by_file", "SELECT regexp_replace(source_manifest, '\\.manifest.*$', '') AS category, count(*) AS n FROM drivers WHERE enabled GROUP BY 1", "drivers")
def _(c: Catalog):
    return aggregates.category_by_file(c.drivers)


@query("agg_off_stem", "SELECT source_manifest, count(*) AS n FROM drivers WHERE enabled AND driver_type <> regexp_replace(source_manifest, '\\.manifest.*$', '') GROUP BY 1", "drivers")
def _(c: Catalog):
    return aggregates.off_stem(c.drivers)


@query("agg_total_enabled", "SELECT count(*) AS n FROM entries WHERE enabled", "entries")
def _(c: Catalog):
    return c.entries.where("enabled").agg(F.count("*").alias("n"))


VOTES = ", v AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS pos, CASE l_suppkey % 5 WHEN 0 THEN 'USB' WHEN 1 THEN 'HDAUDIO' WHEN 2 THEN 'PCI' WHEN 3 THEN 'HID' ELSE 'FOO' END AS p FROM lineitem)"


def _votes(c: Catalog):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    m = F.col("l_suppkey") % 5
    p = F.when(m == 0, "USB").when(m == 1, "HDAUDIO").when(m == 2, "PCI").when(m == 3, "HID").otherwise("FOO")
    return c.lineitem.select(F.col("l_orderkey").alias("k"), F.row_number().over(w).alias("pos"), p.alias("p"))


@query("agg_vote_type", VOTES + ", t AS (SELECT k, pos, CASE p WHEN 'USB' THEN 'USB' WHEN 'HDAUDIO' THEN 'Audio' WHEN 'PCI' THEN 'Chipset' WHEN 'HID' THEN 'Input' END AS t FROM v), g AS (SELECT k, t, count(*) AS n, min(pos) AS f FROM t WHERE t IS NOT NULL GROUP BY k, t), b AS (SELECT k, t, row_number() OVER (PARTITION BY k ORDER BY n DESC, f) AS r FROM g) SELECT a.k, CASE WHEN a.k % 6 = 0 THEN 'Net' ELSE coalesce(b.t, 'Other') END AS driver_type FROM (SELECT DISTINCT k FROM v) a LEFT JOIN (SELECT * FROM b WHERE r = 1) b ON a.k = b.k")
def _(c: Catalog):
    g = _votes(c).groupBy("k").agg(F.array_sort(F.collect_list(F.struct("pos", F.concat("p", F.lit("\\A")).alias("h")))).alias("x"))
    recs = g.select("k", F.transform("x", lambda x: x["h"]).alias("hwids"), F.array().cast("array<string>").alias("compatible_ids"), F.when(F.col("k") % 6 == 0, " NetTrans ").otherwise("nothing").alias("category"))
    return aggregates.driver_type(recs, "k")


@query("agg_vote_group", VOTES + ", g AS (SELECT k, p, count(*) AS n, min(pos) AS f FROM v GROUP BY k, p), b AS (SELECT k, p, row_number() OVER (PARTITION BY k ORDER BY n DESC, f) AS r FROM g) SELECT k, p FROM b WHERE r = 1")
def _(c: Catalog):
    return aggregates.majority(_votes(c), "k", "p", "pos")


@query("agg_pack_name", ", m AS (SELECT pack, c, v, row_number() OVER (PARTITION BY pack, c ORDER BY n DESC, f) AS r FROM (SELECT pack, c, v, count(*) AS n, min(pos) AS f FROM (SELECT pack, pos, unnest([1, 2, 3]) AS c, unnest([provider, category, arch]) AS v FROM drivers) AS u WHERE v <> '' GROUP BY pack, c, v) AS w) SELECT pack AS folder, string_agg(v, '_' ORDER BY c) AS name FROM m WHERE r = 1 GROUP BY pack", "drivers")
def _(c: Catalog):
    return aggregates.pack_name(c.drivers.withColumn("folder", F.col("pack")))


@query("agg_folder_groups", "SELECT pack AS folder, string_agg(concat(pack, '/', driver_id, '.inf'), ',' ORDER BY concat(pack, '/', driver_id, '.inf')) AS files FROM drivers GROUP BY pack", "drivers")
def _(c: Catalog):
    files = c.drivers.select(F.concat("pack", F.lit("/"), "driver_id", F.lit(".inf")).alias("path"))
    return aggregates.folder_groups(files).select("folder", F.array_join("files", ",").alias("files"))


@query("agg_folder_record", f", e AS (SELECT pack, pos, provider, version, date_added, hwids, {fill(VER_C, 'version')} AS v FROM entries), h AS (SELECT pack, string_agg(h, ',' ORDER BY h) AS hwids FROM (SELECT DISTINCT pack, unnest(hwids) AS h FROM e) AS u GROUP BY pack), v AS (SELECT pack, version, row_number() OVER (PARTITION BY pack ORDER BY v DESC, pos) AS r FROM e), p AS (SELECT pack, provider, row_number() OVER (PARTITION BY pack ORDER BY pos) AS r FROM e WHERE provider <> '') SELECT e.pack AS folder, h.hwids, v.version, max(e.date_added) AS driver_date, p.provider, count(*) AS files FROM e JOIN h ON h.pack = e.pack JOIN v ON v.pack = e.pack AND v.r = 1 JOIN p ON p.pack = e.pack AND p.r = 1 GROUP BY e.pack, h.hwids, v.version, p.provider", "entries")
def _(c: Catalog):
    rows = c.entries.select(F.col("pack").alias("folder"), "pos", "provider", "version", F.col("date_added").alias("driver_date"), "hwids")
    return aggregates.folder_records(rows).withColumn("hwids", F.array_join("hwids", ","))


@query("agg_representative", "SELECT pack, driver_id FROM (SELECT pack, driver_id, row_number() OVER (PARTITION BY pack ORDER BY len(hwids) DESC, pos) AS r FROM entries) AS t WHERE r = 1", "entries")
def _(c: Catalog):
    return aggregates.representative(c.entries, "pack").select("pack", "driver_id")


@query("agg_installer_pkg", "SELECT pack AS package, count(*) AS exes, max_by(concat(pack, '/x/', driver_id, '.exe'), struct_pack(s := pos % 9, p := concat(pack, '/x/', driver_id, '.exe'))) AS representative, cast(sum(pos % 9) AS bigint) AS bytes FROM drivers GROUP BY pack", "drivers")
def _(c: Catalog):
    return aggregates.installer_packages(c.drivers.select(F.concat("pack", F.lit("/x/"), "driver_id", F.lit(".exe")).alias("path"), (F.col("pos") % 9).alias("size")))


@query("agg_unique_stems", "SELECT pos, p_name AS stem, CASE WHEN count(*) OVER (PARTITION BY p_name) = 1 THEN p_name ELSE concat(p_name, '_', row_number() OVER (PARTITION BY p_name ORDER BY pos)) END AS name FROM (SELECT p_partkey AS pos, p_name FROM part) AS t")
def _(c: Catalog):
    return aggregates.unique_stems(c.part.select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("stem")))


@query("agg_status_summary", "SELECT o_orderstatus AS status, count(*) AS n, cast(sum(o_custkey) AS bigint) AS bytes, round(sum(o_custkey) / sum(o_orderkey % 10 + 1), 6) AS speed FROM orders GROUP BY 1")
def _(c: Catalog):
    return aggregates.status_summary(c.orders.select(F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("bytes"), (F.col("o_orderkey") % 10 + 1).alias("seconds")))


@query("agg_manifest_summary", "SELECT driver_id, count(*) AS parts, cast(sum(size_bytes) AS bigint) AS bytes FROM driver_parts GROUP BY ROLLUP (driver_id)", "driver_parts")
def _(c: Catalog):
    return aggregates.manifest_summary(c.driver_parts)


@query("agg_zip_bytes", "SELECT driver_id, cast(sum(size_bytes) AS bigint) AS bytes FROM driver_parts GROUP BY driver_id", "driver_parts")
def _(c: Catalog):
    g = c.driver_parts.groupBy("driver_id").agg(F.collect_list(F.struct("part_num", "size_bytes")).alias("parts"))
    return g.select("driver_id", aggregates.zip_bytes(F.col("parts")).alias("bytes"))


@query("agg_run_counters", "SELECT count(*) AS seen, count(*) FILTER (pos % 4 = 1 OR pos % 4 = 2) AS upserted, count(*) FILTER (pos % 4 = 3) AS filtered, count(*) FILTER (pos % 4 = 0) AS skipped, count(*) FILTER (enabled IS NULL) AS null_enabled, cast(coalesce(sum(zip_parts) FILTER (pos % 4 = 1 OR pos % 4 = 2), 0) AS bigint) AS hwids_upserted FROM drivers", "drivers")
def _(c: Catalog):
    m = F.col("pos") % 4
    status = F.when(m == 0, "rejected").when(m == 3, "filtered").otherwise("ok")
    return load.counters(c.drivers.select(status.alias("status"), F.col("enabled").isNull().alias("null_enabled"), F.col("zip_parts").alias("hwids")))


@query("agg_storage_pct", "SELECT o_orderkey, round(100.0 * (o_orderkey * 300000) / 5368709120, 6) AS pct, CASE WHEN round(100.0 * (o_orderkey * 300000) / 5368709120, 6) >= 95 THEN 'fail' WHEN round(100.0 * (o_orderkey * 300000) / 5368709120, 6) >= 80 THEN 'warn' ELSE 'ok' END AS state FROM orders")
def _(c: Catalog):
    return c.orders.select("o_orderkey", aggregates.storage((F.col("o_orderkey") * 300000).cast("double")).alias("s")).select("o_orderkey", "s.pct", "s.state")


@query("agg_bulk_counts", "SELECT count(*) FILTER (o_orderstatus = 'F') AS skipped, count(*) FILTER (o_orderstatus = 'O') AS replaced, count(*) FILTER (o_orderstatus = 'P') AS kept FROM orders")
def _(c: Catalog):
    s = F.col("o_orderstatus")
    return c.orders.agg(F.count_if(s == "F").alias("skipped"), F.count_if(s == "O").alias("replaced"), F.count_if(s == "P").alias("kept"))


# ---- distinct, windows, lineage


@query("dst_signature", "SELECT pos FROM (SELECT pos, hwids, row_number() OVER (PARTITION BY hwids, arch ORDER BY pos) AS r FROM (SELECT pos, arch, hwids[1:1] AS hwids FROM entries) AS u) AS t WHERE r = 1 OR len(hwids) = 0", "entries")
def _(c: Catalog):
    e = c.entries.select("pos", "arch", F.slice("hwids", 1, 1).alias("hwids"))
    return aggregates.first_per(e, F.concat_ws("::", F.array_join("hwids", "|"), "arch"), "pos", F.size("hwids") == 0).select("pos")


@query("dst_files", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY sha256(text)")
def _(c: Catalog):
    return aggregates.first_per(c.documents.select("doc_id", F.sha2("text", 256).alias("sha")), F.col("sha"), "doc_id", F.col("sha").isNull()).select("doc_id")


@query("dst_entry_id", "SELECT min(pos) AS pos, driver_id FROM (SELECT pos, concat('e', pos % 100) AS driver_id FROM drivers) AS t WHERE driver_id NOT IN (SELECT concat('e', n_nationkey) FROM nation) GROUP BY driver_id", "drivers")
def _(c: Catalog):
    new = c.drivers.select("pos", F.concat(F.lit("e"), (F.col("pos") % 100).cast("string")).alias("driver_id"))
    return aggregates.new_entries(new, c.nation.select(F.concat(F.lit("e"), F.col("n_nationkey").cast("string")).alias("driver_id")))


@query("win_best_version", f"SELECT pack, driver_id FROM (SELECT pack, driver_id, row_number() OVER (PARTITION BY pack ORDER BY {fill(VER_B, 'version')} DESC, pos) AS r FROM entries WHERE enabled) AS t WHERE r = 1", "entries")
def _(c: Catalog):
    return lineage.best_version(c.entries, ["pack"]).select("pack", "driver_id")


SUPERSEDE = f""", e AS (SELECT driver_id, pack, enabled, pos, {fill(VER_B, 'version')} AS v, CASE WHEN pos % 2 = 0 THEN 0 ELSE 1 END AS is_new FROM entries),
 best AS (SELECT driver_id, pack, v, pos, 0 AS is_new FROM (SELECT *, row_number() OVER (PARTITION BY pack ORDER BY v DESC, pos) AS r FROM e WHERE is_new = 0 AND enabled) AS t WHERE r = 1),
 line AS (SELECT *, max(v) OVER (PARTITION BY pack ORDER BY is_new, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM (SELECT * FROM best UNION ALL SELECT driver_id, pack, v, pos, is_new FROM e WHERE is_new = 1) AS u),
 heads AS (SELECT driver_id, lag(driver_id) OVER (PARTITION BY pack ORDER BY is_new, pos) AS s, lead(driver_id) OVER (PARTITION BY pack ORDER BY is_new, pos) AS b FROM line WHERE top IS NULL OR v > top)
 SELECT e.driver_id, e.enabled AND b IS NULL AS enabled, CASE WHEN e.is_new = 1 THEN s END AS supersedes, b AS superseded_by FROM e LEFT JOIN heads h ON e.driver_id = h.driver_id"""


@query("win_supersede", SUPERSEDE, "entries")
def _(c: Catalog):
    e = c.entries.select("driver_id", "enabled", "version", "pos", F.col("pack").alias("category"), F.lit("x").alias("arch"), F.array(F.lit("h")).alias("hwids"))
    return lineage.supersede(e.where("pos % 2 = 0"), e.where("pos % 2 = 1")).drop("note")


CHAIN = ", m AS (SELECT driver_id, chain, date_added, enabled, superseded_by, row_number() OVER (PARTITION BY chain ORDER BY date_added, driver_id) AS n, count(*) OVER (PARTITION BY chain) AS size FROM (SELECT *, min(driver_id) OVER (PARTITION BY chain) AS low FROM chains) AS c), h AS (SELECT chain, coalesce(min(n) FILTER (enabled AND superseded_by IS NULL), max(n)) AS head FROM m GROUP BY chain)"


@query("win_version_chain", "SELECT driver_id, min(driver_id) OVER (PARTITION BY chain) AS chain FROM chains", "chains")
def _(c: Catalog):
    return lineage.version_chains(c.chains)


@query("win_head", CHAIN + " SELECT m.driver_id, m.n, m.n = h.head AS is_current FROM m JOIN h ON m.chain = h.chain", "chains")
def _(c: Catalog):
    return lineage.with_head(c.chains).select("driver_id", "n", "is_current")


@query("win_shard_seal", "SELECT o_custkey AS category, o_orderkey AS shard, o_totalprice >= 300000 OR lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) IS NOT NULL AS sealed FROM orders")
def _(c: Catalog):
    s = c.orders.select(F.col("o_custkey").alias("category"), F.col("o_orderkey").alias("shard"), F.col("o_totalprice").alias("size_bytes"))
    return shards.seal(s, 300000).select("category", "shard", "sealed")


@query("win_seq_check", ", v AS (SELECT concat('a', o_custkey) AS stem, o_orderkey % 12 + 1 AS number, o_orderkey % 11 AS size FROM orders), g AS (SELECT stem, count(*) AS volumes, count(DISTINCT number) AS d, max(number) AS hi, count(*) FILTER (size = 0) AS empty FROM v GROUP BY stem), m AS (SELECT stem, coalesce(string_agg(cast(i AS varchar), ',' ORDER BY i) FILTER (i IS NOT NULL), '') AS missing FROM (SELECT g.stem, r.i FROM g JOIN (SELECT unnest(range(1, 13)) AS i) r ON r.i <= g.hi WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.stem = g.stem AND v.number = r.i)) AS t GROUP BY stem) SELECT g.stem, volumes, coalesce(missing, '') AS missing, volumes - d AS duplicates, empty, CASE WHEN volumes > d THEN 'duplicate' WHEN coalesce(missing, '') <> '' THEN 'missing' WHEN empty > 0 THEN 'corrupt' ELSE 'ok' END AS state FROM g LEFT JOIN m ON g.stem = m.stem")
def _(c: Catalog):
    v = c.orders.select(F.concat(F.lit("a"), F.col("o_custkey").cast("string")).alias("stem"), (F.col("o_orderkey") % 12 + 1).cast("int").alias("number"), (F.col("o_orderkey") % 11).alias("size"))
    return shards.volume_check(v)


# ---- search, sorting and paging



def _search_sql(tokens: list[str]) -> str:
    best = lambda t: "greatest(" + ", ".join(f"({fill(TOKEN, n, t)}) * {w}" for n, w in (("display_name", 1.4), ("provider", 1.2), ("driver_id", 1.15), ("category", 1.0), ("driver_type", 1.0), ("cast(to_json(descriptions) AS varchar)", 1.0), ("pack", 0.9), ("version", 0.85), ("arch", 0.7), ("source_manifest", 0.6), ("cast(to_json(os_targets) AS varchar)", 0.55))) + ")"
    return f", s AS (SELECT driver_id, enabled, date_added, display_name, pos, {', '.join(f'{best(t)} AS s{i}' for i, t in enumerate(tokens))} FROM drivers WHERE enabled)"


@query("srt_text_rank", _search_sql(["wigdet", "blue"]) + " SELECT driver_id, round(s0 + s1, 6) AS score, row_number() OVER (ORDER BY s0 + s1 DESC, date_added DESC NULLS LAST, driver_id) AS rank FROM s WHERE s0 > 0.0001 AND s1 > 0.0001", "drivers")
def _(c: Catalog):
    found = search.text_matches(search.facet_filter(c.spread("drivers")), "wigdet blue")
    return search.ranked(found).select("driver_id", F.round("score", 6).alias("score"), "rank")


@query("search_envelope", _search_sql(["wigdet", "blue"]) + " SELECT count(*) FILTER (s0 > 0.0001 AND s1 > 0.0001) AS total, 2 AS page, 10 AS page_size, 'text' AS mode, count(*) AS candidates_scanned, false AS candidate_cap_hit FROM s", "drivers")
def _(c: Catalog):
    return search.envelope(c.drivers, c.hwids, "wigdet blue", page=2, size=10)


@query("search_indexed", _search_sql(["wigdet", "blue"]) + " SELECT driver_id, round(s0 + s1, 6) AS score FROM s WHERE s0 > 0.0001 AND s1 > 0.0001", "drivers")
def _(c: Catalog):
    index = search_index.build(c.spread("drivers"), shared_path(c.spark, "index"))
    found, _ = search_index.indexed_search(index, "wigdet blue", where="enabled")
    return found.select("driver_id", F.round("score", 6).alias("score"))


@query("search_negation", _search_sql(["blue", "x64"]) + " SELECT driver_id, round(s0, 6) AS score FROM s WHERE s0 > 0.0001 AND s1 <= 0.0001", "drivers")
def _(c: Catalog):
    return search.text_search(search.facet_filter(c.spread("drivers")), "blue -x64").select("driver_id", F.round("score", 6).alias("score"))


@query("search_scoped", "SELECT driver_id FROM drivers WHERE enabled AND provider <> '' AND arch = 'x64'", "drivers")
def _(c: Catalog):
    return search.text_search(search.facet_filter(c.drivers), 'vendor:brand#1 arch:"x64"').select("driver_id")


@query("search_hwid_mode", r", q AS (SELECT min(hwid_string) AS q FROM hwids WHERE NOT is_generic) SELECT d.driver_id FROM drivers d JOIN hwids h ON h.driver_id = d.driver_id JOIN q ON h.hwid_string = q.q WHERE d.enabled", "drivers hwids")
def _(c: Catalog):
    q = c.hwids.where("NOT is_generic").agg(F.min("hwid_string")).first()[0]
    return search.search(c.drivers, c.hwids, q + "&REV_A1", size=100).select("driver_id")


@query("search_reference_candidates", _search_sql(["gizm"]) + ", n AS (SELECT driver_id, row_number() OVER (ORDER BY pos DESC, driver_id) AS r FROM drivers WHERE enabled AND (contains(lower(coalesce(display_name, '')), 'gizm') OR contains(lower(cast(to_json(descriptions) AS varchar)), 'gizm') OR contains(lower(provider), 'gizm') OR contains(lower(category), 'gizm') OR contains(lower(pack), 'gizm'))) SELECT s.driver_id, round(s0, 6) AS score FROM s JOIN n ON n.driver_id = s.driver_id WHERE r <= 100 AND s0 > 0.0001", "drivers")
def _(c: Catalog):
    d = search.facet_filter(c.drivers).withColumn("updated_at", F.col("pos"))
    return search.text_search(d, "gizm", candidates="reference", cap=100).select("driver_id", F.round("score", 6).alias("score"))


@query("srt_browse", "SELECT driver_id, display_name FROM drivers WHERE enabled ORDER BY lower(display_name) NULLS FIRST, driver_id LIMIT 25 OFFSET 25", "drivers")
def _(c: Catalog):
    return search.browse(search.facet_filter(c.drivers), 2).select("driver_id", "display_name")


@query("srt_page", "SELECT driver_id FROM drivers ORDER BY driver_id LIMIT 40 OFFSET 80", "drivers")
def _(c: Catalog):
    offset, limit = search.page_of(3, 40)
    return c.drivers.orderBy("driver_id").offset(offset).limit(limit).select("driver_id")


@query("srt_topk_candidates", "SELECT id FROM sync_log ORDER BY run_at DESC, id LIMIT 500", "sync_log")
def _(c: Catalog):
    return c.sync_log.orderBy(F.desc("run_at"), "id").limit(500).select("id")


@query("srt_id_prefix", "SELECT driver_id FROM drivers WHERE starts_with(driver_id, 'drv-a') ORDER BY driver_id LIMIT 50", "drivers")
def _(c: Catalog):
    return search.id_lookup(c.drivers, " DRV-A").select("driver_id")


@query("srt_history_tail", "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 10")
def _(c: Catalog):
    return c.orders.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(10).select("o_orderkey")


# ---- set operations


@query("set_union_manifests", "SELECT source_manifest, count(*) AS n FROM (SELECT source_manifest FROM drivers WHERE pos % 2 = 0 UNION ALL SELECT source_manifest FROM drivers WHERE pos % 3 = 0) AS t GROUP BY 1", "drivers")
def _(c: Catalog):
    d = c.drivers.select("source_manifest", "pos")
    return d.where("pos % 2 = 0").unionByName(d.where("pos % 3 = 0")).groupBy("source_manifest").agg(F.count("*").alias("n"))


@query("set_union_hwids", "SELECT pos, len(hwids) + 1 AS n FROM entries", "entries")
def _(c: Catalog):
    return c.entries.select("pos", F.size(F.array_union("hwids", F.concat(F.slice("hwids", 1, 1), F.array(F.lit("X"))))).cast("long").alias("n"))


@query("set_known_union", "SELECT category FROM drivers UNION SELECT r_name FROM region", "drivers")
def _(c: Catalog):
    return c.drivers.select("category").union(c.region.select("r_name")).distinct()


@query("set_except_orphans", f"SELECT driver_id FROM drivers EXCEPT SELECT driver_id FROM ({VALID}) AS v", "drivers")
def _(c: Catalog):
    return load.orphans(c.drivers.select("driver_id", "source_manifest"), c.drivers.where("pos % 4 <> 0")).select("driver_id")


@query("set_except_resume", "SELECT driver_id, part_num FROM driver_parts WHERE NOT (part_num % 3 = 0 AND part_num % 2 = 0) AND part_num % 5 <> 0", "driver_parts")
def _(c: Catalog):
    p = c.driver_parts.select("driver_id", "part_num")
    done = p.where("part_num % 3 = 0").join(p.where("part_num % 2 = 0"), ["driver_id", "part_num"], "left_semi")
    return p.join(done, ["driver_id", "part_num"], "left_anti").join(p.where("part_num % 5 = 0"), ["driver_id", "part_num"], "left_anti")


@query("set_intersect_hwids", ", p AS (SELECT a.pos, a.hwids AS x, b.hwids AS y FROM entries a JOIN entries b ON b.pos = a.pos + 10) SELECT pos, len(list_intersect(x, y)) AS n FROM p", "entries")
def _(c: Catalog):
    b = c.entries.select((F.col("pos") - 10).alias("pos"), F.col("hwids").alias("y"))
    return c.entries.select("pos", "hwids").join(b, "pos").select("pos", F.size(F.array_intersect("hwids", "y")).cast("long").alias("n"))


@query("guard_never_shrink", "SELECT count(*) AS after_rows, true AS ok FROM entries", "entries")
def _(c: Catalog):
    e = c.entries
    n = e.count()
    load.guard_never_shrink(e.where("pos % 2 = 0").count(), e.where("pos % 2 = 1").count(), n)
    return e.agg(F.count("*").alias("after_rows")).withColumn("ok", F.lit(True))


@query("fn_version_defects", f"SELECT s, {fill(VER_A, 's')}[1] AS a FROM (SELECT unnest(['10/15/2023', 'v2.1.3-beta4', 'Release 5 (build 12)', '']) AS s) AS t")
def _(c: Catalog):
    s = c.spark.createDataFrame([("10/15/2023",), ("v2.1.3-beta4",), ("Release 5 (build 12)",), ("",)], "s string")
    return s.select("s", F.get(versions.version_digits(F.col("s")), F.lit(0)).alias("a"))
