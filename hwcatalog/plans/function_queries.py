"""Queries of the scalar functions, filters and projections over the catalog views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hwid, ids, text, versions
from ..operators import load, search, shards
from .registry import query
from .views import Catalog



def fill(sql: str, *args: str) -> str:
    """``sql`` with {0}, {1}, … replaced; other braces stay."""
    for i, a in enumerate(args):
        sql = sql.replace(f"{{{i}}}", a)
    return sql


joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ".")
B = "array_to_string({}, '.')"
DATE = r"'^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}\s*,\s*'"
VER_A = f"(SELECT CASE WHEN len(x) = 0 THEN [0] ELSE x END FROM (SELECT list_transform(regexp_extract_all(regexp_replace(regexp_replace(trim({{0}}), '^[vV]', ''), {DATE}, ''), '[0-9]+'), lambda x: cast(x AS bigint)) AS x))"
VER_B = f"list_transform(list_filter(list_transform(regexp_split_to_array(regexp_replace({{0}}, {DATE}, ''), '[.,-]'), lambda x: trim(x)), lambda x: regexp_full_match(x, '[0-9]+')), lambda x: cast(x AS bigint))"
VER_C = "list_transform(string_split(replace(string_split(string_split(regexp_replace(trim({0}), '^[vV]+', ''), '-')[1], '+')[1], '_', '.'), '.'), lambda x: coalesce(try_cast(regexp_replace(x, '[^0-9]', '', 'g') AS bigint), 0))"


@query("fn_ver_a", f"SELECT driver_id, {B.format(fill(VER_A, 'version'))} AS v FROM drivers", "drivers")
def _(c: Catalog):
    return c.drivers.select("driver_id", joined(versions.version_digits(F.col("version"))).alias("v"))


@query("fn_ver_b", f"SELECT driver_id, {B.format(fill(VER_B, 'version'))} AS v FROM drivers", "drivers")
def _(c: Catalog):
    return c.drivers.select("driver_id", joined(versions.version_pieces(F.col("version"))).alias("v"))


@query("fn_ver_c", f"SELECT driver_id, {B.format(fill(VER_C, 'version'))} AS v FROM drivers", "drivers")
def _(c: Catalog):
    return c.drivers.select("driver_id", joined(versions.version_chunks(F.col("version"))).alias("v"))


@query("fn_ver_cmp", f", v AS (SELECT pack, pos, driver_id, {fill(VER_A, 'version')} AS v FROM drivers), w AS (SELECT driver_id, v, lag(v) OVER (PARTITION BY pack ORDER BY pos) AS p FROM v) SELECT driver_id, CASE WHEN v > p THEN 1 WHEN v < p THEN -1 ELSE 0 END AS cmp, coalesce(v > p, false) AS newer FROM w", "drivers")
def _(c: Catalog):
    from pyspark.sql import Window

    d = c.drivers.withColumn("v", versions.version_digits(F.col("version"))).withColumn("p", F.lag("v").over(Window.partitionBy("pack").orderBy("pos")))
    return d.select("driver_id", versions.compare(F.col("v"), F.col("p")).alias("cmp"), F.coalesce(F.col("v") > F.col("p"), F.lit(False)).alias("newer"))


@query("fn_driver_date", "SELECT o_orderkey, y, m, d FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN CASE WHEN yy < 70 THEN 2000 + yy ELSE 1900 + yy END ELSE year(o_orderdate) END AS y, CASE WHEN o_orderkey % 5 <> 0 THEN month(o_orderdate) END AS m, CASE WHEN o_orderkey % 5 <> 0 THEN day(o_orderdate) END AS d FROM (SELECT *, year(o_orderdate) % 100 AS yy FROM orders) AS o) AS t")
def _(c: Catalog):
    o = F.col("o_orderdate")
    y = F.when(F.col("o_orderkey") % 2 == 0, F.lpad((F.year(o) % 100).cast("string"), 2, "0")).otherwise(F.year(o).cast("string"))
    s = F.when(F.col("o_orderkey") % 5 == 0, "not a date").otherwise(F.concat_ws("/", F.month(o), F.dayofmonth(o), y))
    return c.orders.select("o_orderkey", versions.driver_date(s).alias("t")).select("o_orderkey", "t.y", "t.m", "t.d")


@query("fn_local_newer", f", v AS (SELECT driver_id, {fill(VER_C, 'version')} AS a, {fill(VER_C, 'other')} AS b FROM (SELECT *, lead(version, 1, '') OVER (ORDER BY pos) AS other FROM drivers)), w AS (SELECT driver_id, list_concat(a, list_resize(cast([] AS bigint[]), greatest(len(b) - len(a), 0), 0)) AS a, list_concat(b, list_resize(cast([] AS bigint[]), greatest(len(a) - len(b), 0), 0)) AS b FROM v) SELECT driver_id, a > b AS newer FROM w", "drivers")
def _(c: Catalog):
    nxt = c.drivers.select((F.col("pos") - 1).alias("pos"), F.col("version").alias("other"))
    d = c.drivers.join(nxt, "pos", "left").withColumn("other", F.coalesce("other", F.lit("")))
    return d.select("driver_id", versions.local_newer(F.col("version"), F.lit(""), F.col("other"), F.lit("")).alias("newer"))


@query("fn_norm_hwid", "SELECT driver_id, hwid_string, upper(regexp_replace(concat(' ', lower(hwid_string), ' x'), '\\s+', '', 'g')) AS h, upper(trim(concat(' ', lower(hwid_string), ' '))) AS t FROM hwids", "hwids")
def _(c: Catalog):
    low = F.lower("hwid_string")
    return c.hwids.select("driver_id", "hwid_string", hwid.normalize(F.concat(F.lit(" "), low, F.lit(" x")), inner=True).alias("h"), hwid.normalize(F.concat(F.lit(" "), low, F.lit(" "))).alias("t"))


@query("fn_norm_provider", r"SELECT DISTINCT p_brand, trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(concat(p_brand, ' Technologies, Inc.'))), '\b(inc|corp|corporation|ltd|limited|llc|co|gmbh|ag|sa|bv|pty|pvt|plc|technologies|technology|semiconductor|microsystems|electronics|systems|microelectronics|solutions|group)\b\.?', ' ', 'g'), '[^a-z0-9]', ' ', 'g'), ' +', ' ', 'g')) AS p FROM part")
def _(c: Catalog):
    return c.part.select("p_brand").distinct().select("p_brand", text.normalize_provider(F.concat("p_brand", F.lit(" Technologies, Inc."))).alias("p"))


@query("fn_norm_class", "SELECT DISTINCT category, CASE lower(trim(split_part(category, ' ', 1))) WHEN 'system' THEN 'Chipset' WHEN 'display' THEN 'Display' ELSE lower(trim(split_part(category, ' ', 1))) END AS c FROM (SELECT category FROM drivers UNION ALL SELECT 'System' UNION ALL SELECT 'DISPLAY' UNION ALL SELECT 'chipset') AS t", "drivers")
def _(c: Catalog):
    extra = c.spark.createDataFrame([("System",), ("DISPLAY",), ("chipset",)], "category string")
    return c.drivers.select("category").union(extra).distinct().select("category", text.normalize_class(F.substring_index("category", " ", 1)).alias("c"))


@query("fn_jaccard", ", p AS (SELECT a.pos, a.hwids AS x, b.hwids AS y FROM entries a JOIN entries b ON a.pos + 1 = b.pos) SELECT pos, round(CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) END, 6) AS j FROM p", "entries")
def _(c: Catalog):
    a, b = c.entries.select("pos", F.col("hwids").alias("x")), c.entries.select((F.col("pos") - 1).alias("pos"), F.col("hwids").alias("y"))
    return a.join(b, "pos").select("pos", F.round(text.jaccard(F.col("x"), F.col("y")), 6).alias("j"))


HW = "array_to_string(hwids, '|')"


@query("fn_entry_id", f"SELECT pos, concat('drv-', substr(sha256(CASE WHEN len(hwids) = 0 THEN concat_ws('|', version, arch, lower(category)) ELSE concat_ws('|', {HW}, version, arch, lower(category)) END), 1, 16)) AS id FROM entries WHERE len(hwids) > 0", "entries")
def _(c: Catalog):
    return c.entries.where(F.size("hwids") > 0).select("pos", ids.entry_id(F.col("hwids"), F.col("version"), F.col("arch"), F.col("category")).alias("id"))


@query("fn_installer_id", "SELECT doc_id, concat('inst-', substr(sha256(sha256(text)), 1, 12)) AS id FROM documents")
def _(c: Catalog):
    return c.documents.select("doc_id", ids.installer_id(F.sha2("text", 256)).alias("id"))


SLUG = "trim(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '-')"


@query("fn_legacy_id", f"SELECT pos, concat_ws('-', {SLUG.format('pack')}, {SLUG.format('category')}, {SLUG.format('''CASE WHEN version = '' THEN 'noversion' ELSE version END''')}, arch) AS id FROM drivers", "drivers")
def _(c: Catalog):
    return c.drivers.select("pos", ids.legacy_id(F.col("pack"), F.col("category"), F.col("version"), F.col("arch")).alias("id"))


@query("fn_legacy_name", "SELECT pos, CASE WHEN descriptions[1] <> '' THEN substr(descriptions[1], 1, 64) WHEN provider <> '' AND driver_type <> '' THEN concat(provider, ' ', driver_type, ' [', pack, ']') WHEN provider <> '' THEN concat(provider, ' [', pack, ']') ELSE concat(CASE WHEN driver_type = '' THEN 'Driver' ELSE driver_type END, ' -- ', pack) END AS name FROM drivers", "drivers")
def _(c: Catalog):
    return c.drivers.select("pos", ids.legacy_name(F.col("descriptions"), F.col("provider"), F.col("driver_type"), F.col("pack")).alias("name"))


@query("fn_signature", f"SELECT pos, concat({HW}, '::', version, '::', arch, '::', category) AS sig FROM entries", "entries")
def _(c: Catalog):
    return c.entries.select("pos", ids.signature(F.col("hwids"), F.col("version"), F.col("arch"), F.col("category")).alias("sig"))


@query("fn_group_key", f"SELECT pos, concat(arch, '|', lower(category), '|', {HW}) AS k, concat({HW}, '||', arch, '||', lower(category)) AS legacy FROM entries", "entries")
def _(c: Catalog):
    a = (F.col("hwids"), F.col("arch"), F.col("category"))
    return c.entries.select("pos", ids.group_key(*a).alias("k"), ids.group_key_legacy(*a).alias("legacy"))


@query("fn_slug", f"SELECT p_partkey, {SLUG.format('p_name')} AS slug, concat('manifests/', CASE WHEN regexp_replace(p_type, '[^A-Za-z0-9]', '', 'g') = '' THEN 'Other' ELSE regexp_replace(p_type, '[^A-Za-z0-9]', '', 'g') END, '.manifest.json') AS file FROM part")
def _(c: Catalog):
    return c.part.select("p_partkey", ids.slug(F.col("p_name")).alias("slug"), ids.category_file(F.col("p_type")).alias("file"))


@query("fn_archive_stem", f", t AS (SELECT pos, coalesce(nullif(substr(regexp_replace(lower(provider), '[^a-z0-9]', '', 'g'), 1, 8), ''), 'drv') AS p, coalesce(nullif(substr(regexp_replace(lower(category), '[^a-z0-9]', '', 'g'), 1, 4), ''), 'misc') AS c, CASE arch WHEN 'arm64' THEN 'a64' ELSE substr(arch, 1, 3) END AS a, rtrim(substr(regexp_replace(regexp_replace(trim(version), {DATE}, ''), '[^0-9.]', '', 'g'), 1, 10), '.') AS v FROM drivers) SELECT pos, CASE WHEN v = '' THEN concat_ws('-', p, c, a) ELSE concat_ws('-', p, c, a, v) END AS stem FROM t", "drivers")
def _(c: Catalog):
    return c.drivers.select("pos", ids.archive_stem(F.col("provider"), F.col("category"), F.col("arch"), F.col("version")).alias("stem"))


LADDER = r"(SELECT CASE WHEN strpos(q, '\') = 0 OR len(s) = 0 THEN [q] ELSE list_transform(range(len(s), 0, -1), lambda i: concat(split_part(q, '\', 1), '\', array_to_string(s[1:i], '&'))) END FROM (SELECT {0} AS q, list_filter(string_split(substr({0}, strpos({0}, '\') + 1), '&'), lambda x: x <> '') AS s))"


@query("fn_hwid_ladder", f"SELECT driver_id, hwid_string, array_to_string({fill(LADDER, chr(34) + 'h' + chr(34))}, ' ') AS steps FROM (SELECT driver_id, hwid_string, concat(hwid_string, '&SUBSYS_408A1043&&REV_A1') AS h FROM hwids) AS t", "hwids")
def _(c: Catalog):
    return c.hwids.select("driver_id", "hwid_string", F.array_join(hwid.ladder(F.concat("hwid_string", F.lit("&SUBSYS_408A1043&&REV_A1"))), " ").alias("steps"))


@query("fn_hwid_unescape", r"SELECT driver_id, hwid_string, hwid_string AS h FROM hwids", "hwids")
def _(c: Catalog):
    return c.hwids.select("driver_id", "hwid_string", hwid.unescape(F.concat(F.lit(" "), F.regexp_replace("hwid_string", r"\\", r"\\\\\\\\"))).alias("h"))


@query("fn_is_hwid", r"SELECT q, regexp_matches(q, '(?i)VEN_|DEV_|SUBSYS_|\\') AS h, regexp_matches(trim(q), '(?i)^drv-[0-9a-f]{6,}') AS d FROM (SELECT hwid_string AS q FROM hwids UNION SELECT driver_id FROM drivers UNION SELECT p_name FROM part) AS t", "hwids drivers")
def _(c: Catalog):
    q = c.hwids.select(F.col("hwid_string").alias("q")).union(c.drivers.select("driver_id")).union(c.part.select("p_name")).distinct()
    return q.select("q", hwid.looks_like_hwid(F.col("q")).alias("h"), hwid.looks_like_driver_id(F.col("q")).alias("d"))


@query("fn_osa", ", w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part) SELECT a.w AS word, damerau_levenshtein('large', a.w) <= 1 AS near FROM w a")
def _(c: Catalog):
    w = c.part.select(F.explode(F.split("p_name", " ")).alias("word")).distinct()
    return w.select("word", (search.osa_distance("large", F.col("word")) <= 1).alias("near"))


@query("fn_typo_budget", "SELECT DISTINCT length(p_brand) AS n, CASE WHEN length(p_brand) <= 3 THEN 0 WHEN length(p_brand) <= 7 THEN 1 ELSE 2 END AS budget FROM part")
def _(c: Catalog):
    budget = F.create_map(*(x for i in range(0, 64) for x in (F.lit(i), F.lit(search.typo_budget(i)))))
    return c.part.select(F.length("p_brand").alias("n")).distinct().select("n", F.element_at(budget, F.col("n")).alias("budget"))


TOKEN = "cast(CASE WHEN coalesce({0}, '') = '' THEN 0.0 WHEN lower({0}) = '{1}' THEN 100.0 WHEN starts_with(lower({0}), '{1}') THEN 92.0 WHEN contains(lower({0}), '{1}') THEN 80.0 ELSE coalesce(list_max(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda w: w <> ''), lambda w: CASE WHEN starts_with('{1}', w) THEN 88.0 WHEN damerau_levenshtein('{1}', w) = 0 THEN 76.0 WHEN damerau_levenshtein('{1}', w) = 1 THEN 66.0 ELSE 0.0 END)), 0.0) END AS double)"


@query("fn_score_token", f"SELECT pos, {fill(TOKEN, 'display_name', 'wigdet')} AS s, {fill(TOKEN, 'provider', 'brand')} AS b FROM drivers", "drivers")
def _(c: Catalog):
    return c.drivers.select("pos", search.token_score("wigdet", F.col("display_name")).alias("s"), search.token_score("brand", F.col("provider")).alias("b"))


@query("fn_score_phrase", f"SELECT pos, round(CASE WHEN coalesce(display_name, '') = '' THEN 0.0 WHEN contains(lower(display_name), 'wigdet blue') THEN 100.0 WHEN contains(regexp_replace(lower(display_name), '[^a-z0-9]+', '', 'g'), 'wigdetblue') THEN 90.0 WHEN {fill(TOKEN, 'display_name', 'wigdet')} > 0 AND {fill(TOKEN, 'display_name', 'blue')} > 0 THEN ({fill(TOKEN, 'display_name', 'wigdet')} + {fill(TOKEN, 'display_name', 'blue')}) / 2 * 0.85 ELSE 0.0 END, 6) AS s FROM drivers", "drivers")
def _(c: Catalog):
    return c.drivers.select("pos", F.round(search.phrase_score("wigdet  blue", F.col("display_name")), 6).alias("s"))


@query("fn_clamp_int", "SELECT event_id, least(100, greatest(1, coalesce(try_cast(regexp_extract(props, '-?[0-9]+') AS bigint), 25))) AS n FROM events")
def _(c: Catalog):
    return c.events.select("event_id", text.clamp_int(F.regexp_extract("props", r"(-?[0-9]+)", 1), 25, 1, 100).alias("n"))


@query("fn_json_array", "SELECT pos, len(descriptions) AS n, coalesce(descriptions[1], '') AS first, 0 AS bad FROM drivers", "drivers")
def _(c: Catalog):
    a = text.json_array(F.to_json("descriptions"))
    return c.drivers.select("pos", F.size(a).cast("long").alias("n"), F.coalesce(F.get(a, F.lit(0)), F.lit("")).alias("first"), F.size(text.json_array(F.lit("{oops"))).alias("bad"))


@query("fn_sha256", "SELECT page_id, sha256(html) AS sha FROM pages")
def _(c: Catalog):
    return c.pages.select("page_id", F.sha2("html", 256).alias("sha"))


# ---- filters and projections


@query("flt_valid_driver", "SELECT pos, CASE WHEN pos % 13 = 0 THEN 'missing id' WHEN pos % 17 = 0 THEN 'hwids not a list' END AS reject_reason FROM drivers", "drivers")
def _(c: Catalog):
    p = F.col("pos")
    hw = F.when(p % 17 == 0, F.lit('"x"')).when(p % 19 == 0, F.lit("null")).otherwise(F.lit('["a"]'))
    value = F.concat(F.lit('{"id":"'), F.when(p % 13 == 0, "").otherwise(F.col("driver_id")), F.lit('","hwids":'), hw, F.lit("}"))
    return load.reject_reason(c.drivers.select("pos", value.alias("value"))).select("pos", "reject_reason")


@query("flt_valid_part", "SELECT driver_id, count(*) FILTER (filename <> '' AND url <> '') AS good, count(*) AS n FROM driver_parts GROUP BY driver_id", "driver_parts")
def _(c: Catalog):
    g = c.driver_parts.groupBy("driver_id").agg(F.collect_list(F.struct("part_num", "filename", "url")).alias("parts"))
    return g.select("driver_id", F.size(load.valid_parts(F.col("parts"))).cast("long").alias("good"), F.size("parts").cast("long").alias("n"))


@query("flt_valid_hwid_row", "SELECT hwid_string, driver_id, NOT contains(hwid_string, '&') AS is_generic FROM hwids", "hwids")
def _(c: Catalog):
    items = c.hwids.groupBy("driver_id").agg(F.collect_list("hwid_string").alias("h")).select(F.struct(F.col("driver_id").alias("id"), F.concat("h", F.array(F.lit(""), F.lit(None))).alias("hwids")).alias("d"))
    return load.hwid_rows(items)


@query("prj_display_name", "SELECT pos, coalesce(nullif(descriptions[1], ''), nullif(concat_ws(' ', nullif(provider, ''), nullif(category, ''), nullif(version, '')), ''), driver_id) AS name FROM drivers", "drivers")
def _(c: Catalog):
    return c.drivers.select("pos", ids.display_name(F.col("descriptions"), F.col("provider"), F.col("category"), F.col("version"), F.col("driver_id")).alias("name"))


@query("prj_is_generic", "SELECT hwid_string, driver_id, NOT contains(hwid_string, '&') AS g, is_generic FROM hwids", "hwids")
def _(c: Catalog):
    return c.hwids.select("hwid_string", "driver_id", hwid.is_generic(F.col("hwid_string")).alias("g"), "is_generic")


@query("prj_enabled_norm", "SELECT pos, coalesce(enabled, true) AS e, true AS f, enabled IS NULL AS was_null FROM drivers", "drivers")
def _(c: Catalog):
    return c.drivers.select("pos", load.enabled(F.col("enabled")).alias("e"), load.enabled(F.col("enabled"), force=True).alias("f"), F.col("enabled").isNull().alias("was_null"))


@query("flt_since", "SELECT pos, date_added FROM drivers WHERE date_added IS NULL OR substr(date_added, 1, 10) >= '2018-05-01'", "drivers")
def _(c: Catalog):
    return c.drivers.where(load.since(F.col("date_added"), "2018-05-01T00:00")).select("pos", "date_added")


@query("prj_driver_row", "SELECT driver_id, pack, driver_type, provider, category, version, arch, coalesce(nullif(descriptions[1], ''), nullif(concat_ws(' ', nullif(provider, ''), nullif(category, ''), nullif(version, '')), ''), driver_id) AS display_name, primary_url, zip_parts, date_added, coalesce(enabled, true) AS enabled, source_manifest FROM drivers", "drivers")
def _(c: Catalog):
    d = F.struct(F.col("driver_id").alias("id"), "pack", F.col("driver_type").alias("type"), "provider", "category", "version", "arch", "descriptions", "os_targets", F.col("primary_url").alias("zip"), "zip_parts", "date_added", "enabled", F.lit(None).cast("string").alias("supersedes"), F.lit(None).cast("string").alias("superseded_by"), F.lit("").alias("notes"))
    rows = load.driver_rows(c.drivers.select(F.col("source_manifest").alias("file"), d.alias("d")))
    return rows.drop("descriptions", "os_targets", "supersedes", "superseded_by", "notes")


@query("flt_facets", "SELECT driver_id FROM drivers WHERE enabled AND category = (SELECT min(p_type) FROM part) AND arch = 'x64'", "drivers")
def _(c: Catalog):
    low = c.part.agg(F.min("p_type")).first()[0]
    return search.facet_filter(c.drivers, category=low, arch="x64").select("driver_id")


@query("prj_result_shape", "SELECT d.driver_id, nullif(display_name, '') AS display_name, nullif(provider, '') AS provider, nullif(version, '') AS version, coalesce(n, 0) AS hwid_count FROM drivers d LEFT JOIN (SELECT driver_id, count(*) AS n FROM hwids GROUP BY driver_id) h ON d.driver_id = h.driver_id", "drivers hwids")
def _(c: Catalog):
    d = search.hwid_counts(c.drivers, c.hwids)
    return d.select("driver_id", *(F.nullif(x, F.lit("")).alias(x) for x in ("display_name", "provider", "version")), "hwid_count")


@query("flt_uploadable", "SELECT pos, NOT (pos % 5 = 0) AND (pos % 2 = 0 OR provider <> '' OR category <> '') AS ok FROM drivers", "drivers")
def _(c: Catalog):
    name = F.when(F.col("pos") % 10 == 0, "C:\\x\\USBHUB.inf").when(F.col("pos") % 5 == 0, "pci_oem.inf").otherwise("pcioem.inf")
    h = F.when(F.col("pos") % 2 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    return c.drivers.select("pos", text.is_uploadable(name, h, F.col("provider"), F.col("category")).alias("ok"))


@query("flt_valid_hwid", r"SELECT driver_id, hwid_string, regexp_matches(h, '^(PCI|USB|ACPI)\\') AND NOT contains(h, ' ') AND (NOT (starts_with(h, 'PCI\') AND contains(h, 'VEN_')) OR regexp_matches(h, '^PCI\\VEN_[0-9A-F]{4}&DEV_[0-9A-F]{4}')) AS ok FROM (SELECT driver_id, hwid_string, CASE WHEN driver_id < 'drv-4' THEN replace(hwid_string, 'PCI', 'BOGUS') WHEN driver_id < 'drv-8' THEN replace(hwid_string, '&', ' &') ELSE hwid_string END AS h FROM hwids) AS t", "hwids")
def _(c: Catalog):
    h = F.when(F.col("driver_id") < "drv-4", F.replace("hwid_string", F.lit("PCI"), F.lit("BOGUS"))).when(F.col("driver_id") < "drv-8", F.replace("hwid_string", F.lit("&"), F.lit(" &"))).otherwise(F.col("hwid_string"))
    return c.hwids.select("driver_id", "hwid_string", hwid.is_valid(h).alias("ok"))


@query("flt_enabled_ids", "SELECT count(*) FILTER (coalesce(enabled, true)) AS kept, (SELECT count(*) FROM part) * 2 - count(*) FILTER (coalesce(enabled, true)) AS skipped FROM drivers", "drivers")
def _(c: Catalog):
    asked = c.drivers.select("driver_id").union(c.drivers.select(F.concat("driver_id", F.lit("x"))))
    kept = asked.join(c.drivers.where(load.enabled(F.col("enabled"))).select("driver_id"), "driver_id", "left_semi")
    return kept.agg(F.count("*").alias("kept")).crossJoin(asked.agg(F.count("*").alias("asked"))).select("kept", (F.col("asked") - F.col("kept")).alias("skipped"))


@query("flt_install_one", "SELECT pos, CASE WHEN pos % 7 = 3 THEN 404 WHEN NOT coalesce(enabled, true) THEN 410 ELSE 200 END AS status FROM drivers", "drivers")
def _(c: Catalog):
    asked = c.drivers.select("pos", F.when(F.col("pos") % 7 == 3, "none").otherwise(F.col("driver_id")).alias("driver_id"))
    d = asked.join(c.drivers.select("driver_id", load.enabled(F.col("enabled")).alias("e"), F.lit(1).alias("hit")), "driver_id", "left")
    return d.select("pos", F.when(F.col("hit").isNull(), 404).when(~F.col("e"), 410).otherwise(200).alias("status"))


@query("prj_item_kind", "SELECT pos, CASE WHEN pos % 3 = 0 AND (provider <> '' OR pos % 2 = 0) THEN 'driver' WHEN pos % 3 = 1 THEN 'installer' ELSE 'package' END AS kind FROM drivers", "drivers")
def _(c: Catalog):
    p = F.col("pos")
    prov, hw, comp = F.when(p % 3 == 0, F.col("provider")).otherwise(""), (p % 3 == 0) & (p % 2 == 0), F.when(p % 3 == 1, "acme")
    return c.drivers.select("pos", F.when((prov != "") | hw, "driver").when(F.coalesce(comp, F.lit("")) != "", "installer").otherwise("package").alias("kind"))


@query("prj_item_label", "SELECT pos, concat(coalesce(nullif(provider, ''), 'Unknown'), ' ', coalesce(nullif(display_name, ''), driver_id), ' (', coalesce(nullif(version, ''), '?'), ')') AS label FROM drivers", "drivers")
def _(c: Catalog):
    f = lambda n, d: F.coalesce(F.nullif(n, F.lit("")), d)
    return c.drivers.select("pos", F.concat(f("provider", F.lit("Unknown")), F.lit(" "), f("display_name", F.col("driver_id")), F.lit(" ("), f("version", F.lit("?")), F.lit(")")).alias("label"))


@query("prj_parts_compat", "SELECT d.driver_id, coalesce(n, 1) AS parts, coalesce(u, primary_url) AS first_url FROM drivers d LEFT JOIN (SELECT driver_id, count(*) AS n, min(url) FILTER (part_num = 1) AS u FROM driver_parts GROUP BY driver_id) p ON d.driver_id = p.driver_id", "drivers driver_parts")
def _(c: Catalog):
    g = c.driver_parts.groupBy("driver_id").agg(F.array_sort(F.collect_list(F.struct("part_num", "url"))).alias("parts"))
    one = F.array(F.struct(F.lit(1).alias("part_num"), F.col("primary_url").alias("url")))
    d = c.drivers.join(g, "driver_id", "left").withColumn("p", F.when(F.coalesce(F.size("parts"), F.lit(0)) > 0, F.col("parts")).otherwise(one))
    return d.select("driver_id", F.size("p").cast("long").alias("parts"), F.get("p", F.lit(0))["url"].alias("first_url"))


@query("prj_safe_component", r"SELECT page_id, coalesce(nullif(trim(regexp_replace(trim(url), '[<>:\x22/\\|?*\x00-\x1f]', '_', 'g'), '. '), ''), 'unnamed') AS safe, concat(substr(coalesce(nullif(trim(regexp_replace(trim(url), '[<>:\x22/\\|?*\x00-\x1f]', '_', 'g'), '. '), ''), 'unnamed'), 1, 40), '-', substr(sha1(url), 1, 8)) AS unique_key FROM pages")
def _(c: Catalog):
    return c.pages.select("page_id", text.safe_component(F.col("url")).alias("safe"), text.unique_key(F.col("url"), F.col("url")).alias("unique_key"))


@query("prj_unique_key", "SELECT pos, concat(driver_id, '-', substr(sha1(driver_id), 1, 8)) AS k FROM drivers", "drivers")
def _(c: Catalog):
    return c.drivers.select("pos", text.unique_key(F.col("driver_id"), F.col("driver_id")).alias("k"))


@query("prj_human_size", "SELECT doc_id, n_chars, CASE WHEN n_chars < 1024 THEN concat(n_chars, ' B') WHEN n_chars < 1048576 THEN printf('%.2f KB', n_chars / 1024.0) ELSE printf('%.2f MB', n_chars / 1048576.0) END AS size FROM documents")
def _(c: Catalog):
    return c.documents.select("doc_id", "n_chars", text.human_size(F.col("n_chars")).alias("size"))


@query("prj_human_time", "SELECT doc_id, CASE WHEN n_chars < 60 THEN concat(n_chars, 's') WHEN n_chars < 3600 THEN concat(n_chars // 60, 'm ', n_chars % 60, 's') ELSE concat(n_chars // 3600, 'h ', n_chars % 3600 // 60, 'm ', n_chars % 60, 's') END AS t FROM documents")
def _(c: Catalog):
    return c.documents.select("doc_id", text.human_time(F.col("n_chars")).alias("t"))


@query("flt_safe_path", r"SELECT pos, pos % 4 NOT IN (0, 1, 2) AS ok FROM drivers", "drivers")
def _(c: Catalog):
    p = F.when(F.col("pos") % 4 == 0, "/etc/x").when(F.col("pos") % 4 == 1, "a\\..\\b").when(F.col("pos") % 4 == 2, "C:x").otherwise("a/b..c/d")
    return c.drivers.select("pos", text.is_safe_path(p).alias("ok"))


@query("flt_zip_bomb", "SELECT driver_id AS archive, cast(sum(size_bytes) AS bigint) AS total, sum(size_bytes) <= 200 * 1000 AS safe FROM driver_parts GROUP BY driver_id", "driver_parts")
def _(c: Catalog):
    return shards.zip_bomb(c.driver_parts.select(F.col("driver_id").alias("archive"), F.lit(1000).cast("long").alias("input_size"), F.col("size_bytes").alias("size")))


@query("prj_state_eligibility", "SELECT concat('drivers_', min(i)) AS name FROM (SELECT unnest(range(2, 100)) AS i) AS t WHERE i NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey >= 1)")
def _(c: Catalog):
    return shards.next_archive_repo(c.nation.where("n_nationkey >= 1").select(F.when(F.col("n_nationkey") == 1, "drivers").otherwise(F.concat(F.lit("drivers_"), F.col("n_nationkey").cast("string"))).alias("name")))


@query("fn_category_file", "SELECT DISTINCT category, concat('manifests/', regexp_replace(category, '[^A-Za-z0-9]', '', 'g'), '.manifest.json') AS file FROM drivers", "drivers")
def _(c: Catalog):
    return c.drivers.select("category").distinct().select("category", ids.category_file(F.col("category")).alias("file"))


@query("fn_is_driver_id", "SELECT driver_id, true AS a, false AS b FROM drivers", "drivers")
def _(c: Catalog):
    return c.drivers.select("driver_id", hwid.looks_like_driver_id(F.concat(F.lit(" "), F.upper("driver_id"))).alias("a"), hwid.looks_like_driver_id(F.col("pack")).alias("b"))


@query("dst_criteria", "SELECT 'amd' AS value UNION ALL SELECT 'radeon'")
def _(c: Catalog):
    found = search.parse_query("amd AMD radeon amd")
    return c.spark.createDataFrame([(x.value,) for x in found], "value string")
