"""Checks of inventory, completeness and manifest: products are event types, slots are 10-minute steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberframe.checks.common import Book, px_sql, rds, srd
from emberframe.operators import audit, inventory
from emberframe.sources import views

BOOK = Book.empty()
add = BOOK.add
PRODUCTS = ("click", "error", "purchase", "signup", "view")
SLOT = "floor(epoch(ts))::bigint // 600 * 600"


def found(spark, sf):
    slot = F.floor(F.unix_timestamp("ts") / 600) * 600
    return views.events(spark, sf).select(F.col("event_type").alias("product"), slot.cast("long").alias("slot")).distinct()


def expected(spark, sf):
    bounds = found(spark, sf).agg(F.min("slot").alias("a"), F.max("slot").alias("b"))
    slots = bounds.select(F.explode(F.sequence("a", "b", F.lit(600))).alias("slot"))
    return slots.withColumn("product", F.explode(F.array(*[F.lit(p) for p in PRODUCTS])))


_BASE = f"""with found as (select distinct event_type product, {SLOT} slot from events),
  expected as (select unnest(generate_series((select min(slot) from found), (select max(slot) from found), 600)) slot, p product
    from (select unnest([{", ".join(f"'{p}'" for p in PRODUCTS)}]) p)),
  gaps as (select * from expected anti join found using (product, slot))"""

_PATHS = """
  select event_id, concat('region/', event_type, case when event_id % 2 = 0 then concat('-', substr(stamp, 1, 6)) else '' end, '/', stamp,
    case event_id % 5 when 0 then '_planck.json' when 1 then '_kappa0.json' when 2 then '_dqf.npy' when 3 then '.txt' else '.npy' end) as path
  from (select event_id, event_type, {stamp} as stamp from {ev}) as named"""


@add("i1_parse_listing", f"""
    with p as ({_PATHS.format(stamp="strftime(ts, '%Y%m%d_%H%M')", ev='events')})
    select event_id, regexp_replace(split_part(path, '/', 2), '-[0-9]{{6}}$', '') product, regexp_extract(path, '([0-9]{{8}}_[0-9]{{4}})[_.]', 1) stamp,
      case event_id % 5 when 0 then 'planck' when 1 then 'kappa0' when 2 then 'dqf' else 'data' end kind from p where path not like '%.txt'""")
def _(spark, sf):
    paths = spark.sql(_PATHS.format(stamp="date_format(ts, 'yyyyMMdd_HHmm')", ev="{ev}"), ev=views.events(spark, sf))
    return inventory.parse_listing(paths).drop("path")


@add("s18_month_shards", """
    select event_type product, strftime(ts, '%Y%m') yyyymm, count(*) n, min(concat(event_type, '-', strftime(ts, '%Y%m'), '/', strftime(ts, '%Y%m%d_%H%M'), '.npy')) first_path
    from events group by all""")
def _(spark, sf):
    stamp = F.date_format("ts", "yyyyMMdd_HHmm")
    rows = views.events(spark, sf).select(F.col("event_type").alias("product"), stamp.alias("stamp"))
    rows = rows.withColumn("path", inventory.shard_path(F.col("product"), F.col("stamp")))
    back = inventory.parse_listing(rows.select("path")).withColumn("yyyymm", F.substring("stamp", 1, 6))
    return back.groupBy("product", "yyyymm").agg(F.count("*").alias("n"), F.min("path").alias("first_path"))


@add("i2_missing_slots", f"{_BASE} select product, slot from gaps")
def _(spark, sf):
    return inventory.missing(expected(spark, sf), found(spark, sf)).select("product", "slot")


@add("t5_missing_scenes", f"""{_BASE}, hourly as (select distinct product, slot from expected where slot % 3600 = 0) select product, count(*) n_missing from hourly anti join found using (product, slot) group by product""")
def _(spark, sf):
    hourly = expected(spark, sf).where("slot % 3600 = 0")
    return inventory.missing(hourly, found(spark, sf)).groupBy("product").agg(F.count("*").alias("n_missing"))


@add("i3_completeness", f"""{_BASE} select product, count(*) n_expected, count(f.slot) n_found, {srd('100 * count(f.slot) / count(*)')} percent
    from expected e left join found f using (product, slot) group by product""")
def _(spark, sf):
    return inventory.completeness(expected(spark, sf), found(spark, sf)).select("product", "n_expected", "n_found", *rds("percent"))


@add("i4_missing_ranges", f"""{_BASE} select product, min(slot) first_slot, max(slot) last_slot, count(*) n
    from (select *, slot - 600 * row_number() over (partition by product order by slot) g from gaps) group by product, g""")
def _(spark, sf):
    return inventory.contiguous_ranges(inventory.missing(expected(spark, sf), found(spark, sf)), 600)


@add("i5_same_missing_set", """
    with e as (select concat(event_type, '-', user_id) product, floor(epoch(ts))::bigint // 259200 slot from events),
    g as (select product, slot from (select distinct product from e), (select distinct slot from e) except select product, slot from e)
    select n_missing, string_agg(product, ',' order by product) products from (select product, count(*) n_missing, list(slot order by slot) s from g group by product) group by s, n_missing""")
def _(spark, sf):
    """Products are a user's events of one type, slots three days; a slot without such an event is missing."""
    seen = views.events(spark, sf).select(F.expr("concat(event_type, '-', user_id)").alias("product"), F.floor(F.unix_timestamp("ts") / 259200).alias("slot")).distinct()
    # every slot there is, dealt to the products by the few slots there are
    slots = seen.select("slot").distinct().agg(F.collect_list("slot").alias("slots"))
    wanted = seen.select("product").distinct().join(F.broadcast(slots)).select("product", F.explode("slots").alias("slot"))
    return inventory.same_missing_set(inventory.missing(wanted, seen))


_RESULTS = """
  select event_id, {hour} as scene, event_type as product, case event_id % 7 when 0 then 'error' when 1 then 'empty' when 2 then 'exists' else 'downloaded' end as status,
    case when event_id % 7 < 2 then null else concat(event_type, '/', event_id) end as path, case when event_id % 7 = 0 then 'timeout' end as error,
    case when event_id % 3 = 0 then concat('50x', user_id) end as shape from {ev}"""
_MANIFEST = f"""with res as ({_RESULTS.format(hour="floor(epoch(ts))::bigint // 10800 * 10800", ev="events")}),
  manifest as (select scene, product, arg_max_null(status, event_id) status, arg_max_null(path, event_id) path, arg_max_null(error, event_id) error,
    arg_max(shape, event_id) shape from res group by all)"""


def results(spark, sf):
    return spark.sql(_RESULTS.format(hour="cast(floor(unix_timestamp(ts) / 10800) * 10800 as bigint)", ev="{ev}"), ev=views.events(spark, sf))


def manifest(spark, sf):
    return inventory.upsert_manifest(results(spark, sf), "event_id")


@add("i6_manifest_upsert", f"{_MANIFEST} select * from manifest")
def _(spark, sf):
    return manifest(spark, sf)


_NEEDED = ("click", "view", "error")
_STATUS = f"""{_MANIFEST}, st as (select scene, case when count(*) filter (where product in {_NEEDED} and status in ('downloaded', 'exists')) = 3 then 'complete' else 'incomplete' end status
  from manifest group by scene)"""


@add("i7_scene_status", f"{_STATUS} select * from st")
def _(spark, sf):
    return inventory.scene_status(manifest(spark, sf), _NEEDED)


@add("i8_flat_metadata", f"""{_MANIFEST} select scene, {", ".join(f"coalesce(max(status) filter (where product = '{p}'), 'missing') {p}_status, coalesce(max(path) filter (where product = '{p}'), 'N/A') {p}_path" for p in _NEEDED)}
    from manifest group by scene""")
def _(spark, sf):
    return inventory.flat_metadata(manifest(spark, sf), _NEEDED)


@add("i9_status_report", f"{_STATUS} select count(*) n_scenes, count(*) filter (where status = 'complete') n_complete from st")
def _(spark, sf):
    return inventory.status_report(inventory.scene_status(manifest(spark, sf), _NEEDED))


_FROM = 1704067200 + 5 * 86400


@add("i10_retry_list", f"""{_MANIFEST} select s.scene, p.product, case when m.status is null then 'missing' else 'failed' end reason, s.scene >= {_FROM} in_range
    from (select distinct scene from manifest) s cross join (select unnest({list(_NEEDED)}) product) p left join manifest m on m.scene = s.scene and m.product = p.product
    where m.status is null or m.status in ('error', 'empty')""")
def _(spark, sf):
    table = manifest(spark, sf)
    return inventory.retry_list(table, _NEEDED, table, start=_FROM)


_FIRE = f"ref_code in ({views.FIRE_LIST})"


@add("i11_fire_statistics", px_sql(f"""
    , s as (select scene, count(*) filter (where {_FIRE}) n_fire, bool_and(ref_code = 0) invalid from px group by scene)
    select count(*) n_scenes, count(*) filter (where invalid) n_invalid, count(*) filter (where not invalid and n_fire > 0) with_fire,
      count(*) filter (where not invalid and n_fire = 0) without_fire, {srd('100 * count(*) filter (where not invalid and n_fire > 0) / count(*) filter (where not invalid)')} percent_fire from s"""))
def _(spark, sf):
    stats = inventory.fire_statistics(views.pixels(spark, sf), audit.is_fire(F.col("ref_code")))
    return inventory.fire_summary(stats).select("n_scenes", "n_invalid", "with_fire", "without_fire", *rds("percent_fire"))


@add("i11_top_scenes", px_sql(f"select scene, count(*) filter (where {_FIRE}) n_fire from px group by scene having n_fire > 0 order by n_fire desc, scene limit 10"))
def _(spark, sf):
    stats = inventory.fire_statistics(views.pixels(spark, sf), audit.is_fire(F.col("ref_code")))
    return stats.where("n_fire > 0").select("scene", "n_fire").orderBy(F.desc("n_fire"), "scene").limit(10)


@add("i13_result_tallies", f"{_MANIFEST} select status, count(*) n from res group by status")
def _(spark, sf):
    return results(spark, sf).groupBy("status").agg(F.count("*").alias("n"))


@add("i15_months_needed", "select distinct strftime(ts, '%Y%m') as month from events")
def _(spark, sf):
    return inventory.months_of(found(spark, sf))
