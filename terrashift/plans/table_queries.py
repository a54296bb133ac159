"""Embeddings, ledgers, joins, sets, scalars and uploads on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrashift.functions import scalars
from terrashift.operators import embedding, ingest, joins, ledger
from terrashift.plans.registry import query
from terrashift.plans.views import rounded, table
from terrashift.sources import files

# --- embeddings -----------------------------------------------------------------

_CENTROIDS = """ex AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS pos FROM embeddings),
cn AS (SELECT label, pos, avg(v) AS m FROM ex GROUP BY label, pos), ov AS (SELECT pos, avg(v) AS m FROM ex GROUP BY pos)"""


@query(
    "emb_centroid_distance",
    f"WITH {_CENTROIDS} SELECT label, round(sqrt(sum((cn.m - ov.m)*(cn.m - ov.m))), 4) AS distance FROM cn JOIN ov USING (pos) GROUP BY label",
)
def emb_centroid_distance(spark, d):
    return embedding.features(table(spark, d, "embeddings"), "label").select("label", "distance")


@query(
    "emb_dispersion",
    f"""WITH {_CENTROIDS}, ds AS (SELECT ex.label, vec_id, sqrt(sum((v - m)*(v - m))) AS dist FROM ex JOIN cn ON ex.label = cn.label AND ex.pos = cn.pos GROUP BY ex.label, vec_id)
    SELECT label, count(*) AS n, round(avg(dist), 4) AS dispersion FROM ds GROUP BY label""",
)
def emb_dispersion(spark, d):
    return embedding.features(table(spark, d, "embeddings"), "label").select("label", "n", "dispersion")


@query("emb_norm", f"WITH {_CENTROIDS} SELECT label, round(sqrt(sum(m*m)), 4) AS norm FROM cn GROUP BY label")
def emb_norm(spark, d):
    return embedding.features(table(spark, d, "embeddings"), "label").select("label", "norm")


@query(
    "emb_cosine_probe",
    """WITH ex AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS pos FROM embeddings),
    m AS (SELECT label, pos, avg(v) FILTER (vec_id % 2 = 0) AS a, avg(v) FILTER (vec_id % 2 = 1) AS b FROM ex GROUP BY label, pos)
    SELECT label, round(1.0E0 - sum(a*b)/(sqrt(sum(a*a))*sqrt(sum(b*b))), 4) AS probe FROM m GROUP BY label""",
)
def emb_cosine_probe(spark, d):
    rows = table(spark, d, "embeddings")
    return embedding.change_probe(rows.where("vec_id % 2 = 0"), rows.where("vec_id % 2 = 1"), "label")


_YEARS = "SELECT o_orderkey, year(o_orderdate) + 20 AS y1, year(o_orderdate) + 20 + o_orderkey % 3 AS y2 FROM orders"


def _years(spark, d):
    year = F.year("o_orderdate") + 20
    return table(spark, d, "orders").select("o_orderkey", year.alias("year1"), (year + F.col("o_orderkey") % 3).alias("year2"))


@query(
    "emb_coverage",
    f"""SELECT count(*) AS pairs, count(*) FILTER (y1 >= 2017) AS before_covered, count(*) FILTER (y2 >= 2017) AS after_covered,
    count(*) FILTER (y1 >= 2017 AND y2 >= 2017) AS both_covered, round(100.0E0*count(*) FILTER (y1 >= 2017 AND y2 >= 2017)/count(*), 1) AS both_percent FROM ({_YEARS})""",
)
def emb_coverage(spark, d):
    return embedding.coverage(_years(spark, d))


@query("emb_clamp_year", f"SELECT o_orderkey, CAST(greatest(y1, 2017) AS INT) AS used_year, y1 < 2017 AS was_clamped FROM ({_YEARS})")
def emb_clamp_year(spark, d):
    return embedding.clamped(_years(spark, d), "year1").select("o_orderkey", F.col("used_year").cast("int").alias("used_year"), "was_clamped")


# --- ledgers and events ----------------------------------------------------------


@query("ledger_dedupe_last", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def ledger_dedupe_last(spark, d):
    rows = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    return ledger.last_wins(rows, "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("ledger_resume_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def ledger_resume_anti(spark, d):
    done = table(spark, d, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("c_custkey"))
    return ledger.remaining(table(spark, d, "customer").select("c_custkey"), done, "c_custkey")


@query("ledger_resume_state", """SELECT count(*) AS "rows", count(*) FILTER (event_type = 'purchase') AS calls, round(sum(CAST(round(value * 100) AS BIGINT))/100.0E0, 2) AS spent_usd FROM events""")
def ledger_resume_state(spark, d):
    cents = (F.round(F.col("value") * 100).cast("bigint")).alias("cost_usd")
    rows = table(spark, d, "events").select((F.col("event_type") == "purchase").alias("vlm_called"), cents)
    return ledger.resume_state(rows).withColumn("spent_usd", F.round(F.col("spent_usd") / 100.0, 2))


@query("ledger_paid_guard", "SELECT count(*) FILTER (event_type = 'purchase') AS paid, count(*) FILTER (event_type = 'purchase') > 0 AS refused FROM events")
def ledger_paid_guard(spark, d):
    rows = table(spark, d, "events").select((F.col("event_type") == "purchase").alias("vlm_called"))
    return rows.agg(F.count_if("vlm_called").alias("paid")).withColumn("refused", F.col("paid") > 0)


_STATES = "CASE event_id % 4 WHEN 0 THEN 'reserved' WHEN 1 THEN 'settled' WHEN 2 THEN 'uncertain' ELSE 'released' END"
_MICRO = "CAST(round(value * 1000) AS BIGINT)"


def _reservations(spark, d):
    state = F.when(F.col("event_id") % 4 == 0, "reserved").when(F.col("event_id") % 4 == 1, "settled").when(F.col("event_id") % 4 == 2, "uncertain")
    micro = F.round(F.col("value") * 1000).cast("bigint")
    rows = table(spark, d, "events").select("event_id", "user_id", "ts", state.otherwise("released").alias("state"), micro.alias("reserved_micro"))
    return rows.withColumn("settled_micro", F.when(F.col("state") == "settled", F.col("reserved_micro")).otherwise(0))


@query(
    "spend_state_totals",
    f"""SELECT settled_micro, outstanding_micro, n_reserved, n_settled, n_uncertain, n_released, greatest(0, 1000000000 - settled_micro - outstanding_micro) AS available_micro FROM (
    SELECT CAST(sum({_MICRO}) FILTER (s = 'settled') AS BIGINT) AS settled_micro, CAST(sum({_MICRO}) FILTER (s IN ('reserved', 'uncertain')) AS BIGINT) AS outstanding_micro,
    count(*) FILTER (s = 'reserved') AS n_reserved, count(*) FILTER (s = 'settled') AS n_settled, count(*) FILTER (s = 'uncertain') AS n_uncertain,
    count(*) FILTER (s = 'released') AS n_released FROM (SELECT *, {_STATES} AS s FROM events))""",
)
def spend_state_totals(spark, d):
    return ledger.state_totals(_reservations(spark, d), 1_000_000_000)


@query(
    "spend_running_cap",
    f"""SELECT event_id, user_id, running, running <= 300000 AS within_cap FROM (
    SELECT event_id, user_id, CAST(sum({_MICRO}) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS running FROM events)""",
)
def spend_running_cap(spark, d):
    got = ledger.running_cap(_reservations(spark, d), "user_id", ["ts", "event_id"], "reserved_micro", 300_000)
    return got.select("event_id", "user_id", "running", "within_cap")


def _events(spark, d):
    return ledger.numbered(table(spark, d, "events").select("event_id", "user_id", "ts"), "user_id", ["ts", "event_id"])


@query("event_seq_cursor", "SELECT event_id, CAST(seq AS INT) AS seq FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events) WHERE user_id = 7 AND seq > 2")
def event_seq_cursor(spark, d):
    return ledger.after_cursor(_events(spark, d), "user_id", 7, 2).select("event_id", "seq")


@query("event_next_seq", "SELECT user_id, CAST(count(*) + 1 AS INT) AS next_seq FROM events GROUP BY user_id")
def event_next_seq(spark, d):
    return ledger.next_seq(_events(spark, d), "user_id")


@query("event_recent_runs", "SELECT event_id AS run_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def event_recent_runs(spark, d):
    runs = table(spark, d, "events").select(F.col("event_id").alias("run_id"), "user_id", F.col("ts").alias("created_at"))
    return ledger.recent(runs, 20).select("run_id", "user_id")


@query("event_recover_interrupted", f"SELECT event_id, CASE WHEN {_STATES} = 'reserved' THEN 'failed' ELSE {_STATES} END AS status FROM events")
def event_recover_interrupted(spark, d):
    status = F.when(F.col("state") == "reserved", "running").otherwise(F.col("state")).alias("status")
    return ledger.recovered(_reservations(spark, d).select("event_id", status))


# --- joins and sets ----------------------------------------------------------------

_BOXES = """bx AS (SELECT n_nationkey AS scene, CAST(n_nationkey % 5 * 2 AS DOUBLE) AS west, CAST(n_nationkey // 5 * 2 AS DOUBLE) AS south,
  CAST(n_nationkey % 5 * 2 + 2 + n_nationkey % 2 AS DOUBLE) AS east, CAST(n_nationkey // 5 * 2 + 2 AS DOUBLE) AS north FROM nation)"""
_MEET = "FROM bx a JOIN bx b ON a.scene < b.scene AND"


def _boxes(spark, d):
    k = F.col("n_nationkey")
    west, south = (k % 5 * 2).cast("double"), (F.floor(k / 5) * 2).cast("double")
    return table(spark, d, "nation").select(k.alias("scene"), west.alias("west"), south.alias("south"), (west + 2 + k % 2).alias("east"), (south + 2).alias("north"))


@query(
    "join_edge_adjacency",
    f"""WITH {_BOXES} SELECT a.scene, b.scene AS other_scene {_MEET}
    (((a.east = b.west OR b.east = a.west) AND least(a.north, b.north) > greatest(a.south, b.south))
      OR ((a.north = b.south OR b.north = a.south) AND least(a.east, b.east) > greatest(a.west, b.west)))""",
)
def join_edge_adjacency(spark, d):
    return joins.edge_adjacent(_boxes(spark, d), cell=2.0)


@query(
    "join_footprint_intersection",
    f"""WITH {_BOXES} SELECT a.scene, b.scene AS other_scene, greatest(a.west, b.west) AS west, greatest(a.south, b.south) AS south,
    least(a.east, b.east) AS east, least(a.north, b.north) AS north {_MEET} least(a.east, b.east) > greatest(a.west, b.west) AND least(a.north, b.north) > greatest(a.south, b.south)""",
)
def join_footprint_intersection(spark, d):
    return joins.intersections(_boxes(spark, d), cell=2.0)


@query(
    "join_nearest_time",
    """WITH s AS (SELECT user_id AS site, ts AS taken, value AS brightness, event_id FROM events WHERE event_type <> 'purchase'),
    w AS (SELECT event_id AS id, user_id AS site, ts AS seen FROM events WHERE event_type = 'purchase')
    SELECT id, epoch_us(arg_min(taken, (abs(epoch_us(seen) - epoch_us(taken)), taken)))::BIGINT AS taken_us FROM w JOIN s USING (site) GROUP BY id""",
)
def join_nearest_time(spark, d):
    rows = table(spark, d, "events")
    wanted = rows.where("event_type = 'purchase'").select(F.col("user_id").alias("site"), F.col("ts").alias("at"), F.col("event_id").alias("id"))
    shots = rows.where("event_type <> 'purchase'").select(F.col("user_id").alias("site"), F.col("ts").alias("taken"), F.col("value").alias("brightness"))
    got = files.nearest_snapshot(wanted, shots).where("taken is not null")
    return got.select("id", F.unix_micros(F.col("taken").cast("timestamp")).alias("taken_us"))


@query(
    "setops_band_mismatch",
    """(SELECT p_brand, p_type, 'left' AS side FROM part WHERE p_size <= 25 EXCEPT SELECT p_brand, p_type, 'left' FROM part WHERE p_size > 25)
    UNION ALL (SELECT p_brand, p_type, 'right' AS side FROM part WHERE p_size > 25 EXCEPT SELECT p_brand, p_type, 'right' FROM part WHERE p_size <= 25)""",
)
def setops_band_mismatch(spark, d):
    rows = table(spark, d, "part")
    return joins.set_difference(rows.where("p_size <= 25"), rows.where("p_size > 25"), ["p_brand", "p_type"])


@query(
    "setops_selection_equal",
    """SELECT (SELECT count(*) FROM (SELECT p_type FROM part WHERE p_size % 2 = 0 EXCEPT SELECT p_type FROM part WHERE p_size % 3 = 0)) AS only_a,
    (SELECT count(*) FROM (SELECT p_type FROM part WHERE p_size % 3 = 0 EXCEPT SELECT p_type FROM part WHERE p_size % 2 = 0)) AS only_b,
    NOT EXISTS (SELECT p_type FROM part WHERE p_size % 2 = 0 EXCEPT SELECT p_type FROM part WHERE p_size % 3 = 0)
    AND NOT EXISTS (SELECT p_type FROM part WHERE p_size % 3 = 0 EXCEPT SELECT p_type FROM part WHERE p_size % 2 = 0) AS same""",
)
def setops_selection_equal(spark, d):
    rows = table(spark, d, "part")
    return ledger.same_selection(rows.where("p_size % 2 = 0"), rows.where("p_size % 3 = 0"), "p_type")


# --- scalars ------------------------------------------------------------------------


@query(
    "quality_season_delta",
    """SELECT o_orderkey, CAST(least(g, 365 - g) AS INT) AS season_delta FROM (SELECT o_orderkey, abs(dayofyear(o_orderdate) - dayofyear(min(l_shipdate))) AS g
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderdate)""",
)
def quality_season_delta(spark, d):
    first = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("shipped"))
    both = table(spark, d, "orders").join(first, "o_orderkey")
    return both.select("o_orderkey", scalars.season_delta(F.col("o_orderdate"), F.col("shipped")).alias("season_delta"))


@query("scalar_hash_fingerprint", "SELECT item_id, substr(sha256(text), 1, 32) AS fingerprint FROM benchmark")
def scalar_hash_fingerprint(spark, d):
    return table(spark, d, "benchmark").select("item_id", scalars.fingerprint(F.col("text")).alias("fingerprint"))


@query(
    "scalar_band_map",
    """SELECT p_partkey, CAST(p_size % 7 AS INT) AS b04, CAST(p_size % 5 AS INT) AS b03, 2 AS n FROM part""",
)
def scalar_band_map(spark, d):
    text = F.concat(F.lit("B04="), (F.col("p_size") % 7).cast("string"), F.lit(",B03="), (F.col("p_size") % 5).cast("string"))
    rows = table(spark, d, "part").select("p_partkey", scalars.band_map(text).alias("m"))
    return rows.select("p_partkey", F.col("m")["B04"].alias("b04"), F.col("m")["B03"].alias("b03"), F.size("m").alias("n"))


@query(
    "scalar_date_parse",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS parsed, CAST(year(o_orderdate) AS INT) AS year FROM orders""",
)
def scalar_date_parse(spark, d):
    digits = F.date_format("o_orderdate", "yyyyMMdd")
    broken = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("x"), digits)).otherwise(digits)
    return table(spark, d, "orders").select("o_orderkey", scalars.compact_date(broken).alias("parsed"), scalars.leading_year(digits).alias("year"))


@query("scalar_json_payload", "SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY event_type")
def scalar_json_payload(spark, d):
    payload = F.from_json("props", "k bigint")["k"]
    return table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(payload).alias("total"))


@query("scalar_regex_id", r"SELECT page_id, regexp_matches(url, '^https://[a-z0-9.\-]+/[a-z]{2}/[0-9]+$') AS valid FROM pages")
def scalar_regex_id(spark, d):
    return table(spark, d, "pages").select("page_id", scalars.valid_identifier(F.col("url"), r"^https://[a-z0-9.\-]+/[a-z]{2}/[0-9]+$").alias("valid"))


@query("scalar_not_assessed", "SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_custkey AS VARCHAR) END, 'not assessed') AS shown FROM orders")
def scalar_not_assessed(spark, d):
    value = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey"))
    return table(spark, d, "orders").select("o_orderkey", scalars.or_not_assessed(value).alias("shown"))


@query(
    "geo_pixel_lonlat_mercator",
    """SELECT n_nationkey AS scene, round(west + (10 + 0.5E0)/32.0E0*(east - west), 6) AS lon, round(north - (20 + 0.5E0)/32.0E0*(north - south), 6) AS lat,
    round(6378137.0E0*ln(tan(pi()/4 + radians(north)/2.0E0)), 3) AS y FROM (SELECT n_nationkey, CAST(n_nationkey AS DOUBLE) AS west, CAST(n_nationkey + 1 AS DOUBLE) AS east,
    CAST(n_nationkey - 10 AS DOUBLE) AS south, CAST(n_nationkey - 9 AS DOUBLE) AS north FROM nation)""",
)
def geo_pixel_lonlat_mercator(spark, d):
    k = F.col("n_nationkey").cast("double")
    lon, lat = scalars.pixel_lonlat(F.lit(10), F.lit(20), F.lit(32), F.lit(32), k, k - 10, k + 1, k - 9)
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("scene"), lon.alias("lon"), lat.alias("lat"), F.round(scalars.mercator_y(k - 9), 3).alias("y"))
    return rows.select("scene", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), "y")


# --- uploads and artifacts ---------------------------------------------------------


def _uploads(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select(
        k.alias("id"),
        F.when(k % 11 == 0, "HDF4").otherwise("GTiff").alias("driver"),
        F.when(k % 13 == 0, 10000).otherwise(1000).alias("width"),
        F.lit(9000).alias("height"),
        F.col("p_size").alias("n_bands"),
        (k * 1000).alias("bytes"),
        F.lit("EPSG:32636").alias("crs1"),
        F.when(k % 7 == 0, "EPSG:4326").otherwise("EPSG:32636").alias("crs2"),
        (k % 17 == 0).alias("rotated"),
        *(F.lit(v).alias(c) for c, v in (("west1", 0.0), ("south1", 0.0), ("east1", 10.0), ("north1", 10.0), ("south2", 0.0), ("north2", 10.0))),
        (k % 12).cast("double").alias("west2"),
        (k % 12 + 5).cast("double").alias("east2"),
    )


@query(
    "ingest_problems",
    """SELECT p_partkey AS id, CAST((p_partkey % 11 = 0)::INT + (p_partkey % 13 = 0)::INT + (p_size > 32)::INT + (p_partkey % 7 = 0)::INT + (p_partkey % 17 = 0)::INT
    + (p_partkey % 12 >= 10)::INT AS INT) AS n, p_partkey % 12 >= 10 AS apart FROM part""",
)
def ingest_problems(spark, d):
    got = ingest.problems(_uploads(spark, d))
    return got.select("id", F.size("problems").alias("n"), F.array_contains("problems", "the footprints don't overlap").alias("apart"))


@query(
    "ingest_capability",
    """SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'full' WHEN 1 THEN 'index' WHEN 2 THEN 'rgb' ELSE 'none' END AS lane FROM part""",
)
def ingest_capability(spark, d):
    k = F.col("p_partkey")
    text = F.when(k % 4 == 0, "B02=1,B03=2,B04=3,B08=4,B11=5,B12=6").when(k % 4 == 1, "B03=1,B04=2,B08=3,B11=4").when(k % 4 == 2, "B02=1,B03=2,B04=3").otherwise("B04=1")
    rows = table(spark, d, "part").select(k.alias("id"), scalars.band_map(text).alias("band_map"))
    return ingest.capability(rows).select("id", "lane")


@query(
    "ingest_manifest_problems",
    """WITH m AS (SELECT p_brand || ' ' || p_type AS name, p_size FROM part)
    SELECT name, 'missing' AS problem FROM (SELECT DISTINCT name FROM m) WHERE name NOT IN (SELECT name FROM m WHERE p_size <= 25)
    UNION ALL SELECT name, 'duplicate' AS problem FROM m GROUP BY name HAVING count(*) > 1""",
)
def ingest_manifest_problems(spark, d):
    rows = table(spark, d, "part").select(F.concat_ws(" ", "p_brand", "p_type").alias("name"), "p_size")
    return ingest.manifest_problems(rows.select("name"), rows.where("p_size <= 25"))


@query(
    "artifact_resolve",
    """SELECT n_name AS key, CASE WHEN n_nationkey % 3 = 0 THEN 'local/' || n_name WHEN n_nationkey % 3 = 1 THEN 'sample/' || n_name END AS path,
    CASE n_nationkey % 3 WHEN 0 THEN 'local' WHEN 1 THEN 'sample' ELSE 'missing' END AS origin, CASE WHEN n_nationkey % 3 = 2 THEN 'make ' || n_name END AS command FROM nation""",
)
def artifact_resolve(spark, d):
    rows = table(spark, d, "nation").select(F.col("n_name").alias("key"), F.col("n_nationkey").alias("k"))
    registry = rows.select("key", F.concat(F.lit("make "), "key").alias("command"))
    local = rows.where("k % 3 = 0").select("key", F.concat(F.lit("local/"), "key").alias("path"))
    sample = rows.where("k % 3 <= 1").select("key", F.concat(F.lit("sample/"), "key").alias("path"))
    return ingest.resolve_artifacts(registry, local, sample)


@query("ingest_rescale", "SELECT l_orderkey, l_linenumber, round(CASE WHEN l_quantity <> 13 THEN (l_quantity - 5.0E0)/50.0E0 END, 6) AS l_quantity FROM lineitem")
def ingest_rescale(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return rounded(ingest.rescaled(rows, ["l_quantity"], scale=50.0, offset=5.0, nodata=13.0))


@query(
    "scalar_zulu_times",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 5 THEN NULL ELSE s - CASE o_orderkey % 7 WHEN 1 THEN 7200 WHEN 2 THEN -19800 ELSE 0 END END AS at
    FROM (SELECT o_orderkey, CAST(epoch(CAST(o_orderdate AS DATE)) AS BIGINT) + CASE WHEN o_orderkey % 7 = 4 THEN 0 ELSE o_orderkey % 86400 END AS s FROM orders)""",
)
def scalar_zulu_times(spark, d):
    """Zulu, offsets, no zone, a date and a broken text."""
    k = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    clock = F.format_string("%02d:%02d:%02d", F.floor(k % 86400 / 3600), F.floor(k % 3600 / 60), k % 60)
    kind = k % 7
    text = F.when(kind == 0, F.concat(day, F.lit("T"), clock, F.lit("Z"))).when(kind == 1, F.concat(day, F.lit("T"), clock, F.lit("+02:00")))
    text = text.when(kind == 2, F.concat(day, F.lit("T"), clock, F.lit("-0530"))).when(kind == 4, day).when(kind == 5, F.concat(day, F.lit("T25:61")))
    text = text.otherwise(F.concat(day, F.lit(" "), clock, F.lit(".5")))
    return table(spark, d, "orders").select("o_orderkey", F.unix_seconds(scalars.instant(text)).alias("at"))
