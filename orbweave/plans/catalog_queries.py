"""Queries over catalogs: sources, derived columns, filters, classes, trajectories, climate."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import catalog as C
from ..operators import climate, geometry, hexgrid
from ..schema import locator
from ..sources import tables
from ..sources.scratch import new_path
from . import oracles, pipelines
from .registry import register


def _located(fx):
    """The catalog with continent and feature columns, as the fixtures' README describes them."""
    return fx.catalog_a.join(F.broadcast(fx.cells.select("cell", "continent")), "cell")


def _csv(fx):
    path = new_path(fx.spark, "csv")
    rows = fx.catalog_a.select("trackid", "seq", "time", "mean_ivt")
    rows.write.option("header", True).csv(path)
    return tables.read_catalog_csv(fx.spark, path, rows.schema)


register("S1_csv_scan", lambda fx: _csv(fx).groupBy("trackid").agg(F.count(F.lit(1)).alias("n"), F.avg("mean_ivt").alias("ivt"), F.max("time").cast("string").substr(1, 19).alias("last")),
         "SELECT trackid, count(*) AS n, round(avg(mean_ivt), 6) AS ivt, strftime(max(time), '%Y-%m-%d %H:%M:%S') AS last FROM fx_catalog_a GROUP BY 1")
register("S2_parquet_scan", lambda fx: tables.read_catalog(fx.spark, f"{fx.sf_dir}/events.parquet").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first")),
         "SELECT event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1")
register("S3_graft_column", lambda fx: C.graft(fx.catalog_a.select("trackid", "seq", "mean_ivt"), fx.catalog_a.where("k % 7 = 0").select("trackid", "seq", "lf_lon"), "lf_lon"),
         "SELECT trackid, seq, round(mean_ivt, 6) AS mean_ivt, round(lf_lon, 6) AS lf_lon FROM fx_catalog_a")


def _index_text(fx):
    wide = fx.index.groupBy("year").pivot("month", list(range(1, 13))).agg(F.first("idx"))
    path = new_path(fx.spark, "index")
    lines = wide.select(F.concat_ws("  ", F.col("year").cast("string"), *[F.when(F.col(str(i)).isNull(), F.lit("-99.90")).otherwise(F.format_string("%.2f", F.col(str(i)))) for i in range(1, 13)]).alias("value"))
    header = fx.spark.createDataFrame([(0, "  year month values")], "o long, value string")
    lines = lines.withColumn("o", F.lit(1).cast("long"))
    header.unionByName(lines.select("o", "value")).repartition(1).sortWithinPartitions("o", "value").select("value").write.text(path)
    return tables.read_index_text(fx.spark, path)


register("S4_index_text", lambda fx: climate.melt_months(_index_text(fx)).select("year", "month", F.round("idx", 1).alias("idx")),
         """WITH full_years AS (SELECT year FROM fx_index GROUP BY 1 HAVING count(*) = 12)
            SELECT CAST(year AS BIGINT) AS year, CAST(month AS BIGINT) AS month, round(round(idx, 2), 1) AS idx FROM fx_index WHERE year IN (SELECT year FROM full_years)""")  # fmt: skip
register("S13_copy", lambda fx: fx.nation.select("n_nationkey", "n_name"), "SELECT n_nationkey, n_name FROM nation")

register("P1_locator", lambda fx: fx.catalog_a.select("trackid", "seq", locator("centroid")[0].alias("x"), locator("centroid")[1].alias("y")),
         "SELECT trackid, seq, round(centroid_lon, 6) AS x, round(centroid_lat, 6) AS y FROM fx_catalog_a")
register("P2_regrid", lambda fx: fx.catalog_a.select("trackid", "seq", S.cell_lon(F.col("centroid_lon"), 7).alias("lon7"), S.cell_lat(F.col("centroid_lat"), 7).alias("lat7"), S.cell_lon(F.col("lf_lon"), 7, True).alias("first7")),
         """SELECT trackid, seq, -180 + 7 * least(52, greatest(0, ceil((centroid_lon + 180) / 7 - 0.5))) AS lon7,
                   -90 + 7 * least(26, greatest(0, ceil((centroid_lat + 90) / 7 - 0.5))) AS lat7,
                   coalesce(-180 + 7 * least(52, greatest(0, ceil((lf_lon + 180) / 7 - 0.5))), -180) AS first7 FROM fx_catalog_a""")  # fmt: skip
_HASH = "CAST(CAST(concat('0x', substr(sha256(printf('%.6f_%.6f', lat, lon)), 1, 16)) AS UBIGINT) AS VARCHAR)"
register("P3_cell_hash", lambda fx: fx.cells.select("cell", S.cell_id(F.col("lat"), F.col("lon")).alias("id")), f"SELECT cell, {_HASH} AS id FROM fx_cells")
register("P4_invert_hash", lambda fx: fx.cells.select(S.cell_id(F.col("lat"), F.col("lon")).alias("id")).unionByName(fx.spark.createDataFrame([("7",)], "id string")).join(fx.cells.select(S.cell_id(F.col("lat"), F.col("lon")).alias("id"), "lat", "lon"), "id", "left"),
         f"SELECT {_HASH} AS id, lat, lon FROM fx_cells UNION ALL SELECT '7', NULL, NULL")
register("P5_prune_columns", lambda fx: C.prune(fx.catalog_a, ["k", "regime", "event_id", "time", "mean_ivt", "coord_idx", "cell"], ["centroid_"]), "SELECT trackid, seq, round(lf_lon, 6) AS lf_lon FROM fx_catalog_a")
register("P6_hex_encode", lambda fx: fx.catalog_a.select(*[hexgrid.AxialHexGrid().encode(F.col("centroid_lat"), F.col("centroid_lon"), r).alias(f"res{r}") for r in range(3)]).groupBy("res0", "res1", "res2").count(), oracles.HEX_ENCODE)
register("P6_wrap", lambda fx: fx.cells.select("cell", S.wrap(F.col("lon") + 200).alias("lon")), "SELECT cell, (lon + 380) - 360 * floor((lon + 380) / 360) - 180 AS lon FROM fx_cells")
register("P7_season", lambda fx: fx.catalog_b.groupBy(S.season(F.col("time")).alias("season")).agg(F.count(F.lit(1)).alias("n")),
         "SELECT CASE WHEN month(time) IN (12,1,2) THEN 'DJF' WHEN month(time) < 6 THEN 'MAM' WHEN month(time) < 9 THEN 'JJA' ELSE 'SON' END AS season, count(*) AS n FROM fx_catalog_b GROUP BY 1")
register("P8_local_time", lambda fx: fx.catalog_a.select("trackid", "seq", S.local_time(F.col("time"), S.utc_zone(F.col("centroid_lon"))).cast("string").substr(1, 19).alias("local")),
         "SELECT trackid, seq, strftime(time + to_hours(CAST(round_even(centroid_lon / 15, 0) AS INT)), '%Y-%m-%d %H:%M:%S') AS local FROM fx_catalog_a")
register("P9_feature_quantiles", lambda fx: C.feature_classes(fx.catalog_a, "mean_ivt", True, 4)[0].groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.min("trackid").alias("first")),
         """WITH m AS (SELECT trackid, avg(mean_ivt) OVER (PARTITION BY trackid) AS v FROM fx_catalog_a),
            q AS (SELECT quantile_cont(v, 0.25) AS a, quantile_cont(v, 0.5) AS b, quantile_cont(v, 0.75) AS c FROM m)
            SELECT CAST(1 + (v > a)::INT + (v > b)::INT + (v > c)::INT AS BIGINT) AS class, count(*) AS n, min(trackid) AS first FROM m, q GROUP BY 1""")  # fmt: skip
register("P9_feature_cut", lambda fx: C.feature_classes(fx.catalog_a, "mean_ivt", False, [0, 20, 50, 100])[0].groupBy("class").agg(F.count(F.lit(1)).alias("n")),
         "SELECT CAST(1 + (mean_ivt > 20)::INT + (mean_ivt > 50)::INT AS BIGINT) AS class, count(*) AS n FROM fx_catalog_a WHERE mean_ivt > 0 AND mean_ivt <= 100 GROUP BY 1")
register("P10_daytime", lambda fx: fx.catalog_a.groupBy(S.day_night(F.col("time")).alias("part")).agg(F.count(F.lit(1)).alias("n")), "SELECT CASE WHEN hour(time) BETWEEN 6 AND 17 THEN 'day' ELSE 'night' END AS part, count(*) AS n FROM fx_catalog_a GROUP BY 1")
register("P11_floor_day", lambda fx: fx.catalog_a.groupBy(S.floor_day(F.col("time")).cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n")), "SELECT strftime(date_trunc('day', time), '%Y-%m-%d %H:%M:%S') AS day, count(*) AS n FROM fx_catalog_a GROUP BY 1")
register("P12_zero_to_null", lambda fx: fx.catalog_a.select("trackid", "seq", S.zero_to_null(F.col("centroid_lon")).alias("x")), "SELECT trackid, seq, round(nullif(centroid_lon, 0), 6) AS x FROM fx_catalog_a")
register("P21_unwrap", lambda fx: geometry.unwrap(fx.catalog_a.select("trackid", "seq", "centroid_lon"), "centroid_lon"),
         """WITH d AS (SELECT trackid, seq, centroid_lon, centroid_lon - lag(centroid_lon) OVER (PARTITION BY trackid ORDER BY seq) AS d FROM fx_catalog_a)
            SELECT trackid, seq, round(centroid_lon + 360 * sum(CASE WHEN d > 180 THEN -1 WHEN d < -180 THEN 1 ELSE 0 END) OVER (PARTITION BY trackid ORDER BY seq), 6) AS centroid_lon FROM d""")  # fmt: skip
register("P23_days", lambda fx: C.track_means(fx.catalog_a, "mean_ivt").select("trackid", "days"), "SELECT trackid, count(*) / 4 AS days FROM fx_catalog_a GROUP BY 1")
register("P24_month_start", lambda fx: climate.monthly_series(fx.index).select(F.col("month_start").cast("string").alias("day"), "idx"), "SELECT strftime(make_date(year, month, 1), '%Y-%m-%d') AS day, round(idx, 6) AS idx FROM fx_index")
register("P25_round2", lambda fx: fx.cells.select("cell", S.round2(F.col("lat") / 8 + 0.005).alias("lat")), "SELECT cell, round_even(lat / 8 + 0.005, 2) AS lat FROM fx_cells")
_AVG = "SELECT coord_idx AS coord_id, avg(mean_ivt) AS v FROM {} WHERE coord_idx IS NOT NULL GROUP BY 1"
_avg = lambda df: df.where("coord_idx IS NOT NULL").groupBy(F.col("coord_idx").alias("coord_id")).agg(F.avg("mean_ivt").alias("v"))
register("P26_change", lambda fx: geometry.change_table(_avg(fx.catalog_a), _avg(fx.catalog_b), "v"), f"WITH a AS ({_AVG.format('fx_catalog_a')}), b AS ({_AVG.format('fx_catalog_b')}) SELECT coord_id, round(b.v - a.v, 6) AS change FROM a JOIN b USING (coord_id)")
register("P27_sentinel_difference", lambda fx: geometry.sentinel_difference(_avg(fx.catalog_a).where("coord_id > 3"), _avg(fx.catalog_b).where("coord_id < 20"), "v"),
         f"""WITH a AS (SELECT * FROM ({_AVG.format('fx_catalog_a')}) WHERE coord_id > 3), b AS (SELECT * FROM ({_AVG.format('fx_catalog_b')}) WHERE coord_id < 20)
             SELECT coord_id, CASE WHEN a.v IS NULL THEN -9999 WHEN b.v IS NULL THEN 9999 ELSE round(b.v - a.v, 6) END AS diff FROM a FULL JOIN b USING (coord_id)""")  # fmt: skip

_ids = lambda df: df.groupBy("trackid").agg(F.count(F.lit(1)).alias("n"))
register("F1_time_window", lambda fx: _ids(C.time_window(fx.catalog_b, (1996, 1998))), "SELECT trackid, count(*) AS n FROM fx_catalog_b WHERE time > '1996-01-01' AND time < '1998-12-31' GROUP BY 1")
register("F2_drop_end_tracks", lambda fx: _ids(C.drop_end_tracks(fx.catalog_b)), "SELECT trackid, count(*) AS n FROM fx_catalog_b WHERE trackid > (SELECT min(trackid) FROM fx_catalog_b) AND trackid < (SELECT max(trackid) FROM fx_catalog_b) GROUP BY 1")
_LOC = "loc AS (SELECT b.*, lat, lon, continent FROM fx_catalog_b b JOIN fx_cells USING (cell))"
_placed = lambda fx: fx.catalog_b.join(fx.cells, "cell")
register("F3_continent_contained", lambda fx: _ids(C.in_continent(_placed(fx), "ASIA")), f"WITH {_LOC} SELECT trackid, count(*) AS n FROM loc GROUP BY 1 HAVING bool_and(continent IN ('ASIA', 'Sea')) AND bool_or(continent = 'ASIA')")
register("F4_continent_touched", lambda fx: _ids(C.in_continent(_placed(fx), "EUROPE", False)), f"WITH {_LOC} SELECT trackid, count(*) AS n FROM loc GROUP BY 1 HAVING bool_or(continent = 'EUROPE')")
register("F5_bounding_box", lambda fx: _ids(C.in_box(_placed(fx), [-70, 70, -150, 80], F.col("lon"), F.col("lat"))), f"WITH {_LOC} SELECT trackid, count(*) AS n FROM loc GROUP BY 1 HAVING bool_and(lat > -70 AND lat < 70 AND lon > -150 AND lon < 80)")
register("F6_constrain", lambda fx: _ids(C.constrain(fx.catalog_b.withColumn("continent", F.when(F.col("cell") < 5, "Sea").otherwise("ASIA")), (1995, 1999), "ASIA")),
         """WITH t AS (SELECT *, CASE WHEN cell < 5 THEN 'Sea' ELSE 'ASIA' END AS continent FROM fx_catalog_b WHERE time > '1995-01-01' AND time < '1999-12-31'),
            u AS (SELECT * FROM t WHERE trackid > (SELECT min(trackid) FROM t) AND trackid < (SELECT max(trackid) FROM t))
            SELECT trackid, count(*) AS n FROM u GROUP BY 1 HAVING bool_or(continent = 'ASIA')""")  # fmt: skip
register("F7_null_cells", lambda fx: _ids(fx.catalog_a.where("coord_idx IS NOT NULL")), "SELECT trackid, count(coord_idx) AS n FROM fx_catalog_a GROUP BY 1 HAVING count(coord_idx) > 0")
register("F8_long_tracks", lambda fx: _ids(C.long_tracks(fx.catalog_a, 60)), "SELECT trackid, count(*) AS n FROM fx_catalog_a GROUP BY 1 HAVING count(*) >= 60")
_DN = """d AS (SELECT *, CASE WHEN hour(time) BETWEEN 6 AND 17 THEN 'day' ELSE 'night' END AS part FROM fx_catalog_a),
         e AS (SELECT *, CASE WHEN part = lag(part) OVER (PARTITION BY trackid ORDER BY seq) THEN 0 ELSE 1 END AS chg FROM d),
         g AS (SELECT *, sum(chg) OVER (PARTITION BY trackid ORDER BY seq) AS island FROM e),
         h AS (SELECT concat(trackid, '_', island) AS track, part, count(*) AS n FROM g GROUP BY 1, 2 HAVING count(*) > 1)"""
_dn = lambda fx: C.day_night_tracks(fx.catalog_a.withColumn("local_time", F.col("time")))
register("F9_C2_day_night_tracks", lambda fx: _dn(fx).groupBy(F.col("trackid").alias("track"), F.col("class").alias("part")).agg(F.count(F.lit(1)).alias("n")), f"WITH {_DN} SELECT track, part, n FROM h")
register("F10_path_length", lambda fx: C.paths(C.run_dedup(fx.catalog_a.where("coord_idx IS NOT NULL"))).where(F.size("path") >= 60).select("trackid", F.size("path").alias("n")),
         """WITH p AS (SELECT trackid, coord_idx, lag(coord_idx) OVER (PARTITION BY trackid ORDER BY seq) AS b FROM fx_catalog_a WHERE coord_idx IS NOT NULL)
            SELECT trackid, count(*) AS n FROM p WHERE b IS NULL OR b <> coord_idx GROUP BY 1 HAVING count(*) >= 60""")  # fmt: skip
register("F11_hemisphere", lambda fx: _ids(C.hemisphere(_placed(fx), "lat")).unionByName(_ids(C.hemisphere(_placed(fx), "lat", False))), f"WITH {_LOC} SELECT trackid, count(*) AS n FROM loc GROUP BY 1 HAVING avg(lat) >= 15 OR avg(lat) < -15")
register("F16_dropna", lambda fx: fx.catalog_a.na.drop(subset=["coord_idx", "lf_lon"]).groupBy("trackid").agg(F.count(F.lit(1)).alias("n")), "SELECT trackid, count(*) AS n FROM fx_catalog_a WHERE coord_idx IS NOT NULL AND lf_lon IS NOT NULL GROUP BY 1")

_class = lambda pair: pair[0].groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("trackid").alias("tracks"))
_CLASS = "count(*) AS n, count(DISTINCT trackid) AS tracks"
register("C0_single_class", lambda fx: _class(C.condition(fx.catalog_a, None)), f"SELECT CAST(0 AS BIGINT) AS class, {_CLASS} FROM fx_catalog_a")
register("C1_season", lambda fx: _class(C.condition(fx.catalog_b, "season")), f"SELECT CASE WHEN month(time) IN (12,1,2) THEN 'DJF' WHEN month(time) < 6 THEN 'MAM' WHEN month(time) < 9 THEN 'JJA' ELSE 'SON' END AS class, {_CLASS} FROM fx_catalog_b GROUP BY 1")
register("C3_inland", lambda fx: _class(C.condition(fx.catalog_a.withColumn("inland_pen", F.col("regime")), "IP")), f"SELECT regime AS class, {_CLASS} FROM fx_catalog_a GROUP BY 1")
register("C4_teleconnection", lambda fx: _class(C.condition(fx.catalog_a.withColumn("teleconnection", F.when(F.col("k") < 90, F.col("k") % 3 - 1)), "teleconnection")), f"SELECT k % 3 - 1 AS class, {_CLASS} FROM fx_catalog_a WHERE k < 90 GROUP BY 1")
_MEANQ = """m AS (SELECT trackid, avg(centroid_lat) OVER (PARTITION BY trackid) AS v FROM fx_catalog_a),
            q AS (SELECT quantile_cont(v, [0, 0.2, 0.4, 0.6, 0.8, 1]) AS e FROM m)"""
register("C5_track_feature", lambda fx: _class(C.condition(fx.catalog_a.withColumn("area", F.col("centroid_lat")), "area", 5)), f"WITH {_MEANQ} SELECT CAST(1 + (v > e[2])::INT + (v > e[3])::INT + (v > e[4])::INT + (v > e[5])::INT AS BIGINT) AS class, {_CLASS} FROM m, q GROUP BY 1")
register("C6_lifecycle", lambda fx: _class(C.condition(fx.catalog_a.withColumn("lifecycle", F.col("k") / 100), "lifecycle", [0, 0.25, 0.5, 1])), f"SELECT CAST(1 + (k / 100 > 0.25)::INT + (k / 100 > 0.5)::INT AS BIGINT) AS class, {_CLASS} FROM fx_catalog_a WHERE k > 0 GROUP BY 1")
register("C7_lifetime", lambda fx: _class(C.condition(fx.catalog_a, "lifetime", 4)),
         f"""WITH l AS (SELECT *, max(time) OVER (PARTITION BY trackid) - min(time) OVER (PARTITION BY trackid) AS life FROM fx_catalog_a),
             r AS (SELECT *, row_number() OVER (ORDER BY life, trackid, seq) - 1 AS i, count(*) OVER () AS total FROM l)
             SELECT CAST(least(floor(i / floor(total / 4)), 3) AS BIGINT) AS class, {_CLASS} FROM r GROUP BY 1""")  # fmt: skip
register("C9_lifetime_edges", lambda fx: C.condition(fx.catalog_a, "lifetime", 4)[1], "WITH l AS (SELECT epoch(max(time) OVER (PARTITION BY trackid)) - epoch(min(time) OVER (PARTITION BY trackid)) AS life FROM fx_catalog_a), q AS (SELECT quantile_cont(life, [0, 0.25, 0.5, 0.75, 1]) AS e FROM l) SELECT CAST(i - 1 AS BIGINT) AS i, round(e[i], 6) AS edge FROM q, unnest(range(1, 6)) AS t(i)")
register("C8_unknown_condition", lambda fx: _class(C.condition(fx.catalog_a, "moon")), f"SELECT CAST(0 AS BIGINT) AS class, {_CLASS} FROM fx_catalog_a")
register("C9_bin_edges", lambda fx: C.condition(fx.catalog_a.withColumn("area", F.col("centroid_lat")), "area", 5)[1], f"WITH {_MEANQ} SELECT CAST(i - 1 AS BIGINT) AS i, round(e[i], 6) AS edge FROM q, unnest(range(1, 7)) AS t(i)")

_PAIRS = "SELECT trackid, orig, dest, round(orig_ivt, 6) AS orig_ivt, round(dest_ivt, 6) AS dest_ivt FROM"
_od = lambda df: df.select("trackid", "orig", "dest", "orig_ivt", "dest_ivt")
register("T1_pairs", lambda fx: C.pairs(fx.catalog_a).select("trackid", "seq", "orig", "dest", "orig_ivt", "dest_ivt"), "SELECT trackid, seq, orig, dest, round(orig_ivt, 6) AS orig_ivt, round(dest_ivt, 6) AS dest_ivt FROM fx_pairs")
_ENDS = """k AS (SELECT * FROM fx_catalog_a WHERE coord_idx IS NOT NULL), n AS (SELECT trackid FROM k GROUP BY 1 HAVING count(*) > 1),
           b AS (SELECT trackid, arg_min(coord_idx, seq) AS c, arg_min(mean_ivt, seq) AS v FROM k GROUP BY 1), d AS (SELECT trackid, arg_max(coord_idx, seq) AS c, arg_max(mean_ivt, seq) AS v FROM k GROUP BY 1),
           l AS (SELECT trackid, arg_min(coord_idx, seq) AS c, arg_min(mean_ivt, seq) AS v FROM k WHERE lf_lon IS NOT NULL GROUP BY 1)"""
for _name, _lc, _a, _b in (("T2a_birth_death", "birth-death", "b", "d"), ("T2b_birth_landfall", "birth-landfall", "b", "l"), ("T2c_landfall_death", "landfall-death", "l", "d")):
    register(_name, lambda fx, lc=_lc: _od(C.pairs(fx.catalog_a, lc)), f"WITH {_ENDS} SELECT trackid, x.c AS orig, y.c AS dest, round(x.v, 6) AS orig_ivt, round(y.v, 6) AS dest_ivt FROM {_a} x JOIN {_b} y USING (trackid) JOIN n USING (trackid)")
_ENTRY = """r AS (SELECT trackid, seq, coalesce(coord_idx IN (20, 21, 22), false) AS r FROM fx_catalog_a),
            b AS (SELECT *, min(CASE WHEN r THEN seq END) OVER (PARTITION BY trackid) AS en FROM r),
            d AS (SELECT *, min(CASE WHEN NOT r AND seq > en THEN seq END) OVER (PARTITION BY trackid) AS ex FROM b)"""
_region = lambda fx: fx.cells.where("cell BETWEEN 20 AND 22").select("cell")
register("T3_F15_to_region_exit", lambda fx: C.to_entry_region(fx.catalog_a, _region(fx)).select("trackid", "seq"), f"WITH {_ENTRY} SELECT trackid, seq FROM d WHERE en IS NOT NULL AND (ex IS NULL OR seq < ex)")
register("T3_to_region_entry", lambda fx: C.to_entry_region(fx.catalog_a, _region(fx), False).select("trackid", "seq"), f"WITH {_ENTRY} SELECT trackid, seq FROM d WHERE seq <= en")
register("T4_run_dedup", lambda fx: C.run_dedup(fx.catalog_a.where("coord_idx IS NOT NULL")).select("trackid", "seq", "coord_idx"),
         "WITH p AS (SELECT trackid, seq, coord_idx, lag(coord_idx) OVER (PARTITION BY trackid ORDER BY seq) AS b FROM fx_catalog_a WHERE coord_idx IS NOT NULL) SELECT trackid, seq, coord_idx FROM p WHERE b IS NULL OR b <> coord_idx")
register("T5_paths", lambda fx: C.paths(fx.catalog_a.where("coord_idx IS NOT NULL")).select("trackid", F.concat_ws(",", F.transform("path", lambda x: x.cast("string"))).alias("path")),
         "SELECT trackid, string_agg(CAST(coord_idx AS VARCHAR), ',' ORDER BY seq) AS path FROM fx_catalog_a WHERE coord_idx IS NOT NULL GROUP BY 1")
register("T6_track_ends", lambda fx: C.track_ends(fx.catalog_a), "SELECT trackid, count(*) AS n, arg_min(coord_idx, seq) FILTER (coord_idx IS NOT NULL) AS first, arg_max(coord_idx, seq) FILTER (coord_idx IS NOT NULL) AS last FROM fx_catalog_a GROUP BY 1")
_T7 = """s AS (SELECT trackid, seq, coord_idx, lag(coord_idx) OVER (PARTITION BY trackid ORDER BY seq) AS b FROM fx_catalog_a WHERE coord_idx IS NOT NULL),
         u AS (SELECT * FROM s WHERE b IS NULL OR b <> coord_idx), n AS (SELECT trackid, count(*) AS n FROM u GROUP BY 1),
         st AS (SELECT trackid, coord_idx AS orig, lead(coord_idx) OVER (PARTITION BY trackid ORDER BY seq) AS dest FROM u),
         ev AS (SELECT orig, dest, {value} AS v FROM fx_edges WHERE net = 0), mm AS (SELECT min(v) AS a, max(v) AS b FROM ev),
         sc AS (SELECT orig, dest, {score} AS sc FROM ev, mm),
         md AS (SELECT trackid, 1 - quantile_cont(sc, 0.5) AS stray FROM st LEFT JOIN sc USING (orig, dest) WHERE st.dest IS NOT NULL GROUP BY 1),
         tr AS (SELECT trackid, CASE WHEN n >= 4 THEN stray END AS stray FROM n LEFT JOIN md USING (trackid)),
         q AS (SELECT quantile_cont(stray, 0.33) AS lo, quantile_cont(stray, 0.66) AS hi FROM tr)
         SELECT trackid, round(stray, 6) AS stray, CASE WHEN stray <= lo THEN 'conformist' WHEN stray >= hi THEN 'stray' WHEN stray IS NOT NULL THEN 'straddler' END AS kind FROM tr, q"""
_net0 = lambda fx: fx.edges.where("net = 0")
register("T7_classify_tracks", lambda fx: C.classify_tracks(fx.catalog_a, _net0(fx), "weight"), "WITH " + _T7.format(value="ln(weight + 1e-12)", score="(v - a) / (b - a + 1e-12)"))
register("T7_classify_linear", lambda fx: C.classify_tracks(fx.catalog_a, _net0(fx), "weight", scale="linear"), "WITH " + _T7.format(value="weight", score="v / (b + 1e-12)"))
# which tracks are drawn can't be told in SQL: how many, and how many rows of them are missing
register("T8_O3_sample_tracks", lambda fx: _ids(C.sample_tracks(fx.catalog_a, 20, 123)), "WITH t AS (SELECT trackid FROM (SELECT DISTINCT trackid FROM fx_catalog_a) ORDER BY md5(concat_ws(':', '123', trackid)), trackid LIMIT 20) SELECT trackid, count(*) AS n FROM fx_catalog_a JOIN t USING (trackid) GROUP BY 1")
register("T9_track_means", lambda fx: C.track_means(fx.catalog_a, "mean_ivt", "centroid_lat"), "SELECT trackid, round(avg(mean_ivt), 6) AS mean_ivt, round(avg(centroid_lat), 6) AS centroid_lat, count(*) / 4 AS days FROM fx_catalog_a GROUP BY 1")
register("T10_preprocess", lambda fx: C.preprocess(fx.catalog_a, loc="centroid", res=7, cond="season").groupBy("class", "coord_idx").agg(F.count(F.lit(1)).alias("n")),
         f"""WITH c AS (SELECT -180 + 7 * least(52, greatest(0, ceil((centroid_lon + 180) / 7 - 0.5))) AS lon, -90 + 7 * least(26, greatest(0, ceil((centroid_lat + 90) / 7 - 0.5))) AS lat, month(time) AS m FROM fx_catalog_a)
             SELECT CASE WHEN m IN (12,1,2) THEN 'DJF' WHEN m < 6 THEN 'MAM' WHEN m < 9 THEN 'JJA' ELSE 'SON' END AS class, {_HASH} AS coord_idx, count(*) AS n FROM c GROUP BY 1, 2""")  # fmt: skip

_series = lambda fx: climate.smoothed(climate.monthly_series(fx.index))
_SM = "s AS (SELECT make_date(year, month, 1) AS d, idx, CASE WHEN count(idx) OVER w = 3 THEN avg(idx) OVER w END AS avg3 FROM fx_index WINDOW w AS (ORDER BY year, month ROWS 2 PRECEDING))"
_PHASE = _SM + """, z AS (SELECT d, (avg3 - avg(avg3) OVER ()) / stddev_pop(avg3) OVER () AS z FROM s),
         c AS (SELECT d, coalesce((z > 0.3)::INT, 0) AS p, coalesce((z < -0.3)::INT, 0) AS n FROM z),
         g AS (SELECT *, row_number() OVER (ORDER BY d) - row_number() OVER (PARTITION BY p ORDER BY d) AS gp, row_number() OVER (ORDER BY d) - row_number() OVER (PARTITION BY n ORDER BY d) AS gn FROM c),
         r AS (SELECT *, sum(p) OVER (PARTITION BY p, gp ORDER BY d) AS rp, sum(n) OVER (PARTITION BY n, gn ORDER BY d) AS rn FROM g),
         ph AS (SELECT d, CAST(CASE WHEN p = 1 AND rp >= 2 THEN 1 ELSE 0 END - CASE WHEN n = 1 AND rn >= 2 THEN 1 ELSE 0 END AS BIGINT) AS phase FROM r)"""
_phases = lambda fx: climate.sustained_phases(_series(fx), "avg3", 0.3, 2)
register("V1_melt", lambda fx: climate.melt_months(fx.index.groupBy("year").pivot("month", list(range(1, 13))).agg(F.first("idx")).select("year", *[F.col(str(i)).alias(f"m{i}") for i in range(1, 13)])),
         "SELECT CAST(y.year AS BIGINT) AS year, CAST(m AS BIGINT) AS month, round(idx, 6) AS idx FROM (SELECT DISTINCT year FROM fx_index) y CROSS JOIN (SELECT unnest(range(1, 13)) AS m) LEFT JOIN fx_index i ON i.year = y.year AND i.month = m")
register("W2_rolling_mean", lambda fx: _series(fx).select(F.col("month_start").cast("string").alias("day"), "avg3"), f"WITH {_SM} SELECT strftime(d, '%Y-%m-%d') AS day, round(avg3, 6) AS avg3 FROM s")
register("W5_sustained_phases", lambda fx: _phases(fx).select(F.col("month_start").cast("string").alias("day"), "phase"), f"WITH {_PHASE} SELECT strftime(d, '%Y-%m-%d') AS day, phase FROM ph")
_DAYS = """, days AS (SELECT CAST(unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS DATE) AS d FROM ph),
         dl AS (SELECT days.d, last_value(phase IGNORE NULLS) OVER (ORDER BY days.d) AS phase FROM days LEFT JOIN ph ON ph.d = days.d)"""
register("J12_daily_fill", lambda fx: climate.daily(_phases(fx), "phase").select(F.col("day").cast("string").alias("day"), "phase"), f"WITH {_PHASE}{_DAYS} SELECT strftime(d, '%Y-%m-%d') AS day, phase FROM dl")
register("J1_daily_index", lambda fx: climate.with_index(fx.catalog_b, climate.daily(_phases(fx), "phase"), "phase").groupBy("teleconnection").agg(F.count(F.lit(1)).alias("n")),
         f"WITH {_PHASE}{_DAYS} SELECT phase AS teleconnection, count(*) AS n FROM fx_catalog_b LEFT JOIN dl ON dl.d = CAST(time AS DATE) GROUP BY 1")

_REGIME = f"""{_PHASE}{_DAYS}, k AS (SELECT phase AS class, trackid, seq, coord_idx FROM fx_catalog_b JOIN dl ON dl.d = CAST(time AS DATE) WHERE phase IS NOT NULL),
         pr AS (SELECT class, coord_idx AS orig, lead(coord_idx) OVER (PARTITION BY class, trackid ORDER BY seq) AS dest FROM k),
         e AS (SELECT class, orig, dest, CAST(count(*) AS DOUBLE) AS weight FROM pr WHERE dest IS NOT NULL AND orig <> dest GROUP BY 1, 2, 3 HAVING count(*) >= 2)"""
register("regime_networks", lambda fx: pipelines.regime_networks(fx.catalog_b, climate.daily(_phases(fx), "phase"), 2), f"WITH {_REGIME} SELECT class, orig, dest, weight FROM e")
register("regime_change", lambda fx: pipelines.regime_change(fx.catalog_b, climate.daily(_phases(fx), "phase"), 2, -1, 1),
         f"WITH {_REGIME}, sg AS (SELECT class, c, sum(weight) AS d FROM (SELECT class, orig AS c, weight FROM e UNION ALL SELECT class, dest, weight FROM e) GROUP BY 1, 2) SELECT x.c AS coord_id, round(y.d - x.d, 6) AS change FROM sg x JOIN sg y ON x.c = y.c AND x.class = -1 AND y.class = 1")
_KINDS = "t7 AS (WITH " + _T7.format(value="ln(weight + 1e-12)", score="(v - a) / (b - a + 1e-12)") + "), m AS (SELECT trackid, avg(mean_ivt) AS v FROM fx_catalog_a GROUP BY 1), w AS (SELECT v, kind FROM m JOIN t7 USING (trackid) WHERE kind IN ('conformist', 'stray'))"
register("typed_track_tests", lambda fx: pipelines.typed_track_tests(fx.catalog_a, _net0(fx), "mean_ivt").select("statistic"),
         f"""WITH {_KINDS}, c AS (SELECT v, sum(count(*) FILTER (kind = 'conformist')) OVER (ORDER BY v) AS a, sum(count(*) FILTER (kind = 'stray')) OVER (ORDER BY v) AS b FROM w GROUP BY v),
             n AS (SELECT count(*) FILTER (kind = 'conformist') AS na, count(*) FILTER (kind = 'stray') AS nb FROM w) SELECT round(max(abs(a / na - b / nb)), 6) AS statistic FROM c, n""")  # fmt: skip
