"""SQL counterparts of the registered queries, over the same tables."""

from __future__ import annotations

_FILES = r"""files AS (SELECT file_id,
  regexp_extract(file_id, '{n}', 1) AS mode, regexp_extract(file_id, '{n}', 2) AS start, regexp_extract(file_id, '{n}', 4) AS orbit,
  regexp_extract(file_id, '{n}', 5) AS collection, regexp_extract(file_id, '{n}', 6) AS version, regexp_extract(file_id, '{n}', 7) AS modified
  FROM (SELECT DISTINCT file_id FROM satellite_obs) f),
chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY orbit ORDER BY CASE WHEN mode = 'RPRO' THEN 1 ELSE 0 END DESC, modified DESC, file_id DESC) AS rn,
  count(*) OVER (PARTITION BY orbit) AS n_files FROM files WHERE collection = '03') c WHERE rn = 1)""".replace(
    "{n}", r"S5P_(\w{4})_L2__CH4____(\d{8}T\d{6})_(\d{8}T\d{6})_(\d{5})_(\d{2})_(\d{6})_(\d{8}T\d{6})"
)
_OBS = (
    _FILES
    + """,
obs AS (SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY file_id, scanline, pixel ORDER BY obs_time, lon, lat, xch4, qa) AS rn FROM satellite_obs s
  WHERE file_id IN (SELECT file_id FROM chosen) AND lon > -108.15625 AND lon < -100.03125 AND lat > 27.875 AND lat < 35.875 AND lat > -60 AND qa >= 0.5
  AND list_max(lon_b) - list_min(lon_b) < 100 AND xch4 IS NOT NULL AND NOT isnan(xch4) AND xch4 <> -9999 AND coalesce(surface_class & 3, 5) <> 1) o WHERE rn = 1)"""
)
_I = "CAST(least(greatest(ceil((lon + 108.0) / 0.3125 - 0.5), 0), 25) AS INT)"
_J = "CAST(least(greatest(ceil((lat - 28.0) / 0.25 - 0.5), 0), 31) AS INT)"
_CENTER = (
    _OBS
    + f""",
near AS (SELECT *, {_I} AS i, {_J} AS j FROM obs),
cen AS (SELECT * FROM near WHERE abs(lon - (-108.0 + i * 0.3125)) < 0.5 AND abs(lat - (28.0 + j * 0.25)) < 0.5),
sup AS (SELECT file_id, i, j, CAST(count(*) AS DOUBLE) AS n, avg(xch4) AS xch4, avg(lon) AS lon, avg(lat) AS lat,
  CAST(round_even(floor(avg(floor(epoch(obs_time)))) / 3600.0, 0) AS BIGINT) AS hour FROM cen GROUP BY file_id, i, j)"""
)
_EMIS = """em AS (SELECT CAST(l_shipdate AS DATE) AS d, CAST(l_partkey % 26 AS INT) AS i, CAST(l_suppkey % 32 AS INT) AS j,
  CASE WHEN l_returnflag = 'A' THEN 'Oil' WHEN l_returnflag = 'N' THEN 'Gas' ELSE 'Soil' END AS sector,
  l_quantity * CAST(0.27182818284 AS DOUBLE) AS flux, CAST(600 + 3 * (l_suppkey % 32) AS DOUBLE) AS area FROM lineitem)"""
_MEAN = _EMIS + ", mean AS (SELECT i, j, sector, avg(flux) AS flux, avg(area) AS area FROM em GROUP BY i, j, sector)"
_ROI = "roi AS (SELECT element, i, j FROM state_vector WHERE is_roi)"
_LAB = "lab AS (SELECT element, i, j, is_roi FROM state_vector WHERE element IS NOT NULL)"
_TG = "CAST(86400 AS DOUBLE) * 365 * 1e-9"
_COUNTS = _OBS + ", cnt AS (SELECT CAST(floor(lon / 0.3125) AS INT) AS bi, CAST(floor(lat / 0.25) AS INT) AS bj, CAST(floor(epoch(obs_time) / 86400) AS BIGINT) AS day, count(*) AS obs_count FROM obs GROUP BY 1, 2, 3)"
_OFF = "off AS (SELECT a.x AS di, b.x AS dj FROM (SELECT unnest([-2, -1, 0, 1, 2]) AS x) a, (SELECT unnest([-2, -1, 0, 1, 2]) AS x) b)"
_DIL = f"{_OFF}, dil AS (SELECT DISTINCT element, i + di AS i, j + dj AS j FROM src, off WHERE i + di BETWEEN 0 AND 25 AND j + dj BETWEEN 0 AND 31)"
_ELC = (
    _COUNTS
    + f", {_ROI}, src AS (SELECT * FROM roi), {_DIL}, cell AS (SELECT bi + 346 AS i, bj - 112 AS j, sum(obs_count) AS obs, count(*) AS days FROM cnt GROUP BY 1, 2), "
    + "elc AS (SELECT element, CAST(sum(obs) AS BIGINT) AS num_obs, CAST(sum(days) AS BIGINT) AS num_days FROM dil JOIN cell USING (i, j) GROUP BY element)"
)
_PAIRS = _CENTER + ", pairs AS (SELECT CAST(floor(epoch(obs_time) / 86400) AS BIGINT) AS day, i, j, 1850.0 + i * 0.5 - j * 0.25 AS model, xch4 AS satellite FROM cen), daily AS (SELECT day, i, j, avg(CAST(model AS DOUBLE)) - avg(satellite) AS bias FROM pairs GROUP BY day, i, j)"
_TRAIL = (
    _PAIRS
    + """, dense AS (SELECT c.i, c.j, g.day FROM state_vector c, (SELECT unnest(generate_series((SELECT min(day) FROM daily), (SELECT max(day) FROM daily))) AS day) g),
tr AS (SELECT day, i, j, coalesce(avg(bias) OVER (PARTITION BY i, j ORDER BY day ROWS BETWEEN 14 PRECEDING AND CURRENT ROW), avg(bias) OVER (PARTITION BY i, j ORDER BY day ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)) AS bias
  FROM dense LEFT JOIN daily USING (day, i, j))"""
)
_BANDS = (
    _TRAIL
    + """, rows_ AS (SELECT day, j, CASE WHEN count(bias) >= 3 THEN avg(bias) END AS v FROM tr GROUP BY day, j),
ends AS (SELECT day, j, v, last_value(CASE WHEN v IS NOT NULL THEN j END IGNORE NULLS) OVER lo AS jl, last_value(v IGNORE NULLS) OVER lo AS vl,
  first_value(CASE WHEN v IS NOT NULL THEN j END IGNORE NULLS) OVER hi AS jh, first_value(v IGNORE NULLS) OVER hi AS vh FROM rows_
  WINDOW lo AS (PARTITION BY day ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), hi AS (PARTITION BY day ORDER BY j ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
band AS (SELECT day, j, coalesce(v, CASE WHEN jh > jl THEN vl + CAST(j - jl AS DOUBLE) / (jh - jl) * (vh - vl) END, vh, vl) AS band FROM ends)"""
)
_TENTH = _OBS + ", tenth AS (SELECT CAST(round_even(lon * 10, 0) AS INT) AS lon10, CAST(round_even(lat * 10, 0) AS INT) AS lat10, count(*) AS n, avg(xch4) AS mean FROM obs GROUP BY 1, 2)"
_SENS = _COUNTS + ", c2 AS (SELECT bi + 346 AS i, bj - 112 AS j, sum(obs_count) AS n FROM cnt GROUP BY 1, 2), sens AS (SELECT s.i, s.j, s.element, s.is_roi, coalesce(n / (n + 25.0), 0) AS a FROM state_vector s LEFT JOIN c2 ON s.i = c2.i AND s.j = c2.j)"
_PT = f"pt AS (SELECT {_I} AS i, {_J} AS j, lon, lat FROM point_sources WHERE lon IS NOT NULL AND lat IS NOT NULL AND NOT isnan(lon) AND NOT isnan(lat) AND lon <> -9999 AND lat <> -9999), ptc AS (SELECT i, j FROM pt WHERE abs(lon - (-108.0 + i * 0.3125)) < 0.5 AND abs(lat - (28.0 + j * 0.25)) < 0.5)"
_ERR2 = "(225.0 * (0.45 / greatest(p, 1) + 0.55) + 20.25)"
_L, _KF = "(cells * 25000.0)", "(cells * 25000.0) * (CAST(0.4 AS DOUBLE) * 0.029 * 9.8 / (0.01604 * (5 * 1000.0 / 3600) * 101325.0))"

_USABLE = "value IS NOT NULL AND NOT isnan(value) AND value > 0 AND value < 1e20"

_NEAREST = "CASE WHEN {0} > 1.5 THEN 'ppt' WHEN {0} > -1.5 THEN 'ppb' WHEN {0} > -5 THEN 'ppm' WHEN {0} > -8 THEN 'percent' ELSE 'mol/mol' END"
_FILE_UNITS = f"fu AS (SELECT file_name, median(CASE WHEN {_USABLE} THEN log10(value) END) - 3.267 AS vm, median(CASE WHEN ch4 > 0 AND NOT isnan(ch4) THEN log10(ch4) END) - 3.267 AS cm FROM obspack GROUP BY file_name)"
_PPB = "{0} * CASE {1} WHEN 'ppt' THEN 1e-3 WHEN 'ppb' THEN 1.0 WHEN 'ppm' THEN 1e3 WHEN 'percent' THEN 1e7 ELSE 1e9 END"
_READ = f"""{_FILE_UNITS}, ro AS (SELECT row_id, obspack_id, time, utc_conv, obs_flag, latitude, split_part(obspack_id, '~', 2) AS dataset, split_part(split_part(obspack_id, '~', 2), '_', 2) AS site,
  CASE WHEN {_USABLE} THEN {_PPB.format("value", "(" + _NEAREST.format("vm") + ")")} END AS p, CASE WHEN NOT isnan(ch4) AND ch4 > 0 THEN {_PPB.format("ch4", "(" + _NEAREST.format("cm") + ")")} END AS c FROM obspack LEFT JOIN fu USING (file_name)),
rd AS (SELECT * EXCLUDE (p, c), CASE WHEN p BETWEEN 500 AND 5000 THEN p END AS ppb, CASE WHEN c BETWEEN 500 AND 5000 THEN c END AS ch4_ppb FROM ro)"""
_DAYS = _READ + ", sd AS (SELECT site, CAST(floor(epoch(time) / 86400) AS BIGINT) AS day, avg(ppb) AS ppb FROM rd WHERE ppb IS NOT NULL GROUP BY 1, 2)"
_PER = r"\s*(/|per|an?)?\s*"
_RATE_OF = (
    "CASE WHEN regexp_matches(lower({0}), '(^|[^a-z])(kt|gg|kilotonnes?)" + _PER + "(y|yr|year|a|annum)([^a-z]|$)') THEN 'kt/yr' "
    "WHEN regexp_matches(lower({0}), '(^|[^a-z])(lbs?|pounds?)" + _PER + "(h|hr|hour|hourly)([^a-z]|$)') THEN 'lb/h' "
    "WHEN regexp_matches(lower({0}), '(^|[^a-z])(kgh|(kg|kilograms?)( ch4)?" + _PER + "(h|hr|hour|hourly))([^a-z]|$)') THEN 'kg/h' "
    "WHEN regexp_matches(lower({0}), '(^|[^a-z])(g|grams?)" + _PER + "(s|sec|second)([^a-z]|$)') THEN 'g/s' "
    "WHEN regexp_matches(lower({0}), '(^|[^a-z])(t|mg|tonnes?|tons?)" + _PER + "(h|hr|hour|hourly)([^a-z]|$)') THEN 't/h' END"
)


def _hex_double(at: int) -> str:
    big = " || ".join(f"substr(g, {at + k}, 2)" for k in range(14, -1, -2))
    top = f"CAST('0x' || substr({big}, 1, 3) AS BIGINT)"
    return f"(CASE WHEN {top} >= 2048 THEN -1 ELSE 1 END) * (1 + CAST('0x' || substr({big}, 4, 13) AS BIGINT) / pow(2.0, 52)) * pow(2.0, {top} % 2048 - 1023)"


_NUM = r"[-+]?[0-9]+(?:\.[0-9]*)?"
_POSITION = f"""raw AS (SELECT plume_id, trim(geometry) AS g, lon, lat, regexp_matches(trim(geometry), '^01[0-9A-Fa-f]{{40}}$') AS w FROM plumes),
 ab AS (SELECT plume_id, lon, lat, CASE WHEN w THEN {_hex_double(11)} ELSE try_cast(regexp_extract(g, '({_NUM})[ ,]+({_NUM})[^0-9.]', 1) AS DOUBLE) END AS a,
  CASE WHEN w THEN {_hex_double(27)} ELSE try_cast(regexp_extract(g, '({_NUM})[ ,]+({_NUM})[^0-9.]', 2) AS DOUBLE) END AS b FROM raw),
 both_ AS (SELECT plume_id, coalesce(a, CASE WHEN NOT isnan(lon) AND lon <> -9999 AND NOT isnan(lat) AND lat <> -9999 THEN lon END) AS a, coalesce(b, CASE WHEN NOT isnan(lon) AND lon <> -9999 AND NOT isnan(lat) AND lat <> -9999 THEN lat END) AS b FROM ab),
 turned AS (SELECT plume_id, CASE WHEN abs(b) <= 90 THEN a ELSE b END AS lon, CASE WHEN abs(b) <= 90 THEN b ELSE a END AS lat FROM both_ WHERE a IS NOT NULL AND b IS NOT NULL),
 pos AS (SELECT plume_id, lon - 360 * CAST(round(lon / 360) AS INT) AS lon, lat FROM turned)"""

_REMAP = f"""{_CENTER}, mod AS (SELECT i, j, 995.0 - (i + j) % 17 AS s FROM state_vector),
 lay AS (SELECT i, j, s, k, s - k * (999.5 / 47) AS b, s - (k + 1) * (999.5 / 47) AS t, (1900.0 - 3 * k + i % 5) AS c FROM mod, (SELECT unnest(generate_series(0, 46)) AS k) g),
 px AS (SELECT c.file_id, c.scanline, c.pixel, c.i, c.j, q.l, greatest(psurf - q.l * dp, 0) AS b, greatest(psurf - (q.l + 1) * dp, 0) AS t, psurf, greatest(psurf - 12 * dp, 0) AS top FROM cen c, (SELECT unnest(generate_series(0, 11)) AS l) q),
 ov AS (SELECT px.file_id, px.scanline, px.pixel, px.l, px.top, lay.s, lay.c, greatest(0, least(px.b, CASE WHEN lay.k = 0 THEN greatest(lay.b, px.psurf) ELSE lay.b END) - greatest(px.t, lay.t)) AS w FROM px JOIN lay ON px.i = lay.i AND px.j = lay.j),
 av AS (SELECT file_id, scanline, pixel, l, sum(w * c) / nullif(sum(w), 0) AS x FROM ov WHERE top >= s - 999.5 - 1e-9 GROUP BY file_id, scanline, pixel, l)"""
_SPAN = "span AS (SELECT min(d) AS d0, date_diff('day', min(d), max(d)) + 1 AS days FROM em)"


def _nudge(periods: int = 8, step: int = 360) -> str:
    """The chain of states, one CTE per period; periods beyond the table's leave the state as it is."""
    out = f"""WITH {_EMIS}, {_SPAN}, {_ROI}, {_LAB}, x AS (SELECT em.*, date_diff('day', d0, d) AS n, days FROM em, span WHERE sector <> 'Soil'),
 mp AS (SELECT CAST(n // {step} + 1 AS INT) AS period, i, j, avg(flux) AS flux, avg(area) AS area FROM x WHERE n < {step} * (days // {step}) GROUP BY 1, 2, 3), s0 AS (SELECT i, j, 1.0 AS sf FROM state_vector)"""
    for p in range(1, periods + 1):
        post = f"0.75 + (element * 3 + {p}) % 5 * 0.125 - CASE WHEN element % 97 = {p} THEN 2.0 ELSE 0.0 END"
        out += f""",
 a{p} AS (SELECT s.i, s.j, sf, flux, area, roi.i IS NOT NULL AS inroi, flux * sf * coalesce({post.replace("element", "lab.element")}, 1.0) AS now FROM s{p - 1} s LEFT JOIN (SELECT * FROM mp WHERE period = {p}) m ON s.i = m.i AND s.j = m.j
  LEFT JOIN lab ON s.i = lab.i AND s.j = lab.j LEFT JOIN roi ON s.i = roi.i AND s.j = roi.j),
 n{p} AS (SELECT *, 0.1 * flux + 0.9 * greatest(now, 0) AS nudged FROM a{p}), t{p} AS (SELECT sum(now * area) / sum(nudged * area) AS share FROM n{p} WHERE inroi),
 s{p} AS (SELECT i, j, CASE WHEN days // {step} < {p} THEN sf ELSE coalesce(CASE WHEN inroi AND flux <> 0 THEN nudged * share / flux END, 1.0) END AS sf FROM n{p}, t{p}, span)"""
    return out + f" SELECT i, j, round(sf, 6) AS sf FROM s{periods}"


_NUDGE = _nudge()



def _clip(source: str, axis: str, bound: str, sign: int) -> str:
    """Polygons ``p`` of ``source`` cut at one side of their cell."""
    far = lambda q: f"({sign} * ({q}.{axis} - ({bound})))"
    cur, prev = "p[k]", "p[CASE WHEN k = 1 THEN len(p) ELSE k - 1 END]"
    t = f"{far(prev)} / ({far(prev)} - {far(cur)})"
    cross = "{" + ", ".join(f"'{c}': {prev}.{c} + {t} * ({cur}.{c} - {prev}.{c})" for c in "xy") + "}"
    return f"SELECT * EXCLUDE (p), list_filter(flatten(list_transform(generate_series(1, len(p)), lambda k: [CASE WHEN ({far(prev)} >= 0) <> ({far(cur)} >= 0) THEN {cross} END, CASE WHEN {far(cur)} >= 0 THEN {cur} END])), lambda q: q IS NOT NULL) AS p FROM {source}"


_NEAR_I, _NEAR_J = _I.replace("lon", "lon_b[{0}]"), _J.replace("lat", "lat_b[{0}]")
_OVERLAP = (
    _OBS
    + ", ov0 AS (SELECT *, ["
    + ", ".join(_NEAR_I.format(k) for k in range(1, 5))
    + "] AS ii, ["
    + ", ".join(_NEAR_J.format(k) for k in range(1, 5))
    + "] AS jj, ["
    + ", ".join(f"{{'x': lon_b[{k}], 'y': lat_b[{k}]}}" for k in range(1, 5))
    + "] AS p FROM obs), ov1 AS (SELECT *, unnest(list_distinct(ii)) AS i FROM ov0 WHERE "
    + " AND ".join(f"abs(lon_b[{k}] - (-108.0 + ii[{k}] * 0.3125)) < 0.5 AND abs(lat_b[{k}] - (28.0 + jj[{k}] * 0.25)) < 0.5" for k in range(1, 5))
    + "), c0 AS (SELECT file_id, scanline, pixel, obs_time, lon, lat, xch4, p, i, unnest(list_distinct(jj)) AS j FROM ov1), "
    + f"c1 AS ({_clip('c0', 'x', '-108.0 + i * 0.3125 - 0.15625', 1)}), c2 AS ({_clip('c1', 'x', '-108.0 + i * 0.3125 + 0.15625', -1)}), "
    + f"c3 AS ({_clip('c2', 'y', '28.0 + j * 0.25 - 0.125', 1)}), c4 AS ({_clip('c3', 'y', '28.0 + j * 0.25 + 0.125', -1)}), "
    + "ar AS (SELECT * EXCLUDE (p), 0.5 * abs(list_sum(list_transform(generate_series(1, len(p)), lambda k: p[k].x * p[k % len(p) + 1].y - p[k % len(p) + 1].x * p[k].y))) AS area FROM c4 WHERE len(p) > 2), "
    + "wt AS (SELECT *, area / sum(area) OVER (PARTITION BY file_id, scanline, pixel) AS w FROM ar WHERE area > 0)"
)

ORACLE_SQL: dict[str, str] = {
    "p5_found": f"""WITH u AS (SELECT DISTINCT split_part(split_part(obspack_id, '~', 2), '_', 2) AS site, CAST(floor(epoch(time) / 3600) AS BIGINT) AS h FROM obspack
  WHERE contains(split_part(obspack_id, '~', 2), 'insitu') AND {_USABLE}),
 m AS (SELECT site, h, strftime(make_timestamp(h * 3600000000), '%Y-%m') AS mon FROM u),
 b AS (SELECT site, mon, min(h) AS a, max(h) AS z FROM m GROUP BY site, mon), g AS (SELECT site, unnest(generate_series(a, z)) AS h FROM b),
 x AS (SELECT site, h FROM g EXCEPT SELECT site, h FROM u)
SELECT site AS sitecode, strftime(make_timestamp(h * 3600000000), '%Y-%m-%dT%H') AS slot FROM x""",
    "orbit_files": f"WITH {_FILES} SELECT orbit, file_id, mode, version, n_files FROM chosen",
    "duplicate_orbits": f"WITH {_FILES} SELECT orbit, count(*) AS n_files, count(DISTINCT mode) AS n_modes FROM files GROUP BY orbit HAVING count(*) > 1",
    "filter_obs": f"WITH {_OBS} SELECT file_id, scanline, pixel, round(lon, 6) AS lon, round(lat, 6) AS lat, round(xch4, 6) AS xch4 FROM obs",
    "sounding_derived": """SELECT file_id, scanline, pixel, round(2.4 * nir - 1.13 * swir, 6) AS albedo, CAST(coalesce(surface_class & 3, 5) AS BIGINT) AS surface,
  round(13 * psurf - 78 * dp + 1e-9, 4) AS edge_sum, round(psurf - 12 * dp + 1e-9, 4) AS top FROM satellite_obs""",
    "files_in_window": f"WITH {_FILES} SELECT file_id, count(*) AS n FROM satellite_obs JOIN files USING (file_id) WHERE substr(start, 1, 8) >= '20090310' AND substr(start, 1, 8) < '20090410' GROUP BY file_id",
    "missing_days": "SELECT CAST(CAST(g.day AS DATE) AS VARCHAR) AS day FROM (SELECT unnest(generate_series((SELECT CAST(min(o_orderdate) AS DATE) FROM orders), (SELECT CAST(max(o_orderdate) AS DATE) FROM orders), INTERVAL 1 DAY)) AS day) g WHERE CAST(g.day AS DATE) NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders)",
    "daily_bin_counts": f"WITH {_COUNTS} SELECT * FROM cnt",
    "nearest_cell": f"WITH {_CENTER} SELECT file_id, scanline, pixel, i, j FROM cen",
    "superobs_center": f"WITH {_CENTER} SELECT file_id, i, j, n, round(xch4 + 1e-9, 4) AS xch4, round(lon, 6) AS lon, round(lat, 6) AS lat, hour FROM sup",
    "superobs_profiles": f"WITH {_CENTER}, x AS (SELECT *, unnest(generate_series(1, 12)) AS l FROM cen) SELECT file_id, i, j, CAST(l - 1 AS INT) AS layer, round(avg(ak[l]), 6) AS ak, round(avg(subcol[l]), 5) AS subcol FROM x GROUP BY file_id, i, j, l",
    "superobs_error": f"WITH {_CENTER}, g AS (SELECT CAST(n AS BIGINT) AS p, count(*) AS n FROM sup GROUP BY 1) SELECT p, n, round(225.0 * {_ERR2} / 245.25, 6) AS variance, round(sqrt({_ERR2}), 6) AS error FROM g",
    "vertical_remap": f"""WITH {_REMAP}
SELECT file_id, scanline, pixel, round(max(CASE WHEN l = 0 THEN x END), 5) AS bottom, round(max(CASE WHEN l = 11 THEN x END), 5) AS top FROM av GROUP BY file_id, scanline, pixel""",
    "preview_dofs": f"""WITH {_ELC}, {_MEAN}, tg AS (SELECT i, j, sum(flux * area) * {_TG} AS tg FROM mean GROUP BY i, j),
 sz AS (SELECT element, coalesce(sum(tg), 0) AS emission, count(*) AS cells FROM roi LEFT JOIN tg USING (i, j) GROUP BY element),
 al AS (SELECT element, emission, cells, coalesce(num_obs, 0) AS num_obs, coalesce(num_days, 0) AS num_days FROM sz LEFT JOIN elc USING (element)),
 q AS (SELECT *, 0.5 * emission * 1e9 / (3600.0 * 24 * 365) / ({_L} * {_L}) AS sa, CASE WHEN num_days > 0 THEN sqrt(225.0 * (0.45 / greatest(CAST(num_obs AS DOUBLE) / num_days, 1) + 0.55) + 20.25) * 1e-9 / ({_KF}) END AS so FROM al)
SELECT element, round(emission, 8) AS emission, num_obs, num_days, round(CASE WHEN num_days > 0 THEN coalesce(sa * sa / (sa * sa + so * so / num_days), 0) ELSE 0 END, 6) AS sensitivity FROM q""",
    "dilated_counts": f"WITH {_ELC} SELECT element, num_obs, num_days FROM elc",
    "dilated_cells": f"WITH {_LAB}, src AS (SELECT * FROM lab), {_DIL} SELECT element, count(*) AS cells, min(i) AS i0, max(i) AS i1, min(j) AS j0, max(j) AS j1 FROM dil GROUP BY element",
    "mean_emissions": f"WITH {_MEAN} SELECT i, j, sector, round(flux, 6) AS flux FROM mean",
    "total_emissions": f"WITH {_MEAN}, {_ROI} SELECT round(sum(flux * area) * {_TG}, 6) AS total FROM mean WHERE (i, j) IN (SELECT (i, j) FROM roi)",
    "sector_totals": f"WITH {_MEAN}, {_ROI} SELECT sector, round(sum(flux * area) * {_TG}, 6) AS total FROM mean WHERE (i, j) IN (SELECT (i, j) FROM roi) GROUP BY sector HAVING sum(flux * area) > 0",
    "posterior_emissions": f"""WITH {_MEAN}, {_LAB} SELECT sector, round(sum(flux * area), 3) AS prior,
  round(sum(flux * area * CASE WHEN sector = 'Soil' THEN 1.0 ELSE coalesce(0.5 + (element % 7) * 0.25, 1.0) END), 3) AS posterior FROM mean LEFT JOIN lab USING (i, j) GROUP BY sector""",
    "perturbation_sf": f"""WITH {_MEAN}, {_LAB}, f AS (SELECT i, j, sum(flux) AS flux FROM mean GROUP BY i, j),
 m AS (SELECT element, median(CASE WHEN flux <> 0 THEN 1.0 / flux END) AS m FROM lab LEFT JOIN f USING (i, j) GROUP BY element)
SELECT element, round(coalesce(least(m, 1.5e7), 1.0), 6) AS jacobian_sf, round(coalesce(least(m, 1.5e7), 1.0) - 1, 6) AS effective_sf FROM m""",
    "gridded_scale": "SELECT i, j, round(CASE WHEN element IS NULL THEN 1.0 ELSE 1.0 + (element % 11) / 10.0 END, 6) AS scale FROM state_vector",
    "normal_equations": """WITH e AS (SELECT list_append(CAST(embedding AS DOUBLE[]), CAST(embedding[10] AS DOUBLE)) AS k, 225.0 * (225.0 * (0.45 / greatest(1 + label, 1) + 0.55) + 20.25) / 245.25 AS v FROM embeddings),
 r AS (SELECT k, v, unnest(generate_series(1, len(k) - 1)) AS r FROM e), c AS (SELECT *, unnest(generate_series(1, len(k))) AS c FROM r)
SELECT CAST(r - 1 AS INT) AS "row", CAST(c - 1 AS INT) AS col, round(sum(k[r] * k[c] / v), 6) + 0.0 AS v FROM c GROUP BY r, c""",
    "rescaled_jacobian": """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS k, unnest(generate_series(1, len(embedding))) AS e FROM embeddings)
SELECT vec_id, CAST(e - 1 AS INT) AS element, round(k[e] * CASE WHEN e <= len(k) - 2 THEN (1.5 + 0.1 * (e - 1)) / (2.0 + k[e] * k[e]) * (1e-8 / 2e-8) ELSE 1.0 END, 5) + 0.0 AS k FROM v""",
    "daily_bias": f"WITH {_PAIRS} SELECT day, i, j, round(bias + 1e-9, 4) AS bias FROM daily",
    "spatial_smooth": f"WITH {_PAIRS}, {_OFF} SELECT day, i + di AS i, j + dj AS j, round(avg(bias) + 1e-9, 4) AS bias FROM daily, off WHERE i + di BETWEEN 0 AND 25 AND j + dj BETWEEN 0 AND 31 GROUP BY day, i + di, j + dj HAVING count(bias) >= 4",
    "trailing_bias": f"WITH {_TRAIL} SELECT day, i, j, round(bias + 1e-9, 4) AS bias FROM tr WHERE bias IS NOT NULL",
    "lat_fill": f"WITH {_BANDS} SELECT day, j, round(band + 1e-9, 4) AS band FROM band WHERE band IS NOT NULL",
    "corrected_boundaries": f"WITH {_BANDS}, fb AS (SELECT day, i, j, coalesce(bias, band, 0) AS bias FROM tr LEFT JOIN band USING (day, j)) SELECT day, CAST(lev AS INT) AS lev, round(avg(1900.0 - 10 * lev - bias) + 1e-9, 4) AS ppb FROM fb, (SELECT unnest([1, 2, 3]) AS lev) l GROUP BY day, lev",
    "kalman_periods": f"WITH {_EMIS}, {_SPAN}, x AS (SELECT *, date_diff('day', d0, d) AS n FROM em, span) SELECT CAST(n // 30 + 1 AS INT) AS period_number, count(*) AS n, round(sum(flux * area), 2) AS total FROM x WHERE n < 30 * (days // 30) GROUP BY 1",
    "posterior_totals": f"""WITH {_EMIS}, {_SPAN}, {_ROI}, {_LAB}, x AS (SELECT em.*, date_diff('day', d0, d) AS n, days FROM em, span),
 m AS (SELECT CAST(n // 30 + 1 AS INT) AS period_number, i, j, sector, avg(flux) AS flux, avg(area) AS area FROM x WHERE n < 30 * (days // 30) GROUP BY 1, 2, 3, 4),
 y AS (SELECT m.*, CASE WHEN sector = 'Soil' OR element IS NULL THEN 1.0 ELSE 0.75 + (element * 3 + period_number) % 5 * 0.125 - CASE WHEN element % 97 = period_number THEN 2.0 ELSE 0.0 END END AS sf
  FROM m LEFT JOIN lab ON m.i = lab.i AND m.j = lab.j WHERE (m.i, m.j) IN (SELECT (i, j) FROM roi))
SELECT period_number, round(sum(flux * area) * {_TG}, 5) AS prior, round(sum(flux * sf * area) * {_TG}, 5) AS posterior FROM y GROUP BY period_number""",
    "kalman_nudge": _NUDGE,
    "kalman_restart": _NUDGE,
    "superobs_overlap": f"""WITH {_OVERLAP} SELECT file_id, i, j, round(sum(w), 6) AS n, round(sum(w * xch4) / sum(w) + 1e-9, 4) AS xch4, round(sum(w * lon) / sum(w), 6) AS lon, round(sum(w * lat) / sum(w), 6) AS lat,
  CAST(round_even(floor(avg(floor(epoch(obs_time)))) / 3600.0, 0) AS BIGINT) AS hour FROM wt GROUP BY file_id, i, j""",
    "pixel_model": f"WITH {_OVERLAP} SELECT file_id, scanline, pixel, round(sum(w * (1900.0 + i % 5)) / sum(w), 6) AS ppb, count(*) AS n_cells FROM wt GROUP BY file_id, scanline, pixel",
    "model_at_hours": f"WITH {_CENTER} SELECT file_id, i, j, hour, round(xch4 + 1e-9, 4) AS xch4, round(CAST(1900.0 + i % 5 + (hour % 24) * 0.25 AS DOUBLE), 6) AS ppb FROM sup WHERE hour % 17 <> 0",
    "element_sensitivities": f"""WITH {_REMAP}, el AS (SELECT CAST(e AS INT) AS element, CASE WHEN e = 1 THEN 0.01 / 0.5 WHEN e < 6 THEN 0.01 * e / 10.0 ELSE (0.06 - 0.005) / 0.1 END AS f FROM (SELECT unnest(generate_series(1, 6)) AS e) g)
SELECT file_id, scanline, pixel, element, round(x * f + 1e-9, 4) AS bottom FROM av, el WHERE l = 0 AND x IS NOT NULL""",
    "column_xch4": f"""WITH {_REMAP}, lv AS (SELECT av.file_id, av.scanline, av.pixel, sum(c.prior[l + 1] + c.ak[l + 1] * (x * 1e-9 * c.subcol[l + 1] - c.prior[l + 1])) / sum(c.subcol[l + 1]) * 1e9 AS model, any_value(c.xch4) AS xch4, any_value(floor(epoch(c.obs_time) / 86400)) AS day
  FROM av JOIN cen c ON av.file_id = c.file_id AND av.scanline = c.scanline AND av.pixel = c.pixel GROUP BY 1, 2, 3)
SELECT CAST(day AS BIGINT) AS day, count(*) AS n, round(avg(model) + 1e-9, 4) AS model, round(avg(xch4) + 1e-9, 4) AS satellite FROM lv GROUP BY 1""",
    "prior_posterior_pairs": f"WITH {_CENTER} SELECT file_id, count(*) AS n, round(avg(xch4) + 1e-9, 4) AS prior, round(avg(xch4 * 0.99 + i * 0.5) + 1e-9, 4) AS posterior FROM sup WHERE contains(file_id, 'OFFL') GROUP BY file_id",
    "total_without_sink": f"WITH {_MEAN} SELECT i, j, round(sum(flux), 6) AS total, round(coalesce(sum(CASE WHEN sector <> 'Soil' THEN flux END), 0), 6) AS total_without_sink FROM mean GROUP BY i, j",
    "site_years": f"WITH {_READ}, y AS (SELECT site, CAST(year(time) AS INT) AS year, ppb, row_number() OVER (PARTITION BY site, year(time) ORDER BY time, row_id) AS k FROM rd WHERE ppb IS NOT NULL) SELECT site, year, count(*) AS n, round(avg(ppb) + 1e-9, 4) AS mean, round(max(CASE WHEN k = 1 THEN ppb END) + 1e-9, 4) AS first FROM y GROUP BY site, year",
    "grid_edges": """WITH a AS (SELECT DISTINCT 'lon' AS axis, lon AS mid FROM state_vector UNION SELECT DISTINCT 'lat', lat FROM state_vector)
SELECT axis, CAST(row_number() OVER (PARTITION BY axis ORDER BY mid) - 1 AS INT) AS k, mid, mid - CASE axis WHEN 'lon' THEN 0.15625 ELSE 0.125 END AS lower, mid + CASE axis WHEN 'lon' THEN 0.15625 ELSE 0.125 END AS upper FROM a""",
    "buffer_cells": "WITH c AS (SELECT i, j FROM state_vector WHERE element IS NOT NULL), k AS (SELECT * FROM c WHERE i BETWEEN 8 AND 17 AND j BETWEEN 10 AND 21) SELECT i, j FROM c WHERE (i, j) NOT IN (SELECT (i, j) FROM k) AND EXISTS (SELECT 1 FROM k WHERE abs(k.i - c.i) <= 3 AND abs(k.j - c.j) <= 3)",
    "plume_cells": f"""WITH {_POSITION}, r AS (SELECT plume_id, datasource, CASE WHEN emission_rate > 0 AND NOT isnan(emission_rate) THEN emission_rate END AS rate, coalesce({_RATE_OF.format("rate_unit")}, {_RATE_OF.format("remarks")}, {_RATE_OF.format("description")}) AS unit
  FROM plumes LEFT JOIN (SELECT source_name, description FROM sources WHERE feeds_table = 'plumes') s ON datasource = source_name WHERE coalesce(instrument, '') NOT IN ('GAO', 'ang', 'av3')),
 c AS (SELECT {_I} AS i, {_J} AS j, datasource, rate * CASE unit WHEN 'kg/h' THEN 1.0 WHEN 't/h' THEN 1e3 WHEN 'g/s' THEN 3.6 WHEN 'lb/h' THEN 0.45359237 WHEN 'kt/yr' THEN 1e6 / 8760.0 END AS kg, lon, lat FROM r JOIN pos USING (plume_id)),
 e AS (SELECT i, j, datasource, count(kg) AS detect, count(CASE WHEN kg IS NULL THEN 1 END) AS blank, avg(kg) AS rate FROM c WHERE abs(lon - (-108.0 + i * 0.3125)) < 0.5 AND abs(lat - (28.0 + j * 0.25)) < 0.5 GROUP BY i, j, datasource),
 b AS (SELECT i, j, CAST(sum(detect) AS BIGINT) AS detect, CAST(sum(blank) AS BIGINT) AS blank, avg(rate) AS rate FROM e GROUP BY i, j)
SELECT i, j, detect, blank, round(rate, 3) AS rate FROM b WHERE rate > 100 OR detect > 10""",
    "background_sites": f"""WITH {_READ}, f AS (SELECT site, dataset, time, p AS ppb, c AS ch4_ppb FROM ro WHERE contains(dataset, 'flask') AND p > 500 AND c > 500 AND obs_flag = 1),
 s AS (SELECT dataset, avg(ppb) AS mean, 3 * stddev_samp(ppb) AS sd3 FROM f GROUP BY dataset)
SELECT site, dataset, CAST(floor(epoch(time) / 86400) AS BIGINT) AS day, count(*) AS n, round(avg(ppb), 3) AS ppb, round(avg(ch4_ppb), 3) AS ch4_ppb FROM f JOIN s USING (dataset) WHERE abs(ppb - mean) <= sd3 GROUP BY 1, 2, 3""",
    "point_source_cells": f"WITH {_PT} SELECT i, j, count(*) AS n FROM ptc GROUP BY i, j",
    "dataset_sigma": f"WITH {_READ}, s AS (SELECT dataset, avg(ppb) AS mean, stddev_samp(ppb) AS sd FROM rd WHERE ppb IS NOT NULL GROUP BY dataset) SELECT dataset, round(any_value(mean) + 1e-9, 4) AS mean, round(any_value(sd) + 1e-9, 4) AS sd, count(*) AS n, count(CASE WHEN abs(ppb - mean) > 3 * sd THEN 1 END) AS beyond FROM rd JOIN s USING (dataset) WHERE ppb IS NOT NULL GROUP BY dataset",
    "site_daily_means": f"WITH {_READ} SELECT site, CAST(floor(epoch(time) / 86400) AS BIGINT) AS day, count(*) AS n, round(avg(ppb) + 1e-9, 4) AS ppb, round(avg(ch4_ppb) + 1e-9, 4) AS ch4_ppb FROM rd WHERE ppb IS NOT NULL AND ch4_ppb IS NOT NULL GROUP BY 1, 2",
    "latitude_bands": f"WITH {_READ} SELECT CAST(floor(latitude / 30) AS INT) AS band, count(*) AS n, count(DISTINCT site) AS sites, round(avg(ppb) + 1e-9, 4) AS ppb FROM rd WHERE ppb IS NOT NULL GROUP BY 1",
    "bias_stats": f"WITH {_READ}, x AS (SELECT dataset, ch4_ppb - ppb AS d, 1.0 + row_id % 3 AS w FROM rd WHERE ppb IS NOT NULL AND ch4_ppb IS NOT NULL) SELECT dataset, count(*) AS n, round(sum(w * d) / sum(w) + 1e-9, 4) AS bias, round(sqrt(sum(w * d * d) / sum(w)) + 1e-9, 4) AS rmse, round(stddev_pop(d) + 1e-9, 4) AS sd FROM x GROUP BY dataset",
    "moving_avg": f"WITH {_DAYS} SELECT site, day, round(avg(ppb) OVER (PARTITION BY site ORDER BY day ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) + 1e-9, 4) AS ppb FROM sd",
    "centered_30d": f"WITH {_DAYS} SELECT site, day, round(avg(ppb) OVER (PARTITION BY site ORDER BY day RANGE BETWEEN 14 PRECEDING AND 15 FOLLOWING) + 1e-9, 4) AS ppb FROM sd",
    "site_intersect": f"WITH {_READ} SELECT site FROM rd WHERE contains(dataset, 'insitu') INTERSECT SELECT site FROM rd WHERE contains(dataset, 'flask')",
    "model_obs_pairs": "WITH x AS (SELECT obspack_id, count(*) AS n, count(DISTINCT file_name) AS files, max(CASE WHEN isnan(ch4) OR ch4 = -9999 THEN NULL ELSE ch4 END) AS hi, min(CASE WHEN isnan(ch4) OR ch4 = -9999 THEN NULL ELSE ch4 END) AS lo FROM obspack GROUP BY obspack_id) SELECT n, files, count(*) AS readings, count(CASE WHEN hi = lo THEN 1 END) AS same FROM x WHERE n > 1 GROUP BY n, files",
    "tenth_degree_means": f"WITH {_TENTH} SELECT lon10, lat10, n, round(mean + 1e-9, 4) AS mean FROM tenth",
    "dense_grid_left": f"WITH {_TENTH}, g AS (SELECT CAST(a.x AS INT) AS lon10, CAST(b.x AS INT) AS lat10 FROM (SELECT unnest(generate_series(-1080, -1001)) AS x) a, (SELECT unnest(generate_series(280, 357)) AS x) b) SELECT lat10, count(*) AS cells, count(mean) AS filled, round(avg(mean) + 1e-9, 4) AS mean FROM g LEFT JOIN tenth USING (lon10, lat10) GROUP BY lat10",
    "conservative_regrid": f"""WITH {_TENTH}, b AS (SELECT mean, lon10 / 10.0 - 0.05 AS x0, lon10 / 10.0 + 0.05 AS x1, lat10 / 10.0 - 0.05 AS y0, lat10 / 10.0 + 0.05 AS y1 FROM tenth),
 x AS (SELECT *, unnest(generate_series(CAST(floor(x0 / 0.3125 + 1e-9) AS BIGINT), CAST(ceil(x1 / 0.3125 - 1e-9) AS BIGINT) - 1)) AS ci FROM b),
 y AS (SELECT *, unnest(generate_series(CAST(floor(y0 / 0.25 + 1e-9) AS BIGINT), CAST(ceil(y1 / 0.25 - 1e-9) AS BIGINT) - 1)) AS cj FROM x),
 w AS (SELECT ci, cj, mean, (least(x1, (ci + 1) * 0.3125) - greatest(x0, ci * 0.3125)) * (least(y1, (cj + 1) * 0.25) - greatest(y0, cj * 0.25)) AS w FROM y)
SELECT ci AS "I", cj AS "J", round(sum(w * mean) / sum(w) + 1e-9, 4) AS mean, count(*) AS n FROM w WHERE w > 1e-12 GROUP BY ci, cj""",
    "native_labels": "SELECT i, j, CAST(row_number() OVER (ORDER BY j DESC, i DESC) AS INT) AS element FROM state_vector WHERE is_roi",
    "strongest_labels": f"WITH {_SENS} SELECT element, count(*) AS cells, round(sum(a), 6) AS total FROM sens WHERE element IS NOT NULL GROUP BY element ORDER BY round(sum(a), 8) DESC, element LIMIT 40",
    "forced_native": f"WITH {_SENS}, {_PT} SELECT i, j, round(CASE WHEN (i, j) IN (SELECT (i, j) FROM ptc) THEN 1.1 ELSE a END, 6) AS a FROM sens",
    "element_runs": """SELECT DISTINCT element, CASE WHEN element > 466 THEN 'oh' WHEN element > 462 THEN 'boundary' ELSE 'emission' END AS kind,
  CAST(CASE WHEN element <= 462 THEN ceil(element / 5.0) ELSE 93 + element - 462 END AS INT) AS run, CAST(CASE WHEN element = 463 THEN 10 ELSE 0 END AS DOUBLE) AS north, CAST(CASE WHEN element = 466 THEN 10 ELSE 0 END AS DOUBLE) AS west
  FROM state_vector WHERE element IS NOT NULL""",
    "first_hour": "WITH r AS (SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour, user_id AS cell, sum(value) AS v FROM events GROUP BY 1, 2) SELECT hour % 24 AS h, count(*) AS n, round(sum(v), 3) AS v FROM r WHERE hour >= 19725 * 24 GROUP BY 1",
    "tracer_sensitivity": """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS k, unnest(generate_series(1, len(embedding))) AS e, CASE WHEN vec_id % 12 + 1 > 11 THEN 'oh' WHEN vec_id % 12 + 1 > 7 THEN 'boundary' ELSE 'emission' END AS kind FROM embeddings)
SELECT vec_id, kind, CAST(e - 1 AS INT) AS "at", round((k[e] * 1.5 + 0.25 - k[e]) / CASE kind WHEN 'oh' THEN 0.1 WHEN 'boundary' THEN 10.0 ELSE 0.5 END, 6) + 0.0 AS v FROM v""",
    "stream_windows": "SELECT CAST(floor(epoch(ts) / 604800) * 604800 AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2",
    "p4_found": f"""WITH {_FILE_UNITS},
 o AS (SELECT 'value' AS field, row_id, {_NEAREST.format("vm")} AS unit FROM obspack JOIN fu USING (file_name) WHERE {_USABLE} UNION ALL
  SELECT 'ch4', row_id, {_NEAREST.format("cm")} FROM obspack JOIN fu USING (file_name) WHERE ch4 IS NOT NULL),
 p AS (SELECT plume_id, coalesce({_RATE_OF.format("rate_unit")}, {_RATE_OF.format("remarks")}, {_RATE_OF.format("description")}) AS unit FROM plumes
  LEFT JOIN (SELECT source_name, description FROM sources WHERE feeds_table = 'plumes') s ON datasource = source_name WHERE emission_rate > 0 AND NOT isnan(emission_rate))
SELECT field, row_id, unit FROM o WHERE unit <> 'ppb' UNION ALL SELECT 'emission_rate', plume_id, unit FROM p WHERE unit <> 'kg/h'""",
    "p7_found": f"""WITH {_POSITION},
 src AS (SELECT source_id, lon AS a, lat AS b FROM point_sources WHERE lon IS NOT NULL AND lat IS NOT NULL AND NOT isnan(lon) AND NOT isnan(lat) AND lon <> -9999 AND lat <> -9999),
 ring AS (SELECT roi_id, string_split(unnest(regexp_extract_all(wkt, '[(]([^()]+)[)]', 1)), ',') AS pts FROM roi_polygons),
 pt AS (SELECT roi_id, pts, unnest(generate_series(1, len(pts) - 1)) AS k FROM ring),
 edge AS (SELECT roi_id, CAST(split_part(trim(pts[k]), ' ', 1) AS DOUBLE) AS x1, CAST(split_part(trim(pts[k]), ' ', 2) AS DOUBLE) AS y1, CAST(split_part(trim(pts[k + 1]), ' ', 1) AS DOUBLE) AS x2, CAST(split_part(trim(pts[k + 1]), ' ', 2) AS DOUBLE) AS y2 FROM pt)
SELECT DISTINCT 'near' AS kind, plume_id, source_id AS place_id FROM pos, src
  WHERE 2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians(b - lat) / 2), 2) + cos(radians(lat)) * cos(radians(b)) * pow(sin(radians(a - lon) / 2), 2)))) <= 2000
UNION ALL SELECT 'inside', plume_id, roi_id FROM pos, edge WHERE (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1 GROUP BY plume_id, roi_id HAVING count(*) % 2 = 1""",
    "filter_blended": "SELECT coalesce(surface_class, 5) AS surface, count(*) AS n, round(avg(xch4) + 1e-9, 4) AS xch4 FROM satellite_obs WHERE lon > -108.15625 AND lon < -100.03125 AND lat > 27.875 AND lat < 35.875 AND list_max(lon_b) - list_min(lon_b) < 100 AND xch4 IS NOT NULL AND NOT isnan(xch4) AND xch4 <> -9999 AND coalesce(surface_class & 3, 5) NOT IN (1, 3) AND NOT (coalesce(surface_class & 3, 5) = 2 AND scanline * 17 % 30000 > 20000) GROUP BY 1",
    "obs_in_mask": f"WITH {_OBS}, {_ROI}, c AS (SELECT {_I} AS i, {_J} AS j, count(*) AS n FROM obs GROUP BY 1, 2) SELECT element, n FROM c JOIN roi USING (i, j)",
    "grid_summary": "WITH l AS (SELECT lon - lag(lon) OVER (ORDER BY lon) AS step FROM (SELECT DISTINCT lon FROM state_vector) x) SELECT min(lon) AS lon0, max(lon) AS lon1, min(lat) AS lat0, max(lat) AS lat1, count(DISTINCT element) AS labels, (SELECT median(step) FROM l) AS step FROM state_vector",
    "domain_cells": f"WITH {_MEAN}, tg AS (SELECT i, j, sum(flux * area) * {_TG} AS tg FROM mean GROUP BY i, j) SELECT s.i, s.j, CAST(row_number() OVER (ORDER BY s.j, s.i) AS INT) AS element FROM state_vector s LEFT JOIN tg ON s.i = tg.i AND s.j = tg.j WHERE s.element IS NOT NULL OR coalesce(tg, 0) > 420.0",
    "trimmed_superobs": f"WITH {_CENTER} SELECT file_id, count(*) AS n, round(avg(xch4) + 1e-9, 4) AS xch4 FROM sup WHERE lon BETWEEN -106.75 AND -101.4375 AND lat BETWEEN 29.0 AND 34.75 GROUP BY file_id",
}
