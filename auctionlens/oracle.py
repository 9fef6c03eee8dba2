"""Independent ANSI SQL (DuckDB dialect) for every registered query.

The driver runs these against the raw testdata views. Each query starts
with ``FIXTURE_CTES``: the six ad-auction views written in SQL straight
from the fixture specification, not generated from the Spark code, so a
mistake in one engine is not copied to the other.
"""

from __future__ import annotations

import itertools

HINGE = "1998-07-01"

FIXTURE_CTES = f"""
WITH
buyers AS (
  SELECT s_suppkey AS buyer_id, s_name AS buyer_name,
         CASE WHEN s_suppkey % 8 IN (0, 1, 5) THEN 'viewable'
              WHEN s_suppkey % 8 IN (3, 6) THEN 'complete'
              ELSE 'render' END AS billing_type
  FROM supplier
),
publishers AS (
  SELECT n_nationkey AS publisher_id, n_name AS publisher_name,
         CASE WHEN n_nationkey % 3 = 2 THEN 'Tier-2' ELSE 'Tier-1' END AS tier,
         r_name AS region
  FROM nation JOIN region ON n_regionkey = r_regionkey
),
ad_requests AS (
  SELECT o_orderkey AS request_id,
         o_orderdate AS request_ts,
         c_nationkey AS publisher_id,
         CASE WHEN o_orderkey % 100 < (CASE WHEN o_orderdate >= TIMESTAMP '{HINGE}' THEN 60 ELSE 5 END)
              THEN '8.2.0' ELSE '8.1.0' END AS sdk_version,
         CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE') THEN 'iOS' ELSE 'Android' END AS os,
         CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE')
              THEN CASE o_custkey % 5 WHEN 0 THEN '16.4' WHEN 1 THEN '17.0' WHEN 2 THEN '17.1.2'
                                      WHEN 3 THEN '18.0' ELSE '18.1.1' END
              ELSE CASE o_custkey % 3 WHEN 0 THEN '13' WHEN 1 THEN '14' ELSE '15' END
         END AS os_version,
         CASE c_nationkey % 9 WHEN 0 THEN 'US' WHEN 1 THEN 'GB' WHEN 2 THEN 'DE' WHEN 3 THEN 'JP'
                              WHEN 4 THEN 'KR' WHEN 5 THEN 'IN' WHEN 6 THEN 'ID' WHEN 7 THEN 'BR' END AS country,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'rewarded_video' WHEN '5-LOW' THEN 'rewarded_video'
                              WHEN '2-HIGH' THEN 'interstitial' WHEN '3-MEDIUM' THEN 'banner'
                              WHEN '4-NOT SPECIFIED' THEN 'native' END AS ad_format,
         'app_' || CAST(o_custkey % 50 AS VARCHAR) AS app_id,
         CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE') THEN 'iPhone' ELSE 'Pixel' END AS device_model,
         'plc_' || CAST(o_custkey % 200 AS VARCHAR) AS placement_id
  FROM orders JOIN customer ON o_custkey = c_custkey
),
li AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_discount, l_extendedprice, l_quantity, l_tax,
         row_number() OVER (PARTITION BY l_orderkey
                            ORDER BY l_linenumber NULLS LAST, l_partkey NULLS LAST, l_suppkey NULLS LAST,
                                     l_extendedprice NULLS LAST, l_quantity NULLS LAST, l_discount NULLS LAST,
                                     l_tax NULLS LAST, l_shipdate NULLS LAST, l_returnflag NULLS LAST,
                                     l_linestatus NULLS LAST) AS rn
  FROM lineitem
),
b0 AS (
  SELECT l_orderkey * 100000 + rn AS bid_id, l_orderkey AS request_id, l_suppkey AS buyer_id,
         CASE WHEN l_tax < 0.07 THEN 1 ELSE 0 END AS did_bid,
         CASE WHEN l_tax < 0.07 THEN l_extendedprice / 10000.0 END AS bid_cpm,
         900 + 100 * (CAST(l_quantity AS INTEGER) % 12) AS bid_ttl_ms,
         l_discount, l_partkey, rn
  FROM li
),
b1 AS (
  SELECT *, CASE WHEN did_bid = 1 AND request_id % 10 <> 0
                  AND row_number() OVER (PARTITION BY request_id
                                         ORDER BY did_bid DESC, bid_cpm DESC NULLS LAST, rn) = 1
                 THEN 1 ELSE 0 END AS is_winner
  FROM b0
),
bids_x AS (
  SELECT bid_id, request_id, buyer_id, bid_cpm, did_bid, is_winner,
         CASE WHEN is_winner = 1 THEN bid_cpm * (1 - l_discount) END AS cleared_price,
         bid_ttl_ms, l_partkey
  FROM b1
),
bids AS (
  SELECT bid_id, request_id, buyer_id, bid_cpm, did_bid, is_winner, cleared_price, bid_ttl_ms FROM bids_x
),
imp0 AS (
  SELECT b.bid_id, b.request_id, b.bid_ttl_ms, b.cleared_price, b.l_partkey AS pk,
         r.request_ts, r.ad_format, y.billing_type,
         (r.sdk_version = '8.2.0' AND r.os = 'iOS' AND split_part(r.os_version, '.', 1) = '17'
          AND r.ad_format = 'rewarded_video') AS fault_a,
         (r.sdk_version = '8.2.0' AND r.os = 'iOS' AND r.ad_format = 'interstitial') AS fault_b
  FROM bids_x b
  JOIN ad_requests r ON r.request_id = b.request_id
  JOIN buyers y ON y.buyer_id = b.buyer_id
  WHERE b.is_winner = 1
),
imp1 AS (
  SELECT *,
         pk % 75 <> 0 AS rendered,
         CASE WHEN pk % 75 <> 0 THEN CAST(90 + (pk * 37) % 1000 + CASE WHEN fault_a THEN 1600 ELSE 0 END AS INTEGER) END AS lat,
         CASE WHEN (pk * 7) % 20 = 0 THEN NULL
              WHEN fault_b THEN (pk * 13) % 50 = 0
              ELSE (pk * 13) % 10 < 7 END AS viewable,
         CASE WHEN ad_format IN ('banner', 'native') THEN NULL ELSE (pk * 11) % 4 <> 0 END AS video_completed
  FROM imp0
),
imp2 AS (
  SELECT *,
         COALESCE(rendered AND lat <= bid_ttl_ms
                  AND COALESCE(CASE billing_type WHEN 'render' THEN TRUE
                                                 WHEN 'viewable' THEN viewable
                                                 WHEN 'complete' THEN video_completed END, FALSE),
                  FALSE) AS billable
  FROM imp1
),
impressions AS (
  SELECT bid_id AS impression_id, request_id, bid_id AS winning_bid_id,
         request_ts AS render_start_ts,
         CASE WHEN rendered THEN request_ts + to_milliseconds(lat) END AS render_complete_ts,
         lat AS render_latency_ms, rendered, viewable, video_completed, billable,
         CASE WHEN NOT billable THEN 0.0
              WHEN bid_id % 110 = 7 THEN NULL
              ELSE cleared_price / 1000.0 END AS revenue_usd
  FROM imp2
),
sdk_events AS (
  SELECT bid_id * 10 + 0 AS event_id, request_id, 'render_attempt' AS event_type,
         CAST(NULL AS VARCHAR) AS error_code, CAST(NULL AS INTEGER) AS latency_ms, request_ts AS event_ts
  FROM imp2
  UNION ALL
  SELECT bid_id * 10 + 1, request_id, 'render_error', 'RENDER_FAILED', NULL, request_ts
  FROM imp2 WHERE NOT rendered
  UNION ALL
  SELECT bid_id * 10 + 2, request_id, 'render_timeout', 'RENDER_TIMEOUT', lat, request_ts
  FROM imp2 WHERE rendered AND lat > bid_ttl_ms
  UNION ALL
  SELECT bid_id * 10 + 3, request_id, 'render_success', NULL, lat, request_ts
  FROM imp2 WHERE rendered AND NOT COALESCE(lat > bid_ttl_ms, FALSE)
  UNION ALL
  SELECT bid_id * 10 + 4, request_id, 'video_start', NULL, NULL, request_ts
  FROM imp2 WHERE rendered AND video_completed IS NOT NULL
  UNION ALL
  SELECT bid_id * 10 + 5, request_id, 'video_complete', NULL, NULL, request_ts
  FROM imp2 WHERE rendered AND video_completed
  UNION ALL
  SELECT bid_id * 10 + 6, request_id, 'measurement_error', 'OMID_NOT_REGISTERED', NULL, request_ts
  FROM imp2 WHERE rendered AND fault_b AND viewable IS NOT TRUE
)"""


def _q(body: str) -> str:
    """Fixture CTEs + ``body``: either more CTEs then a SELECT, or a bare SELECT."""
    body = body.strip()
    sep = "\n" if body.upper().startswith("SELECT") else ",\n"
    return FIXTURE_CTES + sep + body


QUERIES: dict[str, str] = {}


def r(expr: str, n: int) -> str:
    """``ROUND(expr::numeric, n)`` as double, half away from zero."""
    return f"CAST(ROUND(CAST({expr} AS DECIMAL(38,10)), {n}) AS DOUBLE)"


def div(num: str, den: str) -> str:
    """Double division with a NULL result on a zero denominator."""
    return f"(CAST({num} AS DOUBLE) / NULLIF(CAST({den} AS DOUBLE), 0))"


MONEY = "CAST(COALESCE({c}, 0) AS DECIMAL(28,12))"
REV = MONEY.format(c="i.revenue_usd")
POST = f"r.request_ts >= TIMESTAMP '{HINGE}'"

OSM = "split_part(r.os_version, '.', 1)"
ERA = f"CASE WHEN r.request_ts < TIMESTAMP '{HINGE}' THEN '1_pre' ELSE '2_post' END"
A_COHORT = f"r.os = 'iOS' AND {OSM} = '17' AND r.ad_format = 'rewarded_video'"
B_COHORT = "r.os = 'iOS' AND r.ad_format = 'interstitial'"


def cnt(pred: str) -> str:
    return f"COUNT(*) FILTER (WHERE {pred})"


def vrate(pred: str, version: str, col: str = "sdk_version") -> str:
    return div(cnt(f"{col} = '{version}' AND {pred}"), cnt(f"{col} = '{version}'"))


# One row per won impression, with the outcome derived from the billing rule
# (not read from the billable column). A02 - A07 and A09 tally this relation.
FACT = f"""
fact AS (
  SELECT q.sdk_version AS ver, q.os, regexp_extract(q.os_version, '^[^.]*') AS major, q.ad_format AS fmt, q.country,
         q.request_ts AS moment, q.request_ts >= TIMESTAMP '{HINGE}' AS late, w.buyer_id, w.bid_ttl_ms AS ttl,
         i.render_latency_ms AS lat, COALESCE(i.rendered, FALSE) AS drawn, COALESCE(i.viewable, FALSE) AS seen,
         COALESCE(i.video_completed, FALSE) AS finished, y.billing_type AS pays_on,
         COALESCE(i.rendered AND i.render_latency_ms <= w.bid_ttl_ms
                  AND CASE y.billing_type WHEN 'render' THEN TRUE WHEN 'viewable' THEN i.viewable
                                          WHEN 'complete' THEN i.video_completed END, FALSE) AS paid,
         CAST(COALESCE(i.revenue_usd, 0) AS DECIMAL(28,12)) AS usd
  FROM ad_requests q, impressions i, bids w, buyers y
  WHERE i.request_id = q.request_id AND w.bid_id = i.winning_bid_id AND y.buyer_id = w.buyer_id
)"""
LATE = "drawn AND late"
IOS17_REWARDED = f"{LATE} AND (os, major, fmt) = ('iOS', '17', 'rewarded_video')"
IOS_INTERSTITIAL = f"{LATE} AND (os, fmt) = ('iOS', 'interstitial')"


def per_version(keys: str, where: str, more: str = "") -> str:
    """Tallies (n impressions, k paid) for each version and ``keys``."""
    return f"SELECT {keys}, ver, COUNT(*) AS n, SUM(paid::INT) AS k{more} FROM fact WHERE {where} GROUP BY ALL"


def big(expr: str) -> str:
    return f"CAST(COALESCE({expr}, 0) AS BIGINT)"


# One tally row per era, the later one joined to the earlier one
QUERIES["ecpm_decomposition"] = _q(f"""{FACT},
tally AS (SELECT late, SUM(drawn::INT) AS shown, SUM(paid::INT) AS paid, SUM(usd) AS usd FROM fact GROUP BY late),
m AS (SELECT late, {div("paid", "shown")} AS br, {div("usd", "paid")} * 1000 AS price, {div("usd", "shown")} * 1000 AS ecpm FROM tally)
SELECT IF(x.late, '2_post', '1_pre') AS era, {r("x.br", 3)} AS billable_rate, {r("x.price", 3)} AS price_cpm, {r("x.ecpm", 3)} AS ecpm,
       {r("100.0 * (x.br - o.br) / NULLIF(o.br, 0)", 1)} AS billable_rate_pct_chg,
       {r("100.0 * (x.price - o.price) / NULLIF(o.price, 0)", 1)} AS price_pct_chg,
       {r("100.0 * (x.ecpm - o.ecpm) / NULLIF(o.ecpm, 0)", 1)} AS ecpm_pct_chg
FROM m x LEFT JOIN m o ON x.late AND NOT o.late
""")

# Tallies per country, rolled up to scopes. The partition mode gives each
# country to one scope, the overlap mode gives US to both.
def _geo_sql(scopes: str) -> str:
    return _q(f"""{FACT},
land AS (SELECT country, late, COUNT(*) AS n, SUM(paid::INT) AS paid, SUM(usd) AS usd FROM fact WHERE country <> '' GROUP BY ALL),
scopes(scope, code) AS ({scopes})
SELECT scope, IF(late, '2_post', '1_pre') AS era, {r(div("SUM(usd)", "SUM(paid)") + " * 1000", 3)} AS price_cpm,
       {r(div("SUM(CASE country WHEN 'IN' THEN n WHEN 'ID' THEN n WHEN 'BR' THEN n ELSE 0 END)", "SUM(n)"), 3)} AS low_ecpm_geo_share
FROM land JOIN scopes ON country = code GROUP BY scope, late
""")


_US, _ALL = "'US only (geo held constant)'", "'All geos (blended)'"
QUERIES["geo_mix_control"] = _geo_sql(f"SELECT DISTINCT IF(country = 'US', {_US}, {_ALL}), country FROM land")
QUERIES["geo_mix_control_overlap"] = _geo_sql(f"SELECT DISTINCT {_ALL}, country FROM land UNION ALL SELECT {_US}, 'US'")

# The two versions' tallies joined on the cohort; a rank is one more than
# the number of cohorts that are worse
QUERIES["cohort_version_compare"] = _q(f"""{FACT},
side AS ({per_version("os, major, fmt", LATE)}),
pair AS (
  SELECT o.os, o.major, o.fmt, o.n AS nb, c.n AS nc, {div("o.k", "o.n")} AS rb, {div("c.k", "c.n")} AS rc
  FROM (FROM side WHERE ver = '8.1.0' AND n >= 15) o JOIN (FROM side WHERE ver = '8.2.0' AND n >= 15) c
    ON (o.os, o.major, o.fmt) IS NOT DISTINCT FROM (c.os, c.major, c.fmt)
)
SELECT os, major AS os_major, fmt AS ad_format, nb AS n_base, nc AS n_cand, {r("rb", 3)} AS br_base, {r("rc", 3)} AS br_cand,
       {r("rc - rb", 3)} AS delta, (SELECT 1 + COUNT(*) FROM pair z WHERE z.rc - z.rb < pair.rc - pair.rb) AS worst_rank
FROM pair
ORDER BY delta NULLS LAST, worst_rank, os_major NULLS LAST, ad_format NULLS LAST, os NULLS LAST
LIMIT 12
""")

# Tallies per country and version, rolled up to bands
QUERIES["stratified_compare"] = _q(f"""{FACT},
side AS ({per_version("country", IOS17_REWARDED + " AND country <> ''")}),
band(country, geo_band) AS (SELECT DISTINCT country, IF(list_contains(['IN', 'ID', 'BR'], country), 'low_ecpm_geo', 'high_ecpm_geo') FROM side)
SELECT geo_band, {big("SUM(n) FILTER (ver = '8.1.0')")} AS n_base, {big("SUM(n) FILTER (ver = '8.2.0')")} AS n_cand,
       {r(div("SUM(k) FILTER (ver = '8.1.0')", "SUM(n) FILTER (ver = '8.1.0')"), 3)} AS br_base,
       {r(div("SUM(k) FILTER (ver = '8.2.0')", "SUM(n) FILTER (ver = '8.2.0')"), 3)} AS br_cand
FROM side JOIN band USING (country) GROUP BY geo_band
""")

# Order statistics read from the sorted list of latencies
LATENCIES = f"""{FACT},
v AS (
  SELECT ver, COUNT(*) AS n, list_sort(list(lat) FILTER (lat IS NOT NULL)) AS s, AVG(ttl) AS ttl, SUM((lat > ttl)::INT) AS over
  FROM fact WHERE {IOS17_REWARDED} GROUP BY ver
)"""


def between(p: float) -> str:
    """Interpolated order statistic of the sorted list ``s``."""
    at = f"((len(s) - 1) * {p})"
    lo = f"s[CAST(floor({at}) AS BIGINT) + 1]"
    hi = f"s[CAST(ceil({at}) AS BIGINT) + 1]"
    return f"({lo} + ({at} - floor({at})) * ({hi} - {lo}))"


def _latency_sql(p50: str, p95: str) -> str:
    return _q(f"""{LATENCIES}
SELECT ver AS sdk_version, n, {r(p50, 0)} AS p50, {r(p95, 0)} AS p95, {r("ttl", 0)} AS avg_ttl, {r(div("over", "n"), 3)} AS expired_share FROM v
""")


QUERIES["latency_vs_ttl"] = _latency_sql(between(0.5), between(0.95))
# the sketch is exact while a version has fewer rows than its accuracy (10,000)
QUERIES["latency_vs_ttl_approx"] = _latency_sql("s[CAST(ceil(len(s) * 0.5) AS BIGINT)]", "s[CAST(ceil(len(s) * 0.95) AS BIGINT)]")

# Tallies per buyer, then by what the buyer pays on
QUERIES["billing_type_split"] = _q(f"""{FACT},
side AS ({per_version("buyer_id", IOS_INTERSTITIAL, ", SUM(seen::INT) AS v")}),
wide AS (
  SELECT billing_type, SUM(n) FILTER (ver = '8.1.0') AS nb, SUM(k) FILTER (ver = '8.1.0') AS kb,
         SUM(n) FILTER (ver = '8.2.0') AS nc, SUM(k) FILTER (ver = '8.2.0') AS kc, SUM(v) FILTER (ver = '8.2.0') AS vc
  FROM buyers JOIN side USING (buyer_id) GROUP BY billing_type
)
SELECT billing_type, {big("nb")} AS n_base, {big("nc")} AS n_cand, {r(div("kb", "nb"), 3)} AS br_base,
       {r(div("kc", "nc"), 3)} AS br_cand, {r(div("vc", "nc"), 3)} AS viewable_rate_cand
FROM wide
""")

# signal_behavior: viewable, completion and billable rate of both versions
def _by_version(col: str) -> str:
    return ", ".join(f"{r(div(f'SUM({col}) FILTER (ver = {v!r})', f'SUM(n) FILTER (ver = {v!r})'), 4)}" f" AS {name}_{side}" for name in [{"v": "viewable_rate", "f": "completed_rate", "k": "billable_rate"}[col]] for v, side in (("8.1.0", "base"), ("8.2.0", "cand")))


QUERIES["signal_behavior"] = _q(f"""{FACT},
side AS ({per_version("pays_on", IOS_INTERSTITIAL, ", SUM(seen::INT) AS v, SUM(finished::INT) AS f")})
SELECT pays_on AS billing_type, {big("SUM(n) FILTER (ver = '8.1.0')")} AS n_base, {big("SUM(n) FILTER (ver = '8.2.0')")} AS n_cand,
       {_by_version("v")}, {_by_version("f")}, {_by_version("k")}
FROM side GROUP BY pays_on
""")

ERROR_COHORT = (
    f"CASE WHEN r.ad_format = 'rewarded_video' AND {OSM} = '17' THEN 'iOS17_rewarded_video' "
    "WHEN r.ad_format = 'interstitial' THEN 'iOS_interstitial' ELSE 'other_iOS' END"
)

# Codes counted per request, requests listed per cohort
QUERIES["error_trail"] = _q(f"""
codes AS (SELECT request_id, error_code, COUNT(*) AS c FROM sdk_events WHERE error_code IS NOT NULL GROUP BY ALL),
late_ios AS (
  SELECT request_id, ad_format, starts_with(os_version || '.', '17.') AS is17 FROM ad_requests
  WHERE os = 'iOS' AND sdk_version = '8.2.0' AND request_ts >= TIMESTAMP '{HINGE}'
),
member AS (
  SELECT request_id, 'iOS17_rewarded_video' AS cohort FROM late_ios WHERE is17 AND ad_format = 'rewarded_video'
  UNION ALL SELECT request_id, 'iOS_interstitial' FROM late_ios WHERE ad_format = 'interstitial'
  UNION ALL SELECT request_id, 'other_iOS' FROM late_ios
  WHERE ad_format NOT IN ('interstitial', 'rewarded_video') OR ad_format IS NULL OR (ad_format = 'rewarded_video' AND is17 IS NOT TRUE)
)
SELECT cohort, error_code, CAST(SUM(c) AS BIGINT) AS n FROM codes NATURAL JOIN member GROUP BY cohort, error_code
""")

# Both versions' tallies apart, joined on the cohort
IMPACT_AGG = f"""{FACT},
member AS (
  SELECT 'A: iOS17 rewarded_video (latency/TTL)' AS cohort, ver, moment, paid, usd FROM fact WHERE {IOS17_REWARDED}
  UNION ALL
  SELECT 'B: iOS interstitial, viewable buyers (OMID)', ver, moment, paid, usd FROM fact WHERE {IOS_INTERSTITIAL} AND pays_on = 'viewable'
),
old AS (SELECT cohort, COUNT(*) AS n, SUM(paid::INT) AS k, SUM(usd) FILTER (paid) AS usd FROM member WHERE ver = '8.1.0' GROUP BY cohort),
new AS (SELECT cohort, COUNT(*) AS n, SUM(paid::INT) AS k, COUNT(DISTINCT moment::DATE) AS days FROM member WHERE ver = '8.2.0' GROUP BY cohort),
agg AS (
  SELECT cohort, {big("new.n")} AS rendered_cand, {big("new.k")} AS billable_cand, {div("old.k", "old.n")} AS baseline_br,
         {div("old.usd", "old.k")} AS price_base, {big("new.days")} AS active_days
  FROM old FULL JOIN new USING (cohort)
)"""
# counterfactual_vs_control: the candidate version on Android as the baseline
QUERIES["counterfactual_vs_control"] = _q(f"""{FACT},
side AS (
  SELECT os, fmt, pays_on, COUNT(*) AS n, SUM(paid::INT) AS k, SUM(usd) FILTER (paid) AS usd
  FROM fact WHERE {LATE} AND ver = '8.2.0' GROUP BY ALL
),
x AS (
  SELECT fmt, pays_on, t.n, t.k, COALESCE(c.n, 0) AS nc, {div("c.k", "c.n")} AS rate, {div("c.usd", "c.k")} AS price
  FROM (FROM side WHERE os = 'iOS') t LEFT JOIN (FROM side WHERE os = 'Android') c USING (fmt, pays_on)
)
SELECT fmt AS ad_format, pays_on AS billing_type, n AS rendered_cand, CAST(k AS BIGINT) AS billable_cand, nc AS rendered_control,
       {r("rate", 4)} AS control_br, {r("GREATEST(0.0, rate * n - k)", 2)} AS lost_billable_imps,
       {r("GREATEST(0.0, rate * n - k) * price", 4)} AS lost_revenue_usd
FROM x
""")
LOST = "(baseline_br * rendered_cand - billable_cand)"
QUERIES["counterfactual_impact"] = _q(f"""{IMPACT_AGG}
SELECT cohort, rendered_cand, billable_cand, {r("baseline_br", 3)} AS baseline_br,
       CAST(GREATEST(0, {r(LOST, 0)}) AS BIGINT) AS lost_billable_imps,
       {r(f"GREATEST(0, {LOST}) * price_base", 4)} AS lost_revenue_usd
FROM agg ORDER BY cohort
""")
QUERIES["relative_loss"] = _q(f"""{IMPACT_AGG}
SELECT cohort, rendered_cand, billable_cand,
       {r("baseline_br * rendered_cand", 2)} AS expected_billable,
       {r(f"GREATEST(0, {LOST}) / NULLIF(baseline_br * rendered_cand, 0)", 4)} AS relative_loss,
       {r(f"GREATEST(0, {LOST}) * price_base", 4)} AS lost_revenue_usd,
       {r(div(f"GREATEST(0, {LOST}) * price_base", "rendered_cand"), 6)} AS lost_usd_per_rendered
FROM agg
""")
QUERIES["exposure"] = _q(f"""{IMPACT_AGG}
SELECT cohort, CAST(active_days AS BIGINT) AS active_days,
       {r(div("rendered_cand", "active_days"), 2)} AS imps_per_day,
       {r(div(f"GREATEST(0, {LOST}) * price_base", "rendered_cand"), 6)} AS lost_usd_per_rendered,
       CAST(30 AS BIGINT) AS days,
       {r(div("rendered_cand", "active_days") + " * " + div(f"GREATEST(0, {LOST}) * price_base", "rendered_cand") + " * 30.0", 4)} AS exposure_usd
FROM agg
""")

# A10 load_verification: each derived table against the source it came from
QUERIES["load_verification"] = _q("""
counts AS (
  SELECT 'ad_requests' AS t, (SELECT COUNT(*) FROM ad_requests) AS n, (SELECT COUNT(*) FROM orders) AS expected
  UNION ALL SELECT 'bids', (SELECT COUNT(*) FROM bids), (SELECT COUNT(*) FROM lineitem)
  UNION ALL SELECT 'impressions', (SELECT COUNT(*) FROM impressions), CAST(NULL AS BIGINT)
  UNION ALL SELECT 'sdk_events', (SELECT COUNT(*) FROM sdk_events), CAST(NULL AS BIGINT)
  UNION ALL SELECT 'buyers', (SELECT COUNT(*) FROM buyers), (SELECT COUNT(*) FROM supplier)
  UNION ALL SELECT 'publishers', (SELECT COUNT(*) FROM publishers), (SELECT COUNT(*) FROM nation)
)
SELECT t, CAST(n AS BIGINT) AS n, CAST(expected AS DOUBLE) AS expected, n = expected AS ok FROM counts
""")

# D01 cohort_pre_post
QUERIES["cohort_pre_post"] = _q(f"""
x AS (
  SELECT r.sdk_version, r.os, r.os_version, r.ad_format, {ERA} AS era, i.billable
  FROM impressions i JOIN ad_requests r USING (request_id)
  WHERE i.rendered
),
c AS (
  SELECT sdk_version, os, os_version, ad_format,
         {cnt("era = '1_pre'")} AS n_pre, {cnt("era = '2_post'")} AS n_post,
         {vrate("billable", "1_pre", "era")} AS br_pre, {vrate("billable", "2_post", "era")} AS br_post
  FROM x GROUP BY sdk_version, os, os_version, ad_format
)
SELECT sdk_version, os, os_version, ad_format, n_pre, n_post,
       {r("br_pre", 3)} AS br_pre, {r("br_post", 3)} AS br_post, {r("br_post - br_pre", 3)} AS delta,
       CAST(RANK() OVER (ORDER BY br_post - br_pre ASC NULLS LAST) AS BIGINT) AS decline_rank
FROM c
""")

# D02 ecpm_attribution
PERIOD = f"""{FACT},
tally AS (SELECT late, SUM(drawn::INT) AS shown, SUM(paid::INT) AS paid, SUM(usd) AS usd FROM fact GROUP BY late),
period AS (
  SELECT IF(late, '2_post', '1_pre') AS era, {div("paid", "shown")} AS billable_rate, {div("usd", "paid")} * 1000 AS price_cpm,
         {div("usd", "shown")} * 1000 AS ecpm
  FROM tally
)"""
QUERIES["ecpm_attribution"] = _q(f"""{PERIOD},
p AS (
  SELECT MAX(CASE WHEN era = '1_pre' THEN billable_rate END) AS br0, MAX(CASE WHEN era = '2_post' THEN billable_rate END) AS br1,
         MAX(CASE WHEN era = '1_pre' THEN price_cpm END) AS p0, MAX(CASE WHEN era = '2_post' THEN price_cpm END) AS p1,
         MAX(CASE WHEN era = '1_pre' THEN ecpm END) AS e0, MAX(CASE WHEN era = '2_post' THEN ecpm END) AS e1
  FROM period
)
SELECT {r("br0", 4)} AS br_pre, {r("br1", 4)} AS br_post, {r("p0", 4)} AS price_pre, {r("p1", 4)} AS price_post,
       {r("e0", 4)} AS ecpm_pre, {r("e1", 4)} AS ecpm_post, {r("ln(e1 / e0)", 4)} AS ecpm_log_change,
       {r("ln(br1 / br0) / NULLIF(ln(e1 / e0), 0)", 4)} AS billable_share,
       {r("ln(p1 / p0) / NULLIF(ln(e1 / e0), 0)", 4)} AS price_share
FROM p
""")

# D03 mix_standardized over country x os x ad_format strata
QUERIES["mix_standardized"] = _q(f"""
x AS (
  SELECT r.country, r.os, r.ad_format, {ERA} AS era, i.rendered, i.billable, {REV} AS rev
  FROM impressions i JOIN ad_requests r USING (request_id)
),
s AS (
  SELECT country, os, ad_format,
         {cnt("era = '1_pre' AND rendered")} AS n0, {cnt("era = '2_post' AND rendered")} AS n1,
         {cnt("era = '1_pre' AND rendered AND billable")} AS b0, {cnt("era = '2_post' AND rendered AND billable")} AS b1,
         CAST(SUM(CASE WHEN era = '1_pre' THEN rev END) AS DOUBLE) AS v0,
         CAST(SUM(CASE WHEN era = '2_post' THEN rev END) AS DOUBLE) AS v1
  FROM x GROUP BY country, os, ad_format
),
m AS (
  SELECT n0, n1, {div("v0", "n0")} * 1000 AS e0, {div("v1", "n1")} * 1000 AS e1, {div("b0", "n0")} AS q0, {div("b1", "n1")} AS q1
  FROM s
),
f AS (
  SELECT n0, n1, COALESCE(e0, e1, 0.0) AS e0f, COALESCE(e1, e0, 0.0) AS e1f,
         COALESCE(q0, q1, 0.0) AS q0f, COALESCE(q1, q0, 0.0) AS q1f
  FROM m
),
g AS (
  SELECT CAST(SUM(n0) AS DOUBLE) AS N0, CAST(SUM(n1) AS DOUBLE) AS N1,
         SUM(n0 * e0f) AS ea, SUM(n1 * e1f) AS eb, SUM(n0 * e1f) AS ec,
         SUM(n0 * q0f) AS qa, SUM(n1 * q1f) AS qb, SUM(n0 * q1f) AS qc
  FROM f
)
SELECT 'ecpm' AS metric, {r("ea / N0", 4)} AS total_pre, {r("eb / N1", 4)} AS total_post, {r("eb / N1 - ea / N0", 4)} AS total_change,
       {r("ec / N0 - ea / N0", 4)} AS within, {r("eb / N1 - ec / N0", 4)} AS mix
FROM g
UNION ALL
SELECT 'billable_rate', {r("qa / N0", 4)}, {r("qb / N1", 4)}, {r("qb / N1 - qa / N0", 4)}, {r("qc / N0 - qa / N0", 4)}, {r("qb / N1 - qc / N0", 4)}
FROM g
""")

SIGNAL = (
    "COALESCE(CASE y.billing_type WHEN 'render' THEN TRUE WHEN 'viewable' THEN i.viewable "
    "WHEN 'complete' THEN i.video_completed END, FALSE)"
)

# D04 leak_stage (left joins keep every impression)
QUERIES["leak_stage"] = _q(f"""
x AS (
  SELECT {ERA} AS era, r.sdk_version, r.os, r.ad_format,
         CASE WHEN NOT COALESCE(i.rendered, FALSE) THEN 'not_rendered'
              WHEN i.render_latency_ms > b.bid_ttl_ms THEN 'expired'
              WHEN NOT {SIGNAL} THEN 'signal_missing'
              WHEN COALESCE(i.billable, FALSE) THEN 'billed'
              ELSE 'unexplained' END AS stage
  FROM impressions i
  LEFT JOIN ad_requests r USING (request_id)
  LEFT JOIN bids b ON i.winning_bid_id = b.bid_id
  LEFT JOIN buyers y ON b.buyer_id = y.buyer_id
),
c AS (SELECT era, sdk_version, os, ad_format, stage, COUNT(*) AS n FROM x GROUP BY ALL)
SELECT era, sdk_version, os, ad_format, stage, n,
       {r(div("n", "SUM(n) OVER (PARTITION BY era, sdk_version, os, ad_format)"), 4)} AS share
FROM c
""")

# D05 control_diff (difference in differences, iOS treated vs Android control)
def _cell(os_: str, v: str) -> str:
    return f"os = '{os_}' AND sdk_version = '{v}'"


DID = "((br_treated_cand - br_treated_base) - (br_control_cand - br_control_base))"
QUERIES["control_diff"] = _q(f"""
x AS (
  SELECT r.ad_format, r.os, r.sdk_version, i.billable
  FROM impressions i JOIN ad_requests r USING (request_id)
  WHERE i.rendered AND {POST} AND r.os IN ('iOS', 'Android')
),
c AS (
  SELECT ad_format,
         {cnt(_cell("iOS", "8.1.0"))} AS n_treated_base, {cnt(_cell("iOS", "8.2.0"))} AS n_treated_cand,
         {cnt(_cell("Android", "8.1.0"))} AS n_control_base, {cnt(_cell("Android", "8.2.0"))} AS n_control_cand,
         {div(cnt(_cell("iOS", "8.1.0") + " AND billable"), cnt(_cell("iOS", "8.1.0")))} AS br_treated_base,
         {div(cnt(_cell("iOS", "8.2.0") + " AND billable"), cnt(_cell("iOS", "8.2.0")))} AS br_treated_cand,
         {div(cnt(_cell("Android", "8.1.0") + " AND billable"), cnt(_cell("Android", "8.1.0")))} AS br_control_base,
         {div(cnt(_cell("Android", "8.2.0") + " AND billable"), cnt(_cell("Android", "8.2.0")))} AS br_control_cand
  FROM x GROUP BY ad_format
)
SELECT ad_format, n_treated_base, n_treated_cand, n_control_base, n_control_cand,
       {r("br_treated_base", 3)} AS br_treated_base, {r("br_treated_cand", 3)} AS br_treated_cand,
       {r("br_control_base", 3)} AS br_control_base, {r("br_control_cand", 3)} AS br_control_cand,
       {r("br_treated_cand - br_treated_base", 3)} AS diff_treated,
       {r("br_control_cand - br_control_base", 3)} AS diff_control,
       {r(DID, 3)} AS did,
       CAST(RANK() OVER (ORDER BY {DID} ASC NULLS LAST) AS BIGINT) AS did_rank
FROM c
""")


def _daily_ctes(requests: str = "ad_requests") -> str:
    """Daily rates over a request relation: each request with its own bids and
    impressions first, then one row per day of the spine of request days."""
    return f"""
per_request AS (
  SELECT CAST(q.request_ts AS DATE) AS d, a.offers, a.answers, a.wins, s.shown, s.drawn, s.paid, s.usd
  FROM {requests} q
  LEFT JOIN (SELECT request_id, COUNT(*) AS offers, SUM((did_bid = 1)::INT) AS answers, SUM((is_winner = 1)::INT) AS wins
             FROM bids GROUP BY request_id) a ON a.request_id = q.request_id
  LEFT JOIN (SELECT request_id, COUNT(*) AS shown, SUM(rendered::INT) AS drawn, SUM((rendered AND billable)::INT) AS paid,
                    SUM(CAST(COALESCE(revenue_usd, 0) AS DECIMAL(28,12))) AS usd
             FROM impressions GROUP BY request_id) s ON s.request_id = q.request_id
),
daily AS (
  SELECT d, {div("SUM(answers)", "SUM(offers)")} AS bid_rate, {div("SUM((wins > 0)::INT)", "COUNT(*)")} AS win_rate,
         {div("SUM(drawn)", "SUM(shown)")} AS render_rate, {div("SUM(paid)", "SUM(drawn)")} AS billable_rate,
         {div("SUM(usd)", "SUM(drawn)")} * 1000 AS ecpm
  FROM per_request GROUP BY d HAVING SUM(offers) > 0 AND SUM(shown) > 0
),
numbered AS (SELECT *, row_number() OVER (ORDER BY d) AS i FROM daily),
smooth AS (
  SELECT x.d, AVG(y.ecpm) AS ma FROM numbered x JOIN numbered y ON y.i BETWEEN x.i - 6 AND x.i GROUP BY x.d
)"""


# A01 funnel_daily; the trailing mean is a self-join over seven rows
QUERIES["funnel_daily"] = _q(f"""{_daily_ctes()}
SELECT CAST(d AS TIMESTAMP) AS d, {r("bid_rate", 3)} AS bid_rate, {r("win_rate", 3)} AS win_rate,
       {r("render_rate", 3)} AS render_rate, {r("billable_rate", 3)} AS billable_rate, {r("ecpm", 3)} AS ecpm, {r("ma", 3)} AS ecpm_7d_avg
FROM daily JOIN smooth USING (d)
""")

# D06 decline_onset: 7-row MA below 90% of the pre-hinge daily mean for 7 rows
QUERIES["decline_onset"] = _q(f"""{_daily_ctes()},
d2 AS (
  SELECT d, ma, (SELECT AVG(ecpm) FROM daily WHERE d < DATE '{HINGE}') AS baseline FROM smooth
),
d3 AS (SELECT *, CASE WHEN ma < 0.9 * baseline THEN 1 ELSE 0 END AS below FROM d2),
d4 AS (
  SELECT *, MIN(below) OVER (ORDER BY d ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING) AS run_min,
         COUNT(*) OVER (ORDER BY d ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING) AS run_len
  FROM d3
)
SELECT {r("MAX(baseline)", 4)} AS baseline_ecpm, {r("MAX(baseline) * 0.9", 4)} AS threshold_ecpm,
       CAST(MIN(CASE WHEN run_min = 1 AND run_len = 7 AND d >= DATE '{HINGE}' THEN d END) AS TIMESTAMP) AS onset_day,
       CAST(date_diff('day', DATE '{HINGE}', MIN(CASE WHEN run_min = 1 AND run_len = 7 AND d >= DATE '{HINGE}' THEN d END)) AS BIGINT) AS days_after_hinge
FROM d4
""")

# D07 rollout_adoption
QUERIES["rollout_adoption"] = _q(f"""
daily AS (
  SELECT os, CAST(request_ts AS DATE) AS d, COUNT(*) AS n_requests, {cnt("sdk_version = '8.2.0'")} AS n_cand
  FROM ad_requests GROUP BY 1, 2
)
SELECT os, CAST(d AS TIMESTAMP) AS d, n_requests, n_cand, {r(div("n_cand", "n_requests"), 4)} AS cand_share,
       {r(div("SUM(n_cand) OVER w", "SUM(n_requests) OVER w"), 4)} AS cum_cand_share
FROM daily
WINDOW w AS (PARTITION BY os ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
""")

# D08 error_rate_vs_control
QUERIES["error_rate_vs_control"] = _q(f"""
req AS (
  SELECT r.request_id, r.sdk_version, {ERROR_COHORT} AS cohort
  FROM ad_requests r
  WHERE r.os = 'iOS' AND r.sdk_version IN ('8.1.0', '8.2.0') AND {POST}
),
errs AS (
  SELECT q.cohort, e.error_code, {cnt("q.sdk_version = '8.1.0'")} AS n_base, {cnt("q.sdk_version = '8.2.0'")} AS n_cand
  FROM sdk_events e JOIN req q USING (request_id)
  WHERE e.error_code IS NOT NULL GROUP BY 1, 2
),
imps AS (
  SELECT q.cohort, {cnt("q.sdk_version = '8.1.0'")} AS imps_base, {cnt("q.sdk_version = '8.2.0'")} AS imps_cand
  FROM impressions i JOIN req q USING (request_id) GROUP BY 1
)
SELECT e.cohort, e.error_code, e.n_base, e.n_cand, COALESCE(m.imps_base, 0) AS imps_base, COALESCE(m.imps_cand, 0) AS imps_cand,
       {r(div("e.n_base", "m.imps_base") + " * 1000", 3)} AS per_1000_base,
       {r(div("e.n_cand", "m.imps_cand") + " * 1000", 3)} AS per_1000_cand
FROM errs e LEFT JOIN imps m ON e.cohort = m.cohort
""")

# D11 guardrail: 90-day windows (testdata is sparse in time), min_n 10, tol 0.3,
# pooled two-proportion z-score of the drop.
def guard_sql(keys: tuple[str, ...] = ("os_version", "ad_format")) -> str:
    cols = ", ".join(keys)
    sel = ", ".join(f"y.{k}" if k == "billing_type" else f"r.{k}" for k in keys)
    buyer = ""
    if "billing_type" in keys:
        buyer = "JOIN bids b ON i.winning_bid_id = b.bid_id JOIN buyers y ON b.buyer_id = y.buyer_id"
    pooled = div("b_base + b_cand", "n_base + n_cand")
    se = f"sqrt({pooled} * (1.0 - {pooled}) * ({div('1.0', 'n_base')} + {div('1.0', 'n_cand')}))"
    z = f"({div('b_base', 'n_base')} - {div('b_cand', 'n_cand')}) / NULLIF({se}, 0)"
    return f"""
x AS (
  SELECT r.request_ts AS ts, r.sdk_version, {sel}, i.billable
  FROM impressions i JOIN ad_requests r USING (request_id) {buyer}
),
g AS (
  SELECT time_bucket(INTERVAL '90 days', ts, TIMESTAMP '1970-01-01') AS window_start, {cols},
         {cnt("sdk_version = '8.1.0'")} AS n_base, {cnt("sdk_version = '8.2.0'")} AS n_cand,
         {cnt("sdk_version = '8.1.0' AND billable")} AS b_base, {cnt("sdk_version = '8.2.0' AND billable")} AS b_cand
  FROM x GROUP BY ALL
),
w AS (
  SELECT window_start, window_start + INTERVAL '90 days' AS window_end, {cols}, n_base, n_cand,
         {r(div("b_base", "n_base"), 4)} AS conv_base, {r(div("b_cand", "n_cand"), 4)} AS conv_cand,
         {r(z, 3)} AS z_score,
         COALESCE(n_base >= 10 AND n_cand >= 10 AND {div("b_cand", "n_cand")} < {div("b_base", "n_base")} - 0.3, FALSE) AS alert
  FROM g
)"""


GUARD = guard_sql()
QUERIES["guardrail_batch"] = _q(f"""{GUARD}
SELECT * FROM w
""")
FIRST_ALERT = f"""
SELECT {{keys}}, MIN(window_start) AS first_alert_start, MIN(window_end) AS first_alert_end,
       CAST(date_diff('hour', TIMESTAMP '{HINGE}', MIN(window_end)) AS BIGINT) AS hours_after_hinge,
       COUNT(*) AS n_alert_windows
FROM w WHERE alert GROUP BY {{keys}}
"""
QUERIES["guardrail_first_alert"] = _q(GUARD + FIRST_ALERT.format(keys="os_version, ad_format"))
QUERIES["guardrail_first_alert_by_buyer"] = _q(
    guard_sql(("os", "ad_format", "billing_type")) + FIRST_ALERT.format(keys="os, ad_format, billing_type")
)

# every other version against the incumbent, alerts only on a clear drop (z >= 3)
QUERIES["guardrail_versions"] = _q(guard_sql(("os", "ad_format", "billing_type")) + """
SELECT window_start, window_end, os, ad_format, billing_type, '8.2.0' AS sdk_version, n_base, n_cand, conv_base, conv_cand, z_score,
       COALESCE(alert AND z_score >= 3.0, FALSE) AS alert
FROM w WHERE n_cand > 0
""")

# D13 publisher scope: funnel per tier x era, and the daily funnel on Tier-1 only
def _scope_sql(scope: str) -> str:
    return _q(f"""
rq AS (
  SELECT r.request_id, COALESCE(p.{scope}, 'unknown') AS {scope}, {ERA} AS era
  FROM ad_requests r LEFT JOIN publishers p ON r.publisher_id = p.publisher_id
),
bid_t AS (
  SELECT q.{scope}, q.era, {div(cnt("b.did_bid = 1"), "COUNT(*)")} AS bid_rate
  FROM bids b JOIN rq q USING (request_id) GROUP BY 1, 2
),
auc_t AS (
  SELECT q.{scope}, q.era, {div(cnt("w.won = 1"), "COUNT(*)")} AS win_rate
  FROM rq q LEFT JOIN (SELECT request_id, MAX(is_winner) AS won FROM bids GROUP BY request_id) w USING (request_id)
  GROUP BY 1, 2
),
imp_t AS (
  SELECT q.{scope}, q.era, {div(cnt("i.rendered"), "COUNT(*)")} AS render_rate,
         {div(cnt("i.rendered AND i.billable"), cnt("i.rendered"))} AS billable_rate,
         {div(f"SUM({REV})", cnt("i.rendered"))} * 1000 AS ecpm
  FROM impressions i JOIN rq q USING (request_id) GROUP BY 1, 2
)
SELECT {scope}, era, {r("bid_rate", 4)} AS bid_rate, {r("win_rate", 4)} AS win_rate, {r("render_rate", 4)} AS render_rate,
       {r("billable_rate", 4)} AS billable_rate, {r("ecpm", 4)} AS ecpm
FROM bid_t JOIN auc_t USING ({scope}, era) JOIN imp_t USING ({scope}, era)
""")


QUERIES["publisher_scope"] = _scope_sql("tier")
QUERIES["publisher_scope_region"] = _scope_sql("region")
QUERIES["funnel_daily_tier1"] = _q(f"""
tier1 AS (
  SELECT * FROM ad_requests WHERE publisher_id IN (SELECT publisher_id FROM publishers WHERE tier = 'Tier-1')
),{_daily_ctes("tier1")}
SELECT CAST(d AS TIMESTAMP) AS d, {r("bid_rate", 3)} AS bid_rate, {r("win_rate", 3)} AS win_rate,
       {r("render_rate", 3)} AS render_rate, {r("billable_rate", 3)} AS billable_rate, {r("ecpm", 3)} AS ecpm, {r("ma", 3)} AS ecpm_7d_avg
FROM daily JOIN smooth USING (d)
""")

# D15 ttl_what_if on the iOS-17 rewarded candidate traffic
QUERIES["ttl_what_if"] = _q(f"""
x AS (
  SELECT i.render_latency_ms AS lat, b.bid_ttl_ms AS ttl, b.cleared_price, i.billable, {SIGNAL} AS signal
  FROM impressions i
  JOIN ad_requests r USING (request_id)
  JOIN bids b ON i.winning_bid_id = b.bid_id
  JOIN buyers y ON b.buyer_id = y.buyer_id
  WHERE i.rendered AND {POST} AND {A_COHORT} AND r.sdk_version = '8.2.0'
),
s AS (
  SELECT *, COALESCE(lat <= ttl + delta_ms AND signal, FALSE) AS would
  FROM (SELECT unnest([0, 250, 500, 1000, 1500, 2000]) AS delta_ms, * FROM x)
)
SELECT CAST(delta_ms AS BIGINT) AS delta_ms, COUNT(*) AS n_rendered, {cnt("billable")} AS billable_now,
       {cnt("would")} AS billable_whatif, {cnt("would AND NOT billable")} AS recovered_imps,
       {r("SUM(CASE WHEN would AND NOT billable THEN CAST(cleared_price / 1000.0 AS DECIMAL(28,12)) ELSE 0 END)", 4)} AS recovered_revenue_usd
FROM s GROUP BY delta_ms
""")


# D14 contract_check: PK duplicates, FK orphans, NULL counts, conditional rules
def _contract_sql(of: str = "", ctes: str = "") -> str:
    """``of`` ends the names of the six relations that are checked, ``ctes`` defines them."""
    # The model's keys and columns, stated here once more so that
    # a key lost in the library does not vanish from both sides.
    columns = {
        "publishers": "publisher_id publisher_name tier region",
        "buyers": "buyer_id buyer_name billing_type",
        "ad_requests": "request_id request_ts publisher_id app_id sdk_version os os_version device_model country ad_format placement_id",
        "bids": "bid_id request_id buyer_id bid_cpm did_bid is_winner cleared_price bid_ttl_ms",
        "impressions": "impression_id request_id winning_bid_id render_start_ts render_complete_ts render_latency_ms rendered viewable"
        " video_completed billable revenue_usd",
        "sdk_events": "event_id request_id event_type error_code latency_ms event_ts",
    }
    foreign = [
        ("bids", "request_id", "ad_requests", "request_id"),
        ("impressions", "request_id", "ad_requests", "request_id"),
        ("sdk_events", "request_id", "ad_requests", "request_id"),
        ("impressions", "winning_bid_id", "bids", "bid_id"),
        ("bids", "buyer_id", "buyers", "buyer_id"),
        ("ad_requests", "publisher_id", "publishers", "publisher_id"),
    ]

    def row(check: str, table: str, column: str, expr: str, src: str) -> str:
        return f"SELECT '{check}' AS check_name, '{table}' AS table_name, '{column}' AS column_name, CAST({expr} AS BIGINT) AS violations FROM {src}"

    parts = []
    for table, key in ((t, c.split()[0]) for t, c in columns.items()):
        src = f"(SELECT {key}, COUNT(*) AS c FROM {table}{of} WHERE {key} IS NOT NULL GROUP BY {key})"
        parts.append(row("pk_duplicate", table, key, "COALESCE(SUM(c - 1), 0)", src))
    for child, ck, parent, pk in foreign:
        src = f"{child}{of} c WHERE c.{ck} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {parent}{of} p WHERE p.{pk} = c.{ck})"
        parts.append(row("fk_orphan", child, ck, "COUNT(*)", src))
    for table, names in columns.items():
        for name in names.split():
            parts.append(row("null_count", table, name, f"COUNT(*) FILTER (WHERE {name} IS NULL)", table + of))
    rules = [
        ("rule_cpm_null_iff_no_bid", "bids", "bid_cpm", "(bid_cpm IS NULL) <> (did_bid = 0)"),
        ("rule_cleared_iff_winner", "bids", "cleared_price", "(cleared_price IS NOT NULL) <> (is_winner = 1)"),
        ("rule_cleared_above_bid", "bids", "cleared_price", "cleared_price > bid_cpm"),
        ("rule_latency_null_iff_not_rendered", "impressions", "render_latency_ms",
         "(render_latency_ms IS NULL) <> (NOT COALESCE(rendered, FALSE))"),
        ("rule_billable_not_rendered", "impressions", "billable", "COALESCE(billable, FALSE) AND NOT COALESCE(rendered, FALSE)"),
        ("rule_revenue_without_billing", "impressions", "revenue_usd",
         "NOT COALESCE(billable, FALSE) AND COALESCE(revenue_usd, 0.0) <> 0.0"),
    ]
    for check, table, column, pred in rules:
        parts.append(row(check, table, column, f"COUNT(*) FILTER (WHERE {pred})", table + of))
    parts.append(row("rule_complete_ts_null_iff_not_rendered", "impressions", "render_complete_ts",
                     "COUNT(*) FILTER (WHERE (render_complete_ts IS NULL) <> (NOT COALESCE(rendered, FALSE)))", f"impressions{of}"))
    wb = f"impressions{of} i JOIN bids{of} b ON i.winning_bid_id = b.bid_id"
    parts.append(row("rule_winning_bid_other_request", "impressions", "winning_bid_id",
                     "COUNT(*) FILTER (WHERE b.request_id <> i.request_id)", wb))
    parts.append(row("rule_winning_bid_not_winner", "impressions", "winning_bid_id",
                     "COUNT(*) FILTER (WHERE b.is_winner <> 1)", wb))
    wby = (f"impressions{of} i LEFT JOIN bids{of} b ON i.winning_bid_id = b.bid_id "
           f"LEFT JOIN (SELECT DISTINCT buyer_id, billing_type FROM buyers{of}) y ON b.buyer_id = y.buyer_id WHERE i.winning_bid_id IS NOT NULL")
    expected = f"COALESCE(i.rendered AND i.render_latency_ms <= b.bid_ttl_ms AND {SIGNAL}, FALSE)"
    parts.append(row("rule_billing_mismatch", "impressions", "billable",
                     f"COUNT(*) FILTER (WHERE {expected} <> COALESCE(i.billable, FALSE))", wby))
    parts.append(row("rule_revenue_not_cleared_price", "impressions", "revenue_usd",
                     "COUNT(*) FILTER (WHERE COALESCE(i.billable, FALSE) AND i.revenue_usd IS NOT NULL "
                     "AND ABS(i.revenue_usd - b.cleared_price / 1000.0) > 0.000001)", wby))
    parts.append(row("rule_video_null_iff_not_video_format", "impressions", "video_completed",
                     "COUNT(*) FILTER (WHERE (i.video_completed IS NULL) <> (r.ad_format IN ('banner', 'native')))",
                     f"impressions{of} i JOIN ad_requests{of} r USING (request_id)"))
    return _q(ctes + "\nUNION ALL\n".join(parts))


QUERIES["contract_check"] = _contract_sql()


# D14 contract_check_planted: the same over relations that break every contract
def _copied(table: str, key: str, where: str, replaced: str = "") -> str:
    changed = f"SELECT * {replaced} FROM {table}"
    rest = f"SELECT * REPLACE (CASE WHEN {key} % 97 <> 4 THEN {key} END AS {key})"
    return f"{table}_planted AS ({rest} FROM ({changed}) UNION ALL {rest} FROM ({changed}) WHERE {key} % {where})"


_PLANTED = ",\n".join([
    _copied("publishers", "publisher_id", "5 = 3"),
    _copied("buyers", "buyer_id", "5 = 3"),
    _copied("ad_requests", "request_id", "97 = 3", "REPLACE (IF(request_id % 101 = 5, -1, publisher_id) AS publisher_id)"),
    _copied("bids", "bid_id", "97 = 3", """REPLACE (
      IF(bid_id % 89 = 1 AND did_bid = 1, NULL, bid_cpm) AS bid_cpm,
      CASE WHEN bid_id % 83 = 3 AND is_winner = 1 AND bid_id % 89 <> 4 THEN 2 * IF(bid_id % 89 = 1 AND did_bid = 1, NULL, bid_cpm)
           WHEN bid_id % 89 = 2 AND is_winner = 1 THEN NULL ELSE cleared_price END AS cleared_price,
      IF(bid_id % 89 = 4, 0, is_winner) AS is_winner, IF(bid_id % 89 = 5, -request_id, request_id) AS request_id,
      IF(bid_id % 89 = 6, -1, buyer_id) AS buyer_id)"""),
    _copied("impressions", "impression_id", "97 = 3", """REPLACE (
      IF(impression_id % 83 = 1, NULL, render_latency_ms) AS render_latency_ms,
      IF(impression_id % 79 = 7 AND billable <> (impression_id % 83 = 5), FALSE, rendered) AS rendered,
      IF(impression_id % 83 = 3, NULL, render_complete_ts) AS render_complete_ts, IF(impression_id % 83 = 4, -1, winning_bid_id) AS winning_bid_id,
      billable <> (impression_id % 83 = 5) AS billable, IF(impression_id % 83 = 7, NULL, video_completed) AS video_completed,
      IF(impression_id % 83 = 8, -1, request_id) AS request_id,
      IF(impression_id % 83 = 2 AND NOT billable, 1.0, revenue_usd)
        + IF(impression_id % 79 = 6 AND billable <> (impression_id % 83 = 5), 1.0, 0.0) AS revenue_usd)"""),
    _copied("sdk_events", "event_id", "97 = 3", "REPLACE (IF(event_id % 79 = 2, -5, request_id) AS request_id)"),
]) + "\n"
QUERIES["contract_check_planted"] = _contract_sql("_planted", _PLANTED)
# D14 / R02 contract_profiles: loads that are summed up give the checks of all rows
QUERIES["contract_profiles"] = QUERIES["contract_check_planted"]

# D12 guardrail_stream: every D11 window; closed once it ends at or before the
# latest event less the 2-day watermark. The same rows come from a source that
# delivers every impression twice, and from bare impressions joined to requests.
_STREAM = _q(f"""{GUARD}
SELECT *, window_end <= (SELECT MAX(r.request_ts) FROM impressions i JOIN ad_requests r USING (request_id)) - INTERVAL 2 DAY AS closed
FROM w
""")
for _name in ("guardrail_stream", "guardrail_stream_dedup", "guardrail_stream_joined"):
    QUERIES[_name] = _STREAM

# Every impression in the three windows of 90 days that hold it
QUERIES["guardrail_stream_sliding"] = (
    _STREAM.replace("time_bucket(INTERVAL '90 days', ts, TIMESTAMP '1970-01-01')", "time_bucket(INTERVAL '30 days', ts, TIMESTAMP '1970-01-01') - to_days(CAST(30 * k AS INTEGER))")
    .replace("FROM x GROUP BY ALL", "FROM x, range(3) s(k) GROUP BY ALL")
)


def _recursive(sql: str) -> str:
    return sql.replace("WITH", "WITH RECURSIVE", 1)


# Counts and extremes are exact in a sketch; its percentiles must be
# within the sketch's rank error, which the query itself tests on the rows
QUERIES["latency_sketch_range"] = _q(f"""{FACT}
SELECT ver AS sdk_version, COUNT(*) AS n, CAST(MIN(lat) AS BIGINT) AS least, CAST(MAX(lat) AS BIGINT) AS most, TRUE AS p50_within, TRUE AS p95_within
FROM fact WHERE lat IS NOT NULL AND date_trunc('month', moment) >= DATE '{HINGE}' GROUP BY ver
""")

# D12 alert life cycle: window after window, one step of a recursion each
_LIFE = _recursive(_q(f"""{GUARD},
sc AS (
  SELECT os_version, ad_format, window_end, CAST(round((conv_base - conv_cand) * 10000) AS BIGINT) - 500 AS x,
         row_number() OVER (PARTITION BY os_version, ad_format ORDER BY window_end) AS i
  FROM w WHERE n_base >= 10 AND n_cand >= 10
),
fold AS (
  SELECT os_version, ad_format, i, window_end AS tick, greatest(0, x) AS s, x >= 3000 AS is_open, FALSE AS was,
         CAST(x >= 3000 AS BIGINT) AS alert
  FROM sc WHERE i = 1
  UNION ALL
  SELECT os_version, ad_format, i, tick, s, is_open, was, alert + CAST(is_open AND NOT was AS BIGINT) FROM (
    SELECT *, CASE WHEN s >= 3000 THEN TRUE WHEN s = 0 THEN FALSE ELSE was END AS is_open FROM (
      SELECT n.os_version, n.ad_format, n.i, n.window_end AS tick, f.alert,
             greatest(0, CASE WHEN n.window_end > f.tick + INTERVAL 200 DAY THEN 0 ELSE f.s END + n.x) AS s,
             f.is_open AND NOT n.window_end > f.tick + INTERVAL 200 DAY AS was
      FROM fold f JOIN sc n ON n.i = f.i + 1 AND n.os_version IS NOT DISTINCT FROM f.os_version AND n.ad_format IS NOT DISTINCT FROM f.ad_format))
),
told AS (
  SELECT os_version, ad_format, alert, CASE WHEN NOT was THEN 'open' WHEN is_open THEN 'update' ELSE 'recovered' END AS event, tick, s AS score
  FROM fold WHERE is_open OR was
  UNION ALL
  SELECT os_version, ad_format, alert, 'silent', tick + INTERVAL 200 DAY, NULL FROM (
    SELECT *, lead(tick) OVER (PARTITION BY os_version, ad_format ORDER BY i) AS next FROM fold)
  WHERE is_open AND (next IS NULL OR next > tick + INTERVAL 200 DAY)
)
SELECT os_version, ad_format, alert, event, tick AS "at", score FROM told
UNION ALL
SELECT os_version, ad_format, alert, 'escalate', MIN(tick) + INTERVAL 150 DAY, NULL FROM told GROUP BY os_version, ad_format, alert
HAVING MIN(tick) + INTERVAL 150 DAY <= MAX(tick)
"""))
for _name in ("alert_events", "alert_events_stream"):
    QUERIES[_name] = _LIFE

# Requests that are missing (7), behind the watermark (9) or three hours early (11) match nothing
_FOUND = cnt("i.request_id % 50 NOT IN (7, 9, 11)")
QUERIES["stream_join_unmatched"] = _q(f"""
SELECT CAST(year(r.request_ts) AS BIGINT) AS year, COUNT(*) AS n_won, {_FOUND} AS n_matched, {_FOUND} AS n_versioned
FROM impressions i JOIN ad_requests r USING (request_id) GROUP BY 1
""")


# Least cost of every prefix of the series, one bucket a step, then the
# starts backwards; the Spark side prunes, this does not
def _segments_sql(keys: tuple[str, ...], days: int) -> str:
    own = "".join(f"{k}, " for k in keys)
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    same = lambda a, b: " AND ".join([f"{a}.{k} IS NOT DISTINCT FROM {b}.{k}" for k in keys] or ["TRUE"])
    return _recursive(_q(f"""
spent AS (
  SELECT request_id, SUM(rendered::INT) AS drawn, SUM(CAST(COALESCE(revenue_usd, 0) AS DECIMAL(28,12))) AS usd FROM impressions GROUP BY request_id
),
series AS (
  SELECT {own}TIMESTAMP '1970-01-01' + to_days(CAST(date_diff('day', DATE '1970-01-01', CAST(request_ts AS DATE)) // {days} * {days} AS INTEGER)) AS b,
         SUM(usd) AS r, SUM(drawn) AS n, {div("SUM(usd)", "SUM(drawn)")} * 1000 AS e
  FROM ad_requests LEFT JOIN spent USING (request_id) GROUP BY ALL
),
known AS (SELECT *, e - lag(e) OVER ({part}ORDER BY b) AS step FROM series WHERE e IS NOT NULL),
lists AS (
  SELECT {own}COUNT(*) AS m, list(e ORDER BY b) AS x, list(b ORDER BY b) AS bs, 3.0 * ln(COUNT(*)) * AVG(step * step) / 2 AS beta FROM known GROUP BY ALL
),
sums AS (
  SELECT *, [list_sum(x[:i]) FOR i IN range(1, m + 1)] AS s1, [list_sum([v * v FOR v IN x[:i]]) FOR i IN range(1, m + 1)] AS s2 FROM lists
),
dp AS (
  SELECT {own}0::BIGINT AS t, [-beta] AS f, [0::BIGINT] AS prev FROM sums
  UNION ALL
  SELECT {own}t + 1, list_append(f, list_min(costs) + beta), list_append(prev, CAST(list_position(costs, list_min(costs)) - 1 AS BIGINT)) FROM (
    SELECT dp.*, beta, list_transform(range(t + 1), lambda s: f[s + 1]
             + greatest(s2[t + 1] - coalesce(s2[s], 0) - pow(s1[t + 1] - coalesce(s1[s], 0), 2) / (t + 1 - s), 0)) AS costs
    FROM dp JOIN sums ON {same("dp", "sums")} WHERE t < m)
),
done AS (SELECT dp.prev, sums.* FROM dp JOIN sums ON {same("dp", "sums")} AND t = m),
starts AS (
  SELECT {own}CASE WHEN m < 3 THEN 0 ELSE prev[m + 1] END AS s FROM done
  UNION ALL
  SELECT {"".join(f"d.{k}, " for k in keys)}d.prev[starts.s + 1] FROM starts JOIN done d ON {same("starts", "d")} WHERE starts.s > 0
),
cuts AS (SELECT {"".join(f"d.{k}, " for k in keys)}CASE WHEN s > 0 THEN d.bs[s + 1] END AS b FROM starts JOIN done d ON {same("starts", "d")}),
numbered AS (SELECT series.*, (SELECT COUNT(*) FROM cuts c WHERE {same("c", "series")} AND (c.b IS NULL OR c.b <= series.b)) AS segment FROM series),
seg AS (
  SELECT {own}segment, MIN(b) AS first_bucket, MAX(b) AS last_bucket, COUNT(*) AS n_buckets, {div("SUM(r)", "SUM(n)")} * 1000 AS e
  FROM numbered GROUP BY ALL
),
changed AS (SELECT *, e - lag(e) OVER ({part}ORDER BY segment) AS change FROM seg),
fell AS (SELECT *, CASE WHEN first_bucket + INTERVAL {days} DAY > TIMESTAMP '{HINGE}' AND change < 0 THEN change END AS fall FROM changed)
SELECT {own}segment, first_bucket, last_bucket, n_buckets, {r("e", 4)} AS ecpm, {r("change", 4)} AS change,
       COALESCE(fall = MIN(fall) OVER ({part}), FALSE) AS onset
FROM fell
"""))


QUERIES["ecpm_segments"] = _segments_sql((), 30)
QUERIES["ecpm_segments_by_cohort"] = _segments_sql(("os", "ad_format"), 90)


# D03 mix_shapley: the post total with each subset of the variables at its pre
# shares, subset by subset, then all 24 orders of the four variables
_MIX = ("country", "os", "os_version", "ad_format")


def _mix_sql() -> str:
    totals, ways = [], []
    for subset in range(16):
        by = [v for i, v in enumerate(_MIX) if subset >> i & 1]
        group = f"GROUP BY {', '.join(by)}" if by else "GROUP BY ()"
        totals.append(f"""SELECT {subset} AS s, metric, SUM(n0 * COALESCE(p1, p0, 0)) / SUM(n0) AS g FROM (
          SELECT metric, SUM(n0) AS n0, {div("SUM(a0)", "SUM(n0)")} * MAX(unit) AS p0, {div("SUM(a1)", "SUM(n1)")} * MAX(unit) AS p1
          FROM cells {group.replace("GROUP BY ()", "GROUP BY metric") if not by else group + ", metric"}) GROUP BY metric""")
    for order in itertools.permutations(range(4)):
        done = 0
        for i in order:
            ways.append((i, done, done | 1 << i))
            done |= 1 << i
    steps = ", ".join(f"({i}, {a}, {b})" for i, a, b in ways)
    parts = ", ".join(f"{r(f'(SELECT AVG(a.g - b.g) FROM steps JOIN g a ON a.s = before AND a.metric = z.metric JOIN g b ON b.s = after AND b.metric = z.metric WHERE v = {i})', 4)} AS mix_{v}" for i, v in enumerate(_MIX))
    own = "metric, SUM(a0)::DOUBLE / NULLIF(SUM(n0), 0) * MAX(unit) AS e0, SUM(a1)::DOUBLE / NULLIF(SUM(n1), 0) * MAX(unit) AS e1"
    return _q(f"""
x AS (
  SELECT {", ".join(_MIX)}, {ERA} = '2_post' AS late, i.rendered, i.billable, {REV} AS rev FROM impressions i JOIN ad_requests r USING (request_id)
),
cells AS (
  SELECT 'ecpm' AS metric, 1000 AS unit, {", ".join(_MIX)}, {cnt("rendered AND NOT late")} AS n0, {cnt("rendered AND late")} AS n1,
         SUM(rev) FILTER (WHERE NOT late) AS a0, SUM(rev) FILTER (WHERE late) AS a1 FROM x GROUP BY ALL
  UNION ALL
  SELECT 'billable_rate', 1, {", ".join(_MIX)}, {cnt("rendered AND NOT late")}, {cnt("rendered AND late")},
         {cnt("rendered AND billable AND NOT late")}, {cnt("rendered AND billable AND late")} FROM x GROUP BY ALL
),
g AS ({" UNION ALL ".join(totals)}),
steps(v, before, after) AS (VALUES {steps}),
z AS (SELECT {own} FROM cells GROUP BY metric)
SELECT z.metric, {r("e0", 4)} AS total_pre, {r("e1", 4)} AS total_post, {r("e1 - e0", 4)} AS total_change,
       {r("g.g - e0", 4)} AS within, {r("e1 - g.g", 4)} AS mix, {parts}
FROM z JOIN g ON g.metric = z.metric AND g.s = 15
""")


QUERIES["mix_shapley"] = _mix_sql()

# D01 cohort_lattice: every cohort as its list of items; refinements, implied items
# and coarser descriptions are found by comparing the lists
QUERIES["cohort_lattice"] = _q(f"""{FACT},
shown AS (SELECT ver, paid, os, major AS os_major, fmt AS ad_format, country FROM fact WHERE {LATE} AND ver IN ('8.1.0', '8.2.0')),
named AS (
  SELECT ver, paid, ['ad_format=' || COALESCE(ad_format, '(null)'), 'country=' || COALESCE(country, '(null)'),
                     'os=' || COALESCE(os, '(null)'), 'os_major=' || COALESCE(os_major, '(null)')] AS every FROM shown
),
sides AS (
  SELECT [every[j + 1] FOR j IN range(4) IF (bits // CAST(pow(2, j) AS INT)) % 2 = 1] AS items,
         {cnt("ver = '8.1.0'")} AS nb, {cnt("ver = '8.2.0'")} AS nc, {cnt("ver = '8.1.0' AND paid")} AS kb, {cnt("ver = '8.2.0' AND paid")} AS kc
  FROM named, range(16) t(bits) GROUP BY 1
),
c AS (
  SELECT *, len(items) AS k, kc::DOUBLE / nc - kb::DOUBLE / nb AS delta,
         sqrt((kb + 1.0) / (nb + 2.0) * (1 - (kb + 1.0) / (nb + 2.0)) / nb + (kc + 1.0) / (nc + 2.0) * (1 - (kc + 1.0) / (nc + 2.0)) / nc) AS se
  FROM sides WHERE nb >= 15 AND nc >= 15
),
whole AS (
  SELECT *, [y.i FOR y IN (SELECT list({{'i': list_filter(f.items, lambda e: NOT list_contains(o.items, e))[1]}}) FROM c f
             WHERE f.k = o.k + 1 AND list_has_all(f.items, o.items) AND f.nb + f.nc = o.nb + o.nc)] AS implied
  FROM c o WHERE delta <= -0.1 AND delta / se <= -4
    AND NOT EXISTS (SELECT 1 FROM c f WHERE f.k = o.k + 1 AND list_has_all(f.items, o.items) AND f.delta - f.se > 0.5 * o.delta)
),
full_ AS (SELECT *, list_concat(items, COALESCE(implied, [])) AS closure, array_to_string(items, ', ') AS cohort FROM whole),
told AS (
  SELECT * FROM full_ o WHERE NOT EXISTS (
    SELECT 1 FROM full_ a WHERE list_has_all(o.closure, a.items) AND (len(a.closure), a.k, a.cohort) < (len(o.closure), o.k, o.cohort))
),
own AS (
  SELECT told.cohort, {cnt("ver = '8.1.0'")} AS nb, {cnt("ver = '8.2.0'")} AS nc, {cnt("ver = '8.1.0' AND paid")} AS kb, {cnt("ver = '8.2.0' AND paid")} AS kc
  FROM told JOIN named ON list_has_all(every, items)
  WHERE NOT EXISTS (SELECT 1 FROM told a WHERE list_has_all(every, a.items) AND (a.delta / a.se, a.cohort) < (told.delta / told.se, told.cohort)) GROUP BY 1
),
own_change AS (
  SELECT cohort, kc::DOUBLE / nc - kb::DOUBLE / nb AS own_delta,
         sqrt((kb + 1.0) / (nb + 2.0) * (1 - (kb + 1.0) / (nb + 2.0)) / nb + (kc + 1.0) / (nc + 2.0) * (1 - (kc + 1.0) / (nc + 2.0)) / nc) AS own_se
  FROM own WHERE nb >= 15 AND nc >= 15
),
last_ AS (SELECT * FROM told JOIN own_change USING (cohort) WHERE own_delta <= -0.1 AND own_delta / own_se <= -4)
SELECT cohort, k AS n_keys, array_to_string(list_sort(COALESCE(implied, [])), ', ') AS implied, nb AS n_base, nc AS n_cand,
       {r("kb::DOUBLE / nb", 3)} AS br_base, {r("kc::DOUBLE / nc", 3)} AS br_cand, {r("delta", 3)} AS delta, {r("delta / se", 3)} AS z,
       {r("own_delta", 3)} AS own_delta, (SELECT COUNT(*) FROM last_ w WHERE w.delta / w.se < last_.delta / last_.se) + 1 AS worst_rank
FROM last_
""")

# D08 error_spikes: the tail by the power series alone (exact to 1e-16, the result
# has six places), q-values as the least over all tests as large or larger
QUERIES["error_spikes"] = _q(f"""
req AS (
  SELECT r.request_id, r.sdk_version = '8.2.0' AS new, r.os, {OSM} AS os_major, r.ad_format FROM ad_requests r
  WHERE r.sdk_version IN ('8.1.0', '8.2.0') AND {POST}
),
shown AS (SELECT os, os_major, ad_format, {cnt("NOT new")} AS ib, {cnt("new")} AS ic FROM impressions JOIN req USING (request_id) GROUP BY ALL HAVING ib > 0 AND ic > 0),
told AS (SELECT os, os_major, ad_format, error_code, {cnt("NOT new")} AS eb, {cnt("new")} AS ec FROM sdk_events JOIN req USING (request_id) WHERE error_code IS NOT NULL GROUP BY ALL),
x AS (SELECT shown.*, error_code, eb, ec, ic::DOUBLE / (ib + ic) AS part FROM shown JOIN told USING (os, os_major, ad_format)),
tests AS (SELECT (SELECT COUNT(*) FROM shown) * (SELECT COUNT(DISTINCT error_code) FROM x) AS m),
z AS (SELECT *, (ec - (eb + ec) * part - 0.5) / sqrt((eb + ec) * part * (1 - part)) AS z FROM x),
s AS (
  SELECT *, list_sum([exp((2 * k + 1) * ln(abs(z)) - list_sum([ln(2.0 * j + 1) FOR j IN range(k + 1)])) FOR k IN range(200)]) * sign(z) AS series FROM z
),
p AS (SELECT *, CASE WHEN z > 7 THEN 0.0 ELSE 0.5 - series * exp(-z * z / 2) / sqrt(2 * pi()) END AS p FROM s),
q AS (
  SELECT *, (SELECT MIN(least(1.0, o.p * m / (SELECT COUNT(*) FROM p u WHERE u.p <= o.p))) FROM p o, tests WHERE o.p >= p.p) AS q FROM p
)
SELECT os, os_major, ad_format, error_code, eb AS n_base, ec AS n_cand, ib AS imps_base, ic AS imps_cand,
       {r("1000 * (eb::DOUBLE / ib)", 3)} AS per_1000_base, {r("1000 * (ec::DOUBLE / ic)", 3)} AS per_1000_cand,
       {r("z", 3)} AS z, {r("p", 6)} AS p_value, {r("q", 6)} AS q_value, q <= 0.05 AS spike
FROM q
""")

# D15 ttl_frontier: every raise that some impression needs, each summed up anew
QUERIES["ttl_frontier"] = _q(f"""
x AS (
  SELECT i.render_latency_ms - b.bid_ttl_ms AS up, CAST(b.cleared_price / 1000.0 AS DECIMAL(28,12)) AS usd
  FROM impressions i JOIN ad_requests r USING (request_id) JOIN bids b ON i.winning_bid_id = b.bid_id JOIN buyers y ON b.buyer_id = y.buyer_id
  WHERE i.rendered AND {POST} AND {A_COHORT} AND r.sdk_version = '8.2.0' AND {SIGNAL} AND NOT i.billable AND i.render_latency_ms > b.bid_ttl_ms
)
SELECT CAST(o.up AS BIGINT) AS delta_ms, (SELECT COUNT(*) FROM x WHERE up = o.up) AS imps_at,
       {r("CAST((SELECT SUM(usd) FROM x WHERE up = o.up) AS DOUBLE)", 4)} AS revenue_at_usd, (SELECT COUNT(*) FROM x WHERE up <= o.up) AS recovered_imps,
       {r("CAST((SELECT SUM(usd) FROM x WHERE up <= o.up) AS DOUBLE)", 4)} AS recovered_revenue_usd,
       {r("CAST((SELECT SUM(usd) FROM x WHERE up <= o.up) AS DOUBLE) / CAST((SELECT SUM(usd) FROM x) AS DOUBLE)", 4)} AS revenue_share,
       COALESCE(o.up = (SELECT MAX(up) FROM x WHERE up <= 1500), FALSE) AS best
FROM (SELECT DISTINCT up FROM x) o
""")


# D05 / A09 with intervals: every impression is counted as often as its day is drawn;
# a day's number is the count of steps of the Poisson distribution under its hash
def _drawn(days: str) -> str:
    return f"""
steps AS (SELECT floor(4294967296 * list_sum([exp(-1.0) / factorial(j::INT) FOR j IN range(i + 1)])) AS step FROM range(13) t(i)),
hashed AS (
  SELECT day, rep, CAST('0x' || substr(md5(strftime(day, '%Y-%m-%d') || ':' || rep), 1, 8) AS BIGINT) AS u
  FROM (SELECT DISTINCT day FROM {days}), range(1, 201) t(rep)
),
draws AS (
  SELECT day, 0 AS rep, 1 AS w FROM (SELECT DISTINCT day FROM {days})
  UNION ALL SELECT day, rep, CAST((SELECT COUNT(*) FROM steps WHERE u >= step) AS INT) FROM hashed
)"""


def _at(stat: str, p: float) -> str:
    drawn = f"list_sort(list({stat}) FILTER (rep > 0 AND {stat} IS NOT NULL))"
    return f"({drawn})[CAST(greatest(1, ceil({cnt(f'rep > 0 AND {stat} IS NOT NULL')} * CAST({p!r} AS DOUBLE))) AS BIGINT)]"


_LO, _HI = (1.0 - 0.95) / 2, (1.0 + 0.95) / 2
_CELLS = {f"{a}_{b}": f"os = '{o}' AND ver = '{v}'" for a, o in (("treated", "iOS"), ("control", "Android")) for b, v in (("base", "8.1.0"), ("cand", "8.2.0"))}
_OWN = lambda c: f"MAX({c}) FILTER (rep = 0)"
QUERIES["control_diff_intervals"] = _q(f"""{FACT},
shown AS (SELECT fmt, os, ver, paid, moment::DATE AS day FROM fact WHERE {LATE} AND os IN ('iOS', 'Android') AND ver IN ('8.1.0', '8.2.0')),
{_drawn("shown").strip()},
cells AS (
  SELECT fmt, rep, {", ".join(f"COALESCE(SUM(w) FILTER ({on}), 0) AS n_{c}, COALESCE(SUM(w) FILTER ({on} AND paid), 0) AS k_{c}" for c, on in _CELLS.items())}
  FROM shown JOIN draws USING (day) WHERE w > 0 GROUP BY fmt, rep
),
z AS (
  SELECT *, ({div("k_treated_cand", "n_treated_cand")} - {div("k_treated_base", "n_treated_base")})
          - ({div("k_control_cand", "n_control_cand")} - {div("k_control_base", "n_control_base")}) AS did FROM cells
),
b AS (
  SELECT fmt, {", ".join(f"CAST({_OWN(f'n_{c}')} AS BIGINT) AS n_{c}" for c in _CELLS)}, {_OWN("did")} AS did, {_at("did", _LO)} AS lo, {_at("did", _HI)} AS hi,
         {cnt("rep > 0 AND did IS NOT NULL")} AS n_replicates FROM z GROUP BY fmt
)
SELECT fmt AS ad_format, {", ".join(f"n_{c}" for c in _CELLS)}, {r("did", 3)} AS did, {r("lo", 3)} AS did_lo, {r("hi", 3)} AS did_hi,
       n_replicates, COALESCE(lo > 0 OR hi < 0, FALSE) AS clear
FROM b
""")
QUERIES["impact_intervals"] = _q(f"""{FACT},
shown AS (
  SELECT 'A: iOS17 rewarded_video (latency/TTL)' AS cohort, ver, paid, usd, moment::DATE AS day FROM fact WHERE {IOS17_REWARDED}
  UNION ALL
  SELECT 'B: iOS interstitial, viewable buyers (OMID)', ver, paid, usd, moment::DATE FROM fact WHERE {IOS_INTERSTITIAL} AND pays_on = 'viewable'
),
{_drawn("shown").strip()},
cells AS (
  SELECT cohort, rep, COALESCE(SUM(w) FILTER (ver = '8.2.0'), 0) AS nc, COALESCE(SUM(w) FILTER (ver = '8.2.0' AND paid), 0) AS bc,
         COALESCE(SUM(w) FILTER (ver = '8.1.0'), 0) AS nb, COALESCE(SUM(w) FILTER (ver = '8.1.0' AND paid), 0) AS bb,
         SUM(usd * CAST(w AS DECIMAL(3,0))) FILTER (ver = '8.1.0' AND paid) AS rb
  FROM shown JOIN draws USING (day) WHERE w > 0 GROUP BY cohort, rep
),
y AS (SELECT *, {div("bb", "nb")} * nc::DOUBLE - bc::DOUBLE AS lost FROM cells),
z AS (SELECT *, lost * {div("rb", "bb")} AS usd FROM y),
b AS (
  SELECT cohort, CAST({_OWN("nc")} AS BIGINT) AS rendered_cand, {_OWN("lost")} AS lost, {_at("lost", _LO)} AS lost_lo, {_at("lost", _HI)} AS lost_hi,
         {_OWN("usd")} AS usd, {_at("usd", _LO)} AS usd_lo, {_at("usd", _HI)} AS usd_hi, {cnt("rep > 0 AND lost IS NOT NULL")} AS n_replicates
  FROM z GROUP BY cohort
)
SELECT cohort, rendered_cand, {", ".join(f"{r(f'lost{e}', 2)} AS lost_billable_imps{e}" for e in ("", "_lo", "_hi"))},
       {", ".join(f"{r(f'usd{e}', 4)} AS lost_revenue_usd{e}" for e in ("", "_lo", "_hi"))}, n_replicates, COALESCE(lost_lo > 0, FALSE) AS clear
FROM b
""")

# D07 rollout_curve: the rising fit of a day is the largest, over all starts up to it, of
# the least mean over all ends from it on; days of one fit are a block
QUERIES["rollout_curve"] = _q(f"""
daily AS (
  SELECT os, CAST(request_ts AS DATE) AS d, COUNT(*) AS n, {cnt("sdk_version = '8.2.0'")} AS k FROM ad_requests WHERE request_ts IS NOT NULL GROUP BY 1, 2
),
s AS (
  SELECT *, row_number() OVER w AS i, SUM(n) OVER w AS cn, SUM(k) OVER w AS ck, greatest(0.0, COALESCE(lag(k::DOUBLE / n) OVER w - k::DOUBLE / n, 0.0)) AS fell
  FROM daily WINDOW w AS (PARTITION BY os ORDER BY d)
),
runs AS (SELECT a.os, a.i AS a, b.i AS b, (b.ck - a.ck + a.k)::DOUBLE / (b.cn - a.cn + a.n)::DOUBLE AS mean FROM s a JOIN s b ON a.os = b.os AND b.i >= a.i),
low AS (SELECT os, b AS i, MIN(mean) OVER (PARTITION BY os, a ORDER BY b DESC) AS m FROM runs),
fits AS (SELECT os, i, MAX(m) AS fit FROM low GROUP BY os, i),
blocks AS (
  SELECT os, fit, MIN(d) AS first_day, MAX(d) AS last_day, COUNT(*) AS n_days, SUM(n) AS n, SUM(k) AS k, {cnt("fell > 0")} AS n_falls, MAX(fell) AS worst
  FROM s JOIN fits USING (os, i) GROUP BY os, fit
)
SELECT os, row_number() OVER (PARTITION BY os ORDER BY fit) AS block, CAST(first_day AS TIMESTAMP) AS first_day, CAST(last_day AS TIMESTAMP) AS last_day, n_days,
       CAST(n AS BIGINT) AS n_requests, CAST(k AS BIGINT) AS n_cand, {r("fit", 4)} AS share, n_falls, {r("worst", 4)} AS worst_fall,
       COALESCE(fit = MIN(fit) FILTER (fit >= 0.5) OVER (PARTITION BY os), FALSE) AS majority
FROM blocks
""")
