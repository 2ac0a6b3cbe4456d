"""DuckDB SQL for every query that SQL can express, over the same tables.

Named subqueries are written once; ``sql`` puts those a query needs, and what they need,
into its WITH clause.
"""

import re

from sessionloom.functions.geo import GEOHASH_ALPHABET, WGS84_FLATTENING, WGS84_RADIUS_KM
from sessionloom.operators.tuning import GRID_K, GRID_SHRINK

PARTS: dict[str, str] = {}
ORACLE: dict[str, str] = {}


def part(name: str, text: str) -> None:
    PARTS[name] = text


def _needs(text: str) -> set[str]:
    words = set(re.findall(r"\b[a-z_0-9]+\b", text))
    return words & PARTS.keys()


def sql(text: str) -> str:
    wanted, queue = set(), list(_needs(text))
    while queue:
        name = queue.pop()
        if name not in wanted:
            wanted.add(name)
            queue += _needs(PARTS[name]) - {name}
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({PARTS[n]})" for n in PARTS if n in wanted)
    return f"WITH {ctes}\n{text}" if ctes else text


def oracle(name: str, text: str) -> None:
    ORACLE[name] = sql(text)


def draw(*parts: str) -> str:
    text = " || '|' || ".join(["'42'", *[f"CAST({p} AS VARCHAR)" for p in parts]])
    return f"CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT)"


def geohash(lat: str, lon: str, precision: int) -> str:
    total = 5 * precision
    widths = (total + 1) // 2, total // 2

    def cell(value, low, span, bits):
        steps = 2**bits
        return (
            f"CAST(greatest(least(ceil(({value} - ({low}e0)) / {span}e0 * {steps}e0) - 1,"
            f" {steps - 1}), 0) AS BIGINT)"
        )

    axes = cell(lon, -180, 360, widths[0]), cell(lat, -90, 180, widths[1])
    letters = []
    for start in range(0, total, 5):
        bits = [
            f"((({axes[p % 2]} >> {widths[p % 2] - 1 - p // 2}) & 1) << {4 - p + start})"
            for p in range(start, start + 5)
        ]
        letters.append(f"substr('{GEOHASH_ALPHABET}', CAST({' + '.join(bits)} + 1 AS INT), 1)")
    return f"CASE WHEN {lat} IS NOT NULL AND {lon} IS NOT NULL THEN {' || '.join(letters)} END"


def geodesic(source: str, lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """``source`` with a column km."""
    f, r = repr(WGS84_FLATTENING), repr(WGS84_RADIUS_KM)
    return f"""
    SELECT * EXCLUDE (b1, b2, s, x, y), CASE WHEN s = 0 THEN 0 ELSE {r}e0 * (s - {f}e0 / 2 * (x + y)) END AS km
    FROM (SELECT *,
      (s - sin(s)) * pow(sin((b1 + b2) / 2) * cos((b2 - b1) / 2), 2) / nullif(pow(cos(s / 2), 2), 0) AS x,
      (s + sin(s)) * pow(cos((b1 + b2) / 2) * sin((b2 - b1) / 2), 2) / nullif(pow(sin(s / 2), 2), 0) AS y
    FROM (SELECT *, 2 * asin(sqrt(least(pow(sin((b2 - b1) / 2), 2)
        + cos(b1) * cos(b2) * pow(sin(radians({lon2} - {lon1}) / 2), 2), 1e0))) AS s
    FROM (SELECT *, atan((1 - {f}e0) * tan(radians({lat1}))) AS b1,
        atan((1 - {f}e0) * tan(radians({lat2}))) AS b2 FROM {source})))"""


# ---- model tables --------------------------------------------------------------------

LINE_NUMBER = "((CAST(l_linenumber AS BIGINT) * 100000000 + l_partkey) * 100000 + l_suppkey)"

part(
    "ev",
    f"""SELECT l_orderkey AS session_id, l_partkey AS listing_id,
    CASE WHEN o_custkey % 3 <> 0 THEN o_custkey END AS user_id,
    l_returnflag || l_linestatus AS event_type, o_orderstatus AS business_type,
    CAST(l_shipdate AS DATE) AS dt, l_shipdate AS event_ts, {LINE_NUMBER} AS event_id
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
part(
    "li",
    f"""SELECT l_orderkey AS session_id, l_partkey AS listing_id, CAST(l_shipdate AS DATE) AS dt,
    l_shipdate AS event_ts, CAST(epoch(l_shipdate) AS BIGINT) AS seconds,
    {LINE_NUMBER} AS event_id, l_suppkey AS supplier_id FROM lineitem""",
)
LAT = "CASE WHEN p_partkey % 17 <> 0 THEN -33e0 + (p_partkey * 37 % 1000) / 100e0 END"
LON = "CASE WHEN p_partkey % 17 <> 0 THEN -60e0 + (p_partkey * 91 % 1000) / 100e0 END"
part(
    "lst",
    f"""SELECT p_partkey AS listing_id_numeric, {LAT} AS lat, {LON} AS lon,
    p_retailprice * (1 + p_partkey % 7) AS price, CAST(p_size AS DOUBLE) AS usable_areas,
    p_size % 5 AS bedrooms, p_size % 3 AS bathrooms,
    CASE WHEN p_partkey % 11 <> 0 THEN CAST(p_partkey % 4 AS INT) END AS parking_spaces,
    p_size % 2 AS suites, CASE WHEN p_partkey % 19 <> 0 THEN p_brand END AS city,
    split_part(p_name, ' ', 1) AS neighborhood, p_type AS unit_type, n_name AS state
    FROM part JOIN nation ON p_partkey % 25 = n_nationkey""",
)
part("known", "SELECT * FROM lst WHERE listing_id_numeric % 13 <> 5")
part(
    "raw_lst",
    f"""SELECT l_orderkey AS source_order, {LINE_NUMBER} AS version,
    'L' || l_partkey AS anonymized_listing_id, l_linestatus = 'O' AS active,
    CASE WHEN l_linenumber <> 5 THEN l_shipdate END AS updated_at, l_shipdate AS created_at,
    CASE WHEN l_linenumber <> 2 THEN l_extendedprice END AS price,
    CASE WHEN l_linenumber <> 3 THEN CAST(p_size AS DOUBLE) END AS usable_areas,
    CASE WHEN l_linenumber <> 4 THEN CAST(p_size AS DOUBLE) END AS total_areas,
    p_size % 5 AS bedrooms, CASE WHEN l_linenumber <> 6 THEN l_linenumber END AS bathrooms,
    {LAT} AS lat, {LON} AS lon,
    CASE WHEN p_partkey % 34 <> 0 THEN 'Z' || p_partkey % 50 END AS zip_code,
    CASE WHEN p_size <> 13 THEN p_type END AS unit_type
    FROM lineitem JOIN part ON l_partkey = p_partkey""",
)


def fingerprint(zip_code: str) -> str:
    return f"""md5(coalesce({geohash('lat', 'lon', 2)}, {zip_code}, 'UNKNOWN_GEO') || '|' ||
    coalesce(CAST(CAST(trunc(usable_areas / 10) AS INT) * 10 AS VARCHAR), '-1') || '|' ||
    coalesce(CAST(bedrooms AS VARCHAR), '0') || '|' || coalesce(unit_type, 'UNKNOWN'))"""


part("raw_can", f"SELECT *, {fingerprint('zip_code')} AS canonical_listing_id FROM raw_lst")
part(
    "can",
    f"""SELECT listing_id_numeric AS anonymized_listing_id, price,
    {fingerprint('CAST(NULL AS VARCHAR)')} AS canonical_listing_id FROM lst""",
)
part(
    "raw_ev",
    f"""SELECT 's' || l_orderkey AS anonymized_session_id, {LINE_NUMBER} AS event_id,
    CASE WHEN l_linenumber <> 1 THEN CAST(l_suppkey AS VARCHAR) END AS anonymized_user_id,
    CASE WHEN l_orderkey % 10 <> 0 THEN 'a' || l_orderkey END AS anonymized_anonymous_id,
    'L' || l_partkey AS anonymized_listing_id, l_partkey,
    CASE WHEN l_linenumber <> 7 THEN CAST(epoch(l_shipdate) AS BIGINT) * 1000 + l_linenumber * 7 END AS event_ms
    FROM lineitem""",
)
part(
    "ident",
    """SELECT anonymized_anonymous_id AS anonymous_id, min(anonymized_user_id) AS id
    FROM raw_ev GROUP BY 1 HAVING count(DISTINCT anonymized_user_id) <= 7""",
)
part(
    "resolved",
    """SELECT anonymized_session_id, event_id, anonymized_listing_id AS listing_id,
    coalesce(anonymized_user_id, id) AS user_id, anonymized_anonymous_id AS anonymous_id
    FROM raw_ev LEFT JOIN ident ON anonymized_anonymous_id = anonymous_id
    WHERE l_partkey IN (SELECT listing_id_numeric FROM known)""",
)

# ---- sessions ------------------------------------------------------------------------

WINDOW = "dt BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'"


def session_steps(prefix: str, source: str, support: int, most: int) -> None:
    """<prefix>_rep, _len, _sup and _fin: repeats, length, support, length again."""

    def limited(table):
        return f"""SELECT * EXCLUDE (rn, sz) FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS sz,
        row_number() OVER (PARTITION BY user_id ORDER BY event_ts DESC, event_id DESC) AS rn
        FROM {table}) WHERE sz >= 2 AND rn <= {most}"""

    part(
        f"{prefix}_rep",
        f"""SELECT * EXCLUDE (prev) FROM (SELECT *, lag(item_id) OVER
        (PARTITION BY user_id ORDER BY event_ts, event_id) AS prev FROM {source})
        WHERE prev IS NULL OR prev <> item_id""",
    )
    part(f"{prefix}_len", limited(f"{prefix}_rep"))
    part(
        f"{prefix}_sup",
        f"""SELECT * FROM {prefix}_len WHERE item_id IN
        (SELECT item_id FROM {prefix}_len GROUP BY item_id HAVING count(*) >= {support})""",
    )
    part(f"{prefix}_fin", limited(f"{prefix}_sup"))


part(
    "inter",
    """SELECT session_id AS user_id, listing_id AS item_id, seconds AS timestamp, event_ts, event_id
    FROM li""",
)
session_steps("s", "inter", 5, 50)
part("flag_win", f"SELECT * FROM ev WHERE {WINDOW}")
part("flag_bus", "SELECT * FROM flag_win WHERE business_type = 'O'")
part("flag_known", "SELECT * FROM flag_bus WHERE listing_id IN (SELECT listing_id_numeric FROM known)")
part("flag_type", "SELECT * FROM flag_known WHERE event_type IN ('AF', 'AO', 'NF', 'NO', 'RF')")
part(
    "flag_int",
    """SELECT session_id AS user_id, listing_id AS item_id, CAST(epoch(event_ts) AS BIGINT) AS timestamp,
    event_ts, event_id FROM flag_type""",
)
session_steps("f", "flag_int", 5, 6)
part("ses", "SELECT * FROM s_fin")


def split_of(table: str) -> str:
    return f"""SELECT * EXCLUDE (rn, n), CASE WHEN rn = 1 AND n >= 2 THEN 'test'
    WHEN rn = 2 AND n >= 3 THEN 'valid' ELSE 'train' END AS part
    FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n,
    row_number() OVER (PARTITION BY user_id ORDER BY event_ts DESC, event_id DESC) AS rn FROM {table})"""


part("spl", split_of("ses"))
part("train", "SELECT * FROM spl WHERE part = 'train'")
part("hist", "SELECT * FROM spl WHERE part <> 'test'")
part("target", "SELECT user_id, item_id FROM spl WHERE part = 'test'")
part("vtarget", "SELECT user_id, item_id FROM spl WHERE part = 'valid'")


# ---- listings and events -------------------------------------------------------------

oracle(
    "clean_listings",
    """SELECT source_order, version, price, usable_areas, total_areas, bedrooms, bathrooms,
    strftime(created_at, '%Y-%m-%d') AS dt, CAST(epoch(created_at) AS BIGINT) AS created_at,
    CAST(epoch(updated_at) AS BIGINT) AS updated_at FROM raw_lst""",
)
oracle("geohash_7", f"SELECT listing_id_numeric, {geohash('lat', 'lon', 7)} AS geohash FROM lst")
part(
    "homes",
    """SELECT DISTINCT l_partkey, l_suppkey, lat, lon, CAST(l_suppkey * 7 % 80 - 40 AS DOUBLE) AS lat2,
    CAST(l_suppkey * 13 % 360 - 180 AS DOUBLE) AS lon2
    FROM lineitem JOIN lst ON l_partkey = listing_id_numeric""",
)
part("home_km", geodesic("homes", "lat", "lon", "lat2", "lon2"))
oracle("geodesic_distance", "SELECT l_partkey, l_suppkey, round(km, 6) AS km FROM home_km")
oracle("canonical_id", "SELECT source_order, version, canonical_listing_id FROM raw_can")
oracle(
    "latest_version",
    f"""SELECT l_partkey AS anonymized_listing_id, l_orderkey, {LINE_NUMBER} AS version, l_extendedprice AS price
    FROM lineitem WHERE l_linestatus = 'O' QUALIFY row_number() OVER
    (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, {LINE_NUMBER} DESC) = 1""",
)
oracle(
    "item_id_mapping",
    """SELECT canonical_listing_id, anonymized_listing_id,
    CAST(dense_rank() OVER (ORDER BY canonical_listing_id) AS INT) AS listing_id_numeric
    FROM (SELECT * FROM raw_can WHERE active QUALIFY row_number() OVER (PARTITION BY anonymized_listing_id
    ORDER BY updated_at DESC NULLS LAST, source_order DESC, version DESC) = 1)""",
)
oracle(
    "item_lookup",
    """SELECT listing_id_numeric, anonymized_listing_id, lat, lon
    FROM (SELECT *, CAST(dense_rank() OVER (ORDER BY canonical_listing_id) AS INT) AS listing_id_numeric
      FROM (SELECT * FROM raw_can WHERE active QUALIFY row_number() OVER (PARTITION BY anonymized_listing_id
      ORDER BY updated_at DESC NULLS LAST, source_order DESC, version DESC) = 1))
    QUALIFY row_number() OVER (PARTITION BY listing_id_numeric ORDER BY updated_at DESC NULLS LAST, anonymized_listing_id) = 1""",
)
oracle(
    "clean_events",
    """SELECT anonymized_session_id, event_id, anonymized_user_id, anonymized_anonymous_id, event_ms FROM raw_ev""",
)
oracle(
    "attach_items",
    """SELECT anonymized_session_id, event_id, anonymized_listing_id, listing_id_numeric
    FROM raw_ev JOIN known ON l_partkey = listing_id_numeric""",
)
oracle("resolve_identities", "SELECT anonymous_id, id FROM ident")
oracle(
    "resolve_identities_mode",
    """SELECT anonymized_anonymous_id AS anonymous_id,
    arg_min(anonymized_user_id, (-n, anonymized_user_id)) FILTER (anonymized_user_id IS NOT NULL) AS id
    FROM (SELECT anonymized_anonymous_id, anonymized_user_id, count(*) AS n FROM raw_ev GROUP BY 1, 2)
    GROUP BY 1 HAVING count(anonymized_user_id) <= 7""",
)
oracle(
    "identity_counts",
    """SELECT anonymized_anonymous_id AS anonymous_id,
    coalesce(string_agg(anonymized_user_id || ':' || n, ',' ORDER BY anonymized_user_id)
      FILTER (anonymized_user_id IS NOT NULL), '') AS user_counts
    FROM (SELECT anonymized_anonymous_id, anonymized_user_id, count(*) AS n FROM raw_ev GROUP BY 1, 2)
    GROUP BY 1 HAVING count(anonymized_user_id) <= 7""",
)
oracle("apply_identities", "SELECT * FROM resolved")
oracle(
    "numeric_keys",
    """SELECT anonymized_session_id, event_id, 'U_' || u AS user_logged_numeric_id,
    'A_' || a AS anonymous_numeric_id, 'S_' || s AS session_numeric_id,
    coalesce('U_' || u, 'A_' || a) AS unique_user_id
    FROM (SELECT *, CASE WHEN user_id IS NOT NULL THEN dense_rank() OVER (ORDER BY user_id NULLS LAST) END AS u,
    CASE WHEN anonymous_id IS NOT NULL THEN dense_rank() OVER (ORDER BY anonymous_id NULLS LAST) END AS a,
    dense_rank() OVER (ORDER BY anonymized_session_id) AS s FROM resolved)""",
)
oracle(
    "dense_key",
    """SELECT l_partkey, l_returnflag, row_number() OVER (ORDER BY l_partkey, l_returnflag) AS key
    FROM (SELECT DISTINCT l_partkey, l_returnflag FROM lineitem)""",
)

# ---- session operators ---------------------------------------------------------------

EVENT = "session_id, listing_id, event_id, event_type, strftime(dt, '%Y-%m-%d') AS dt"
SHORT = "user_id, item_id, timestamp, event_id"
oracle("interaction_events", f"SELECT {EVENT} FROM ev WHERE event_type IN ('AF', 'AO', 'NF', 'NO', 'RF')")
oracle("load_window", f"SELECT {EVENT} FROM flag_bus")
oracle("window_of_days", f"SELECT {EVENT} FROM flag_bus")
oracle(
    "known_items",
    f"SELECT {EVENT} FROM ev WHERE listing_id IN (SELECT listing_id_numeric FROM known WHERE state <> 'NATION_3')",
)
oracle(
    "dedup_consecutive",
    """SELECT user_id, item_id, timestamp, event_id FROM (SELECT session_id AS user_id,
    supplier_id % 10 AS item_id, seconds AS timestamp, event_id,
    lag(supplier_id % 10) OVER (PARTITION BY session_id ORDER BY event_ts, event_id) AS prev FROM li)
    WHERE prev IS NULL OR prev <> item_id""",
)
oracle(
    "session_length_filter",
    f"""SELECT {SHORT} FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS sz,
    row_number() OVER (PARTITION BY user_id ORDER BY event_ts DESC, event_id DESC) AS rn FROM inter)
    WHERE sz >= 2 AND rn <= 6""",
)
oracle(
    "rare_item_filter",
    f"""SELECT {SHORT} FROM inter WHERE item_id IN
    (SELECT item_id FROM inter GROUP BY item_id HAVING count(*) >= 20)""",
)
ORACLE["stable_core"] = f"""WITH RECURSIVE {sql("SELECT * FROM inter").removeprefix("WITH ").rpartition("SELECT * FROM inter")[0]},
    peeled AS (
        SELECT 0 AS step, {SHORT} FROM inter WHERE user_id IS NOT NULL AND item_id IS NOT NULL
        UNION ALL
        SELECT step, {SHORT} FROM (
            SELECT *, count(*) FILTER (NOT fits) OVER () AS gone FROM (
                SELECT step + 1 AS step, {SHORT},
                       count(*) OVER (PARTITION BY user_id) >= 2 AND count(*) OVER (PARTITION BY item_id) >= 20 AS fits
                FROM peeled))
        WHERE fits AND gone > 0
    ), final AS (
        SELECT {SHORT}, count(*) OVER (PARTITION BY user_id) >= 2 AND count(*) OVER (PARTITION BY item_id) >= 20 AS fits
        FROM peeled WHERE step = (SELECT max(step) FROM peeled)
    )
SELECT {SHORT} FROM final WHERE fits"""
oracle("build_sessions", "SELECT user_id, item_id, timestamp FROM f_fin")


def funnel() -> str:
    steps = [
        ("window", "flag_win", "session_id", "listing_id"),
        ("business", "flag_bus", "session_id", "listing_id"),
        ("known_items", "flag_known", "session_id", "listing_id"),
        ("event_types", "flag_type", "session_id", "listing_id"),
        ("repeats", "f_rep", "user_id", "item_id"),
        ("length", "f_len", "user_id", "item_id"),
        ("support", "f_sup", "user_id", "item_id"),
        ("final_length", "f_fin", "user_id", "item_id"),
    ]
    union = " UNION ALL ".join(
        f"""SELECT {i} AS step, '{n}' AS name, count(*) AS rows, count(DISTINCT {u}) AS sessions,
        count(DISTINCT {v}) AS items FROM {t}"""
        for i, (n, t, u, v) in enumerate(steps)
    )
    shares = ", ".join(
        f"round(CAST({c} AS DOUBLE) / lag({c}) OVER (ORDER BY step), 6) AS {c}_share"
        for c in ("rows", "sessions", "items")
    )
    return f"SELECT step, name, rows, sessions, items, {shares} FROM ({union})"


oracle("session_funnel", funnel())
oracle(
    "export_inter_rows",
    """SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(item_id AS VARCHAR) AS item_id,
    timestamp || '.0' AS timestamp FROM ses""",
)
oracle(
    "browse_sessions",
    """SELECT user_id AS session_id, CAST(item_id AS INT) AS item_id,
    strftime(event_ts, '%Y-%m-%d %H:%M:%S') AS timestamp, user_id FROM ses""",
)
oracle(
    "dataset_stats",
    """SELECT count(*) AS interactions, count(DISTINCT user_id) AS sessions,
    count(DISTINCT item_id) AS items FROM ses""",
)

# ---- statistics and clusters ---------------------------------------------------------

part(
    "stat",
    """SELECT session_id, CAST(epoch(min(event_ts)) AS BIGINT) AS first_event,
    CAST(epoch(max(event_ts)) AS BIGINT) AS last_event, count(event_id) AS n_events,
    count(DISTINCT listing_id) AS n_items, bool_and(user_id IS NULL) AS is_anonymous,
    CAST(epoch(max(event_ts)) - epoch(min(event_ts)) AS DOUBLE) AS duration_seconds
    FROM ev GROUP BY session_id""",
)
oracle("session_stats", "SELECT * FROM stat")
part(
    "typed",
    """SELECT n_events, CASE WHEN is_anonymous THEN 'anonymous' ELSE 'logged' END AS user_type FROM stat""",
)
oracle(
    "session_percentiles",
    """SELECT user_type, count(*) AS count, round(avg(n_events), 6) AS mean,
    round(stddev_samp(n_events), 6) AS std, min(n_events) AS min,
    """
    + ", ".join(
        f"round(quantile_cont(CAST(n_events AS DOUBLE), {p / 100}), 6) AS p{p}" for p in (25, 50, 75, 90, 99)
    )
    + """, max(n_events) AS max
    FROM (SELECT * FROM typed UNION ALL SELECT n_events, 'all' FROM typed) GROUP BY user_type""",
)
part("timed", "SELECT duration_seconds AS v, CASE WHEN is_anonymous THEN 'anonymous' ELSE 'logged' END AS user_type FROM stat")
oracle(
    "duration_percentiles",
    """SELECT user_type, count(*) AS count, round(avg(v), 3) AS mean, round(stddev_samp(v), 3) AS std, min(v) AS min,
    """
    + ", ".join(f"round(quantile_cont(v, {p / 100}), 3) AS p{p}" for p in (25, 50, 75, 90, 99))
    + """, max(v) AS max FROM (SELECT * FROM timed UNION ALL SELECT v, 'all' FROM timed) GROUP BY user_type""",
)
oracle(
    "user_type_counts",
    """SELECT user_type, count(*) AS sessions,
    count(*) FILTER (n_events BETWEEN 2 AND 6) AS sessions_in_band FROM typed GROUP BY user_type""",
)
oracle(
    "session_cdf",
    """SELECT "group", value, n, round(c, 6) AS cdf, CASE WHEN c >= 0.9e0 THEN 0.9e0 WHEN c >= 0.75e0 THEN 0.75e0
    WHEN c >= 0.5e0 THEN 0.5e0 WHEN c >= 0.25e0 THEN 0.25e0 END AS level
    FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY "group" ORDER BY value) AS DOUBLE)
      / sum(n) OVER (PARTITION BY "group") AS c
    FROM (SELECT user_type AS "group", n_events AS value, count(*) AS n FROM typed WHERE n_events <= 8 GROUP BY 1, 2))""",
)
part(
    "sizes",
    """SELECT canonical_listing_id, count(anonymized_listing_id) AS num_listings,
    count(DISTINCT anonymized_listing_id) AS distinct_listings FROM can GROUP BY 1""",
)
oracle(
    "cluster_bands",
    """SELECT CASE WHEN num_listings = 1 THEN '1 (Singleton)' WHEN num_listings <= 5 THEN '2-5 (Pequeno)'
    WHEN num_listings <= 10 THEN '6-10 (Médio)' WHEN num_listings <= 50 THEN '11-50 (Grande)'
    ELSE '50+ (Muito Grande)' END AS cluster_size_range, count(*) AS count FROM sizes GROUP BY 1""",
)
oracle(
    "cluster_stats",
    """SELECT count(*) AS count, round(avg(num_listings), 6) AS mean, round(stddev_samp(num_listings), 6) AS stddev,
    min(num_listings) AS min, max(num_listings) AS max FROM sizes""",
)
oracle("cluster_top", "SELECT * FROM sizes ORDER BY num_listings DESC, canonical_listing_id LIMIT 10")
oracle(
    "sparsity",
    """SELECT original_ids, canonical_ids,
    round((original_ids - canonical_ids) * 100e0 / original_ids, 6) AS reduction_pct
    FROM (SELECT count(DISTINCT anonymized_listing_id) AS original_ids,
    count(DISTINCT canonical_listing_id) AS canonical_ids FROM can)""",
)
oracle(
    "interactions_per_id",
    """SELECT 'original' AS level, round(avg(n), 6) AS mean_interactions
    FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_partkey)
    UNION ALL SELECT 'canonical', round(avg(n), 6) FROM (SELECT count(*) AS n
    FROM lineitem LEFT JOIN can ON l_partkey = anonymized_listing_id GROUP BY canonical_listing_id)""",
)
part(
    "spread",
    """SELECT *, price_stddev / avg_price AS price_cv FROM (SELECT canonical_listing_id,
    count(*) AS num_listings, stddev_samp(price) AS price_stddev, avg(price) AS avg_price,
    min(price) AS min_price, max(price) AS max_price FROM can GROUP BY 1) WHERE num_listings > 1""",
)
SPREAD = """canonical_listing_id, num_listings, round(price_stddev, 6) AS price_stddev,
    round(avg_price, 6) AS avg_price, round(min_price, 6) AS min_price, round(max_price, 6) AS max_price, round(price_cv, 6) AS price_cv"""
oracle(
    "cluster_cv_high",
    f"SELECT {SPREAD} FROM spread WHERE spread.price_cv > 0.3 ORDER BY spread.price_cv DESC, canonical_listing_id LIMIT 10",
)
oracle(
    "cluster_cv_low",
    f"SELECT {SPREAD} FROM spread WHERE spread.price_cv < 0.1 ORDER BY spread.price_cv, canonical_listing_id LIMIT 10",
)
oracle(
    "cluster_sample",
    f"""SELECT canonical_listing_id, cluster_size, anonymized_listing_id, round(price, 6) AS price
    FROM can JOIN (SELECT canonical_listing_id, count(*) AS cluster_size FROM can GROUP BY 1
    HAVING count(*) BETWEEN 2 AND 10 AND {draw('canonical_listing_id')} / 4294967296e0 < 0.1
    ORDER BY {draw('canonical_listing_id')}, canonical_listing_id LIMIT 5) USING (canonical_listing_id)""",
)

# ---- browsing ------------------------------------------------------------------------

part(
    "summary",
    """SELECT user_id AS session_id, user_id, min(timestamp) AS first_event, max(timestamp) AS last_event,
    count(*) AS event_count, arg_min(item_id, (timestamp, event_id)) AS first_item FROM ses GROUP BY user_id""",
)
oracle(
    "session_list",
    """SELECT session_id, user_id, state, city, event_count, first_event, last_event, 2 AS page,
    (SELECT count(*) FROM summary) AS total_sessions,
    CAST((SELECT ceil(count(*) / 50e0) FROM summary) AS INT) AS total_pages, true AS has_prev,
    (SELECT count(*) FROM summary) > 100 AS has_next
    FROM (SELECT * FROM summary ORDER BY event_count DESC, session_id LIMIT 50 OFFSET 50)
    LEFT JOIN lst ON first_item = listing_id_numeric""",
)
oracle(
    "session_detail",
    """SELECT user_id AS session_id, CAST(position AS INT) AS position, item_id, timestamp, user_id, event_id, city,
    neighborhood, round(price, 6) AS price, bedrooms, bathrooms, usable_areas
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY timestamp, event_id) AS position FROM ses)
    JOIN lst ON item_id = listing_id_numeric""",
)
oracle(
    "session_center",
    """SELECT user_id AS session_id, round(coalesce(avg(lat), -14.235), 6) AS center_lat,
    round(coalesce(avg(lon), -51.925), 6) AS center_lon, count(lat) AS points
    FROM ses LEFT JOIN lst ON item_id = listing_id_numeric GROUP BY user_id""",
)
oracle(
    "available_items",
    """SELECT listing_id_numeric AS item_id, (SELECT count(*) FROM lst) AS total FROM lst
    ORDER BY 1 LIMIT 100""",
)

# ---- scoring and evaluation ----------------------------------------------------------

part("split_all", split_of("inter"))
oracle("split_loo", "SELECT user_id, item_id, event_id, timestamp, part FROM split_all")
oracle(
    "history_cut",
    f"""SELECT {SHORT} FROM inter QUALIFY row_number() OVER
    (PARTITION BY user_id ORDER BY event_ts DESC, event_id DESC) <= 3""",
)


def drawn(name: str, users: str, catalogue: str, excluded: str, n: int) -> None:
    """n seeded items per user of ``users``, outside ``excluded``; all others if there are fewer."""
    part(f"{name}_cat", f"SELECT item_id, row_number() OVER (ORDER BY item_id) AS pos FROM (SELECT DISTINCT item_id FROM {catalogue})")
    part(
        name,
        f"""SELECT user_id, item_id, CAST(draw AS INT) AS draw FROM (SELECT user_id, item_id, row_number() OVER
        (PARTITION BY user_id ORDER BY j) AS draw FROM (SELECT user_id, item_id, min(j) AS j
        FROM (SELECT user_id, j, {draw('user_id', 'j')} % (SELECT count(*) FROM {name}_cat) + 1 AS pos
          FROM (SELECT DISTINCT user_id FROM {users}), (SELECT unnest(range(0, {2 * n + 1})) AS j)
          UNION ALL
          SELECT user_id, {2 * n + 1} + i AS j, ({draw('user_id', "'walk'")} % size + i * step) % size + 1 AS pos
          FROM (SELECT user_id, size, step, unnest(range(0, least(size, {n} + coalesce(ex, 0)))) AS i
            FROM (SELECT DISTINCT user_id FROM {users})
            LEFT JOIN (SELECT user_id, count(DISTINCT item_id) AS ex FROM {excluded} GROUP BY 1) USING (user_id),
            (SELECT count(*) AS size, CASE WHEN count(*) % 1000003 = 0 THEN 1 ELSE 1000003 END AS step FROM {name}_cat)))
        JOIN {name}_cat USING (pos) GROUP BY user_id, item_id)
        WHERE (user_id, item_id) NOT IN (SELECT user_id, item_id FROM {excluded})) WHERE draw <= {n}""",
    )


part("test_seen", "SELECT user_id, item_id FROM hist UNION SELECT user_id, item_id FROM target")
part("hist_seen", "SELECT DISTINCT user_id, item_id FROM hist")
part("valid_seen", "SELECT user_id, item_id FROM train UNION SELECT user_id, item_id FROM vtarget")
drawn("neg", "target", "spl", "test_seen", 100)
drawn("rnd", "hist", "train", "hist_seen", 20)
drawn("vneg", "vtarget", "spl", "valid_seen", 99)
oracle("negatives_100", "SELECT * FROM neg")


def best(name: str, scores: str, seen: str, k: int) -> None:
    part(
        name,
        f"""SELECT user_id, item_id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER
        (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM {scores}
        WHERE (user_id, item_id) NOT IN (SELECT user_id, item_id FROM {seen})) WHERE rank <= {k}""",
    )


def similarity(name: str, rows: str, k: int, shrink: float) -> None:
    part(f"{name}_x", f"SELECT user_id, item_id, count(*) AS x FROM {rows} GROUP BY ALL")
    part(f"{name}_norm", f"SELECT item_id, CAST(sum(x * x) AS DOUBLE) AS norm FROM {name}_x GROUP BY 1")
    part(
        f"{name}_dot",
        f"""SELECT a.item_id AS item, b.item_id AS neighbour, CAST(sum(a.x * b.x) AS DOUBLE) AS dot
        FROM {name}_x a JOIN {name}_x b USING (user_id) WHERE a.item_id <> b.item_id GROUP BY 1, 2""",
    )
    part(
        name,
        f"""SELECT item, neighbour, sim, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER
        (PARTITION BY item ORDER BY sim DESC, neighbour) AS rank FROM (SELECT item, neighbour,
        dot / (sqrt(a.norm) * sqrt(b.norm) + {shrink}) AS sim FROM {name}_dot
        JOIN {name}_norm a ON item = a.item_id JOIN {name}_norm b ON neighbour = b.item_id)) WHERE rank <= {k}""",
    )


def knn_scores(name: str, sims: str, rows: str) -> None:
    part(
        name,
        f"""SELECT user_id, neighbour AS item_id, round(sum(x * sim), 9) AS score
        FROM (SELECT user_id, item_id, count(*) AS x FROM {rows} GROUP BY ALL) JOIN {sims} ON item_id = item
        GROUP BY 1, 2""",
    )


part("pop", "SELECT item_id, CAST(count(*) AS DOUBLE) AS score FROM train GROUP BY 1")
part("pop_all", "SELECT user_id, item_id, score FROM (SELECT DISTINCT user_id FROM hist), pop")
best("pop_top", "pop_all", "hist", 20)
part("rnd_top", "SELECT user_id, item_id, 1e0 / draw AS score, draw AS rank FROM rnd")
similarity("sim", "train", 100, 0.0)
similarity("sim_shrunk", "train", 100, 10.0)
knn_scores("knn_all", "sim", "hist")
best("knn_top", "knn_all", "hist", 20)
part(
    "move",
    """SELECT item_i, item_j, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY item_i) AS p FROM
    (SELECT lag(item_id) OVER (PARTITION BY user_id ORDER BY event_ts, event_id) AS item_i, item_id AS item_j
    FROM train) WHERE item_i IS NOT NULL GROUP BY 1, 2""",
)
part(
    "move_2",
    """SELECT item_i, item_j, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY item_i) AS p FROM
    (SELECT lag(item_id, 2) OVER (PARTITION BY user_id ORDER BY event_ts, event_id) AS item_i, item_id AS item_j
    FROM train) WHERE item_i IS NOT NULL GROUP BY 1, 2""",
)
part(
    "back",
    """SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY event_ts DESC, event_id DESC) AS lag
    FROM hist""",
)
part(
    "mar_all",
    """SELECT user_id, item_j AS item_id, round(p, 9) AS score FROM back JOIN move ON item_id = item_i WHERE lag = 1""",
)
best("mar_top", "mar_all", "hist", 20)
part(
    "fos_all",
    """SELECT user_id, item_id, round(sum(score), 9) AS score FROM (
    SELECT user_id, item_id, score * pow(len, -0.2) AS score FROM knn_all
      JOIN (SELECT user_id, count(*) AS len FROM hist GROUP BY 1) USING (user_id)
    UNION ALL SELECT user_id, item_j, p FROM back JOIN move ON item_id = item_i WHERE lag = 1
    UNION ALL SELECT user_id, item_j, p / 2 FROM back JOIN move_2 ON item_id = item_i WHERE lag = 2)
    GROUP BY 1, 2""",
)
best("fos_top", "fos_all", "hist", 20)
for key, table in {
    "score_pop": "pop_top",
    "score_random": "rnd_top",
    "score_itemknn": "knn_top",
    "score_markov1": "mar_top",
    "score_fossil_counts": "fos_top",
}.items():
    oracle(key, f"SELECT user_id, item_id, round(score, 6) AS score, rank FROM {table}")
oracle("item_similarity", "SELECT item, neighbour, rank, round(sim, 6) AS sim FROM sim_shrunk")


def ranks(name: str, ranked: str) -> None:
    part(name, f"SELECT user_id, item_id, rank FROM target LEFT JOIN {ranked} USING (user_id, item_id)")


part("cand", "SELECT user_id, item_id FROM target UNION ALL SELECT user_id, item_id FROM neg")
part("none", "SELECT 0 AS user_id, 0 AS item_id WHERE false")
part("pop_cand", "SELECT user_id, item_id, score FROM cand JOIN pop USING (item_id)")
best("pop_drawn", "pop_cand", "none", 20)
part("knn_cand", "SELECT * FROM knn_all WHERE (user_id, item_id) IN (SELECT user_id, item_id FROM cand)")
best("knn_drawn", "knn_cand", "none", 20)
for model in ("pop", "rnd", "knn", "mar"):
    ranks(f"{model}_rank", f"{model}_top")
ranks("pop_drawn_rank", "pop_drawn")
ranks("knn_drawn_rank", "knn_drawn")
oracle("eval_full", "SELECT * FROM knn_rank")
oracle("eval_uni100", "SELECT * FROM pop_drawn_rank")


def single_metrics(table: str) -> str:
    forms = {
        "recall": "CASE WHEN rank <= k THEN 1e0 ELSE 0e0 END",
        "mrr": "CASE WHEN rank <= k THEN 1e0 / rank ELSE 0e0 END",
        "ndcg": "CASE WHEN rank <= k THEN 1e0 / log2(rank + 1) ELSE 0e0 END",
        "hit": "CASE WHEN rank <= k THEN 1e0 ELSE 0e0 END",
    }
    return " UNION ALL ".join(
        f"""SELECT '{m}' AS metric, k, round(avg({e}), 6) AS value
        FROM {table}, (SELECT unnest([5, 10, 20]) AS k) GROUP BY k"""
        for m, e in forms.items()
    )


part(
    "many",
    """SELECT l_orderkey AS user_id, CASE WHEN l_partkey % 5 <> 0 THEN l_partkey % 23 + 1 END AS rank FROM lineitem""",
)
part(
    "many_k",
    """SELECT user_id, k, count(*) AS n, count(*) FILTER (rank <= k) AS hits, min(rank) FILTER (rank <= k) AS first,
    coalesce(sum(1e0 / log2(rank + 1)) FILTER (rank <= k), 0) AS gain
    FROM many, (SELECT unnest([5, 10, 20]) AS k) GROUP BY 1, 2""",
)
oracle(
    "metrics_at_k",
    " UNION ALL ".join(
        f"SELECT '{m}' AS metric, k, round(avg({e}), 6) AS value FROM many_k GROUP BY k"
        for m, e in {
            "recall": "CAST(hits AS DOUBLE) / n",
            "mrr": "coalesce(1e0 / first, 0e0)",
            "ndcg": """gain / (SELECT sum(1e0 / log2(i + 1)) FROM (SELECT unnest(range(1, 21)) AS i)
                       WHERE i <= least(n, k))""",
            "hit": "CASE WHEN hits > 0 THEN 1e0 ELSE 0e0 END",
        }.items()
    ),
)


def measured(model: str, protocol: str, table: str) -> str:
    return f"""SELECT '{model}' AS model, 'sessions' AS dataset, '{protocol}' AS protocol, metric, k, value
    FROM ({single_metrics(table)})"""


oracle("eval_pop", measured("Pop", "full", "pop_rank"))
oracle("eval_itemknn", measured("ItemKNN", "uni100", "knn_drawn_rank"))
oracle(
    "benchmark_models",
    "SELECT *, 'finished' AS status, CAST(NULL AS VARCHAR) AS error FROM ("
    + " UNION ALL ".join(
        measured(m, "full", t)
        for m, t in {"Pop": "pop_rank", "Random": "rnd_rank", "ItemKNN": "knn_rank", "Markov": "mar_rank"}.items()
    )
    + ")",
)

part("grid_shrink", "SELECT unnest([" + ", ".join(f"{s}e0" for s in GRID_SHRINK) + "]) AS shrink")
part("grid_k", "SELECT unnest([" + ", ".join(str(k) for k in GRID_K) + "]) AS k")
part(
    "grid_sim",
    """SELECT *, row_number() OVER (PARTITION BY shrink, item ORDER BY sim DESC, neighbour) AS place
    FROM (SELECT item, neighbour, shrink, dot / (sqrt(a.norm) * sqrt(b.norm) + shrink) AS sim FROM sim_dot
    JOIN sim_norm a ON item = a.item_id JOIN sim_norm b ON neighbour = b.item_id, grid_shrink)""",
)
part(
    "grid_score",
    """SELECT c.user_id, c.item_id, hit, shrink, k, round(sum(x * sim), 9) AS score
    FROM (SELECT user_id, item_id, true AS hit FROM vtarget UNION ALL SELECT user_id, item_id, false FROM vneg) c
    JOIN sim_x h ON c.user_id = h.user_id JOIN grid_sim g ON h.item_id = item AND c.item_id = neighbour
    JOIN grid_k ON place <= k GROUP BY 1, 2, 3, 4, 5""",
)
oracle(
    "tune_itemknn",
    """SELECT k, shrink, round(coalesce(s, 0) / (SELECT count(*) FROM vtarget), 6) AS mrr
    FROM grid_k CROSS JOIN grid_shrink LEFT JOIN (SELECT k, shrink, sum(1e0 / rank) AS s FROM
    (SELECT *, row_number() OVER (PARTITION BY user_id, shrink, k ORDER BY score DESC, item_id) AS rank FROM grid_score)
    WHERE hit AND rank <= 10 GROUP BY 1, 2) USING (k, shrink)""",
)

# ---- recommendations -----------------------------------------------------------------

similarity("asim", "ses", 100, 0.0)
knn_scores("rec_all", "asim", "ses")
best("rec_best", "rec_all", "ses", 10)
part(
    "rec",
    """SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS INT) AS rank,
    item_id, score FROM rec_best WHERE item_id IN (SELECT listing_id_numeric FROM known)""",
)
oracle("recommend_topk", "SELECT user_id, rank, item_id, round(score, 6) AS score FROM rec")
part("rec_listed", "SELECT * FROM rec_all WHERE item_id IN (SELECT listing_id_numeric FROM known)")
best("rec_full", "rec_listed", "ses", 10)
oracle("recommend_refill", "SELECT user_id, rank, item_id, round(score, 6) AS score FROM rec_full")
part("loc", "SELECT * FROM lst WHERE lat IS NOT NULL AND lon IS NOT NULL")
part(
    "pair_in",
    """SELECT s.user_id, s.item_id, s.views, s.first_ts, s.first_id, r.rank, r.item_id AS rec_item, a.lat AS lat1,
    a.lon AS lon1, b.lat AS lat2, b.lon AS lon2
    FROM (SELECT user_id, item_id, count(*) AS views, min((event_ts, event_id)) AS first_seen,
      min(event_ts) AS first_ts, arg_min(event_id, (event_ts, event_id)) AS first_id
      FROM ses GROUP BY 1, 2) s
    JOIN loc a ON s.item_id = a.listing_id_numeric JOIN rec r USING (user_id)
    JOIN loc b ON r.item_id = b.listing_id_numeric""",
)
part("pair", geodesic("pair_in", "lat1", "lon1", "lat2", "lon2"))
part(
    "near",
    """SELECT user_id, rank, item_id, score, avg_distance_km, min_distance_km, closest_item
    FROM rec LEFT JOIN (SELECT user_id, rank, sum(km * views) / sum(views) AS avg_distance_km,
    min(km) AS min_distance_km, arg_min(item_id, (round(km, 6), first_ts, first_id)) AS closest_item
    FROM pair GROUP BY 1, 2) USING (user_id, rank)""",
)
oracle(
    "rec_distance",
    """SELECT user_id, rank, item_id, round(score, 6) AS score, round(avg_distance_km, 6) AS avg_distance_km,
    round(min_distance_km, 6) AS min_distance_km, closest_item FROM near""",
)


def compared() -> str:
    numeric = ("price", "usable_areas", "bedrooms", "bathrooms", "parking_spaces", "suites")
    text = ("city", "neighborhood", "unit_type", "state")
    rows = [
        f"""SELECT user_id, rank, item1, item2, '{c}' AS feature, CAST(a.{c} AS DOUBLE) AS value1,
        CAST(b.{c} AS DOUBLE) AS value2, CAST(NULL AS VARCHAR) AS text1, CAST(NULL AS VARCHAR) AS text2,
        CAST(NULL AS BOOLEAN) AS match FROM both_items WHERE a.{c} IS NOT NULL AND b.{c} IS NOT NULL"""
        for c in numeric
    ] + [
        f"""SELECT user_id, rank, item1, item2, '{c}', NULL, NULL, a.{c}, b.{c},
        a.{c} IS NOT DISTINCT FROM b.{c} FROM both_items"""
        for c in text
    ]
    return f"""SELECT user_id, rank, item1, item2, feature, round(value1, 6) AS value1, round(value2, 6) AS value2,
    round(value2 - value1, 6) AS diff, round(CASE WHEN value1 = 0 THEN 0e0 ELSE (value2 - value1) / value1 * 100 END, 6)
    AS pct_diff, text1, text2, match FROM ({' UNION ALL '.join(rows)})"""


part(
    "both_items",
    """SELECT user_id, rank, closest_item AS item1, item_id AS item2, a, b FROM near
    JOIN lst a ON closest_item = a.listing_id_numeric JOIN lst b ON item_id = b.listing_id_numeric""",
)
oracle("feature_compare", compared())
part(
    "side",
    """SELECT user_id, item_id, false AS is_rec FROM ses UNION ALL SELECT user_id, item_id, true FROM rec""",
)
FIELDS = ("price", "bedrooms", "bathrooms", "parking_spaces", "usable_areas")
part(
    "side_long",
    " UNION ALL ".join(
        f"""SELECT user_id, is_rec, '{c}' AS feature, CAST({c} AS DOUBLE) AS v
        FROM side JOIN lst ON item_id = listing_id_numeric WHERE {c} IS NOT NULL"""
        for c in FIELDS
    ),
)
oracle(
    "session_vs_recs",
    """SELECT user_id, feature, round(sm, 6) AS session_mean, round(ss, 6) AS session_std, round(rm, 6) AS rec_mean,
    round(rs, 6) AS rec_std, round((rm - sm) / nullif(sm, 0) * 100, 6) AS diff_pct
    FROM (SELECT user_id, feature, avg(v) FILTER (NOT is_rec) AS sm, stddev_pop(v) FILTER (NOT is_rec) AS ss,
    avg(v) FILTER (is_rec) AS rm, stddev_pop(v) FILTER (is_rec) AS rs FROM side_long GROUP BY 1, 2)
    WHERE sm IS NOT NULL AND rm IS NOT NULL""",
)
part(
    "city_count",
    """SELECT * FROM (SELECT user_id, is_rec, city, count(*) AS n FROM side
    JOIN lst ON item_id = listing_id_numeric WHERE city IS NOT NULL GROUP BY 1, 2, 3)
    QUALIFY row_number() OVER (PARTITION BY user_id, is_rec ORDER BY n DESC, city) = 1""",
)
oracle(
    "top_city",
    """SELECT s.user_id, s.city AS session_city, s.n AS session_count, r.city AS rec_city, r.n AS rec_count
    FROM city_count s JOIN city_count r ON s.user_id = r.user_id AND NOT s.is_rec AND r.is_rec""",
)


def links(value: str, k: int, top: int | None) -> str:
    limited = "pair" if top is None else (
        f"""(SELECT * FROM pair WHERE (user_id, rank) IN (SELECT user_id, rank FROM (SELECT user_id, rank,
        row_number() OVER (PARTITION BY user_id ORDER BY rank) AS n FROM rec
        WHERE item_id IN (SELECT listing_id_numeric FROM loc)) WHERE n <= {top}))"""
    )
    return f"""SELECT user_id, item_id, views, CAST(link AS INT) AS link, rank, rec_item, round(distance, 6) AS distance
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY round(distance, 6), rank) AS link
    FROM (SELECT *, {value} AS distance FROM {limited})) WHERE link <= {k}"""


oracle("nearest_links", links("km", 3, 5))
oracle("nearest_links_planar", links("sqrt(pow(lat1 - lat2, 2) + pow(lon1 - lon2, 2))", 1, None))

ATTRIBUTES = "lat, lon, city, neighborhood, price, bedrooms, bathrooms, usable_areas, unit_type"
part(
    "points",
    f"""SELECT user_id, 'session' AS kind, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_ts, event_id)
      AS INT) AS place, item_id, {ATTRIBUTES}, CAST(NULL AS DOUBLE) AS score, CAST(NULL AS VARCHAR) AS tier,
      CAST(NULL AS VARCHAR) AS page_tier, CAST(NULL AS DOUBLE) AS size, CAST(NULL AS DOUBLE) AS radius,
      CAST(NULL AS DOUBLE) AS min_distance_km FROM ses JOIN loc ON item_id = listing_id_numeric
    UNION ALL SELECT user_id, 'recommendation', rank, item_id, {ATTRIBUTES}, score,
      CASE WHEN rank <= 3 THEN 'red' WHEN rank <= 5 THEN 'orange' ELSE 'lightred' END,
      CASE WHEN rank <= 3 THEN 'green' WHEN rank <= 6 THEN 'orange' ELSE 'red' END,
      100e0 + 500e0 * (score / max(score) OVER (PARTITION BY user_id)), 15e0 - (rank - 1) * 0.5e0, min_distance_km
    FROM near JOIN loc ON item_id = listing_id_numeric""",
)
oracle(
    "map_points",
    """SELECT user_id, kind, place, item_id, round(lat, 6) AS lat, round(lon, 6) AS lon, city, neighborhood,
    round(price, 6) AS price, bedrooms, bathrooms, usable_areas, unit_type, round(score, 6) AS score, tier, page_tier,
    round(size, 6) AS size, radius, round(min_distance_km, 6) AS min_distance_km,
    round(avg(lat) OVER (PARTITION BY user_id), 6) AS center_lat,
    round(avg(lon) OVER (PARTITION BY user_id), 6) AS center_lon FROM points""",
)

# ---- benchmark runs ------------------------------------------------------------------

part(
    "bench",
    """SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'Eval_' ELSE '' END || o_orderpriority || '_' ||
    strftime(o_orderdate, '%Y%m%d') || '_' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS run_name,
    'r' || o_orderkey AS run_id, o_orderstatus AS state, o_orderpriority AS model,
    CASE WHEN o_custkey % 40 <> 39 THEN 'd' || o_custkey % 40 END AS dataset, o_orderkey % 3 = 0 AS is_eval,
    m AS "test_mrr@10", round(m * 2, 6) AS "test_hit@5", round(m * o_custkey / 100000, 6) AS "test_hit@10"
    FROM (SELECT *, CASE WHEN o_orderkey % 7 <> 0 THEN round(o_totalprice / 1000000, 6) END AS m FROM orders)""",
)
part(
    "merged",
    """SELECT model, dataset, run_name, run_id, state, is_eval, "test_mrr@10", "test_hit@5", "test_hit@10",
    eval_run_name, eval_run_id, train_run_name, train_run_id
    FROM (SELECT *, row_number() OVER (PARTITION BY model, dataset ORDER BY is_eval DESC, run_name DESC) AS rn,
    max(run_name) FILTER (is_eval) OVER w AS eval_run_name,
    arg_max(run_id, run_name) FILTER (is_eval) OVER w AS eval_run_id,
    max(run_name) FILTER (NOT is_eval) OVER w AS train_run_name,
    arg_max(run_id, run_name) FILTER (NOT is_eval) OVER w AS train_run_id
    FROM bench WINDOW w AS (PARTITION BY model, dataset)) WHERE rn = 1""",
)
oracle("merge_runs", "SELECT * FROM merged")
oracle("rank_models", 'SELECT model, dataset, run_name, "test_mrr@10" FROM merged')


def melted(table: str) -> str:
    return " UNION ALL ".join(
        f"SELECT model, '{c}' AS name, '{m}' AS metric, {k} AS topk, \"{c}\" AS value FROM {table}"
        for c, m, k in (("test_mrr@10", "mrr", 10), ("test_hit@5", "hit", 5), ("test_hit@10", "hit", 10))
    )


oracle(
    "rank_models_by_k",
    f"""SELECT metric, topk, CAST(row_number() OVER (PARTITION BY metric, topk ORDER BY v DESC NULLS LAST, model) AS INT)
    AS rank, model, round(v, 12) AS value
    FROM (SELECT metric, topk, model, avg(value) AS v FROM ({melted('merged')}) GROUP BY 1, 2, 3)""",
)
oracle(
    "metric_means",
    """SELECT model, round(avg("test_mrr@10"), 12) AS "test_mrr@10", round(avg("test_hit@5"), 12) AS "test_hit@5",
    round(avg("test_hit@10"), 12) AS "test_hit@10" FROM merged GROUP BY model""",
)
for name, source in (("metric_quartiles", "bench"), ("metric_quartiles_merged", "merged")):
    oracle(
        name,
        f"""SELECT name AS metric, count(*) AS n, {', '.join(
            f'round(quantile_cont(value, {p / 100}), 6) AS p{p}' for p in (0, 25, 50, 75, 100))}
        FROM ({melted(source)}) WHERE value IS NOT NULL GROUP BY name""",
    )
