import gzip
import math
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sessionloom.functions import geo, labels
from sessionloom.operators import clusters, events, keys, listings, stats
from sessionloom.plans import dataset, raw, report
from sessionloom.sources import readers, writers
from sessionloom.sources.scratch import scratch_folder
from tests.conftest import rows


def bisected(lat, lon, precision):
    """Textbook geohash by halving intervals."""
    spans, text, even, bits = [[-180.0, 180.0], [-90.0, 90.0]], "", True, []
    while len(bits) < 5 * precision:
        span, value = (spans[0], lon) if even else (spans[1], lat)
        mid = sum(span) / 2
        bits.append(value > mid)
        span[0 if value > mid else 1] = mid
        even = not even
    for i in range(0, len(bits), 5):
        text += geo.GEOHASH_ALPHABET[int("".join("01"[b] for b in bits[i : i + 5]), 2)]
    return text


def test_geohash_equals_bisection(spark):
    rng = random.Random(3)
    points = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(2000)]
    points += [(0.0, 0.0), (90.0, 180.0), (-90.0, -180.0), (45.0, -90.0), (-22.5, -56.25)]
    df = spark.createDataFrame(points, "lat double, lon double")
    for precision in (1, 2, 7):
        for r in geo.with_geohash(df, "g", F.col("lat"), F.col("lon"), precision).collect():
            assert r.g == bisected(r.lat, r.lon, precision)
    gap = spark.createDataFrame([(None, 1.0), (1.0, None)], "lat double, lon double")
    coded = geo.with_geohash(gap, "g", F.col("lat"), F.col("lon"))
    assert [r.g for r in coded.collect()] == [None, None]


def vincenty(lat1, lon1, lat2, lon2):
    a, f = geo.WGS84_RADIUS_KM, geo.WGS84_FLATTENING
    b = a * (1 - f)
    u1, u2 = (math.atan((1 - f) * math.tan(math.radians(v))) for v in (lat1, lat2))
    length = lam = math.radians(lon2 - lon1)
    for _ in range(200):
        x = math.cos(u2) * math.sin(lam)
        y = math.cos(u1) * math.sin(u2) - math.sin(u1) * math.cos(u2) * math.cos(lam)
        sin_s = math.hypot(x, y)
        if sin_s == 0:
            return 0.0
        cos_s = math.sin(u1) * math.sin(u2) + math.cos(u1) * math.cos(u2) * math.cos(lam)
        sigma = math.atan2(sin_s, cos_s)
        sin_a = math.cos(u1) * math.cos(u2) * math.sin(lam) / sin_s
        c2a = 1 - sin_a**2
        cm = cos_s - 2 * math.sin(u1) * math.sin(u2) / c2a if c2a else 0.0
        c = f / 16 * c2a * (4 + f * (4 - 3 * c2a))
        old, lam = lam, length + (1 - c) * f * sin_a * (sigma + c * sin_s * (cm + c * cos_s * (2 * cm**2 - 1)))
        if abs(lam - old) < 1e-13:
            break
    k = c2a * (a**2 - b**2) / b**2
    big = 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k)))
    small = k / 1024 * (256 + k * (-128 + k * (74 - 47 * k)))
    d = small * sin_s * (cm + small / 4 * (cos_s * (2 * cm**2 - 1)))
    return b * big * (sigma - d)


def test_geodesic_is_close_to_vincenty(spark):
    rng = random.Random(4)
    data = [(-20.0, -40.0, -20.0, -40.0), (-20.0, -40.0, -20.009, -40.0)]
    data += [(rng.uniform(-34, 5), rng.uniform(-74, -35), rng.uniform(-34, 5), rng.uniform(-74, -35)) for _ in range(500)]
    df = spark.createDataFrame(data, "a double, b double, c double, d double")
    ends = [F.col(c) for c in "abcd"]
    for r in geo.with_geodesic_km(df, "km", *ends).collect():
        true = vincenty(r.a, r.b, r.c, r.d)
        assert abs(r.km - true) <= 3e-6 * max(true, 1e-6)
    gap = spark.createDataFrame([(None, 1.0, 2.0, 3.0)], "a double, b double, c double, d double")
    assert geo.with_geodesic_km(gap, "km", *ends).first().km is None


def test_dirty_listing_values_become_null(spark):
    df = spark.createDataFrame(
        [("R$ 1.200,50", "2.0", "2024-01-05", "x"), ("", "abc", "no", "2024-01-05 10:00:00"), ("1.2.3", "99999999999", None, None)],
        "price string, bedrooms string, dt string, updated_at string",
    )
    got = listings.clean_listings(df).collect()
    assert [r.price for r in got] == [1.2005, None, None]
    assert [r.bedrooms for r in got] == [2, None, None]
    assert [str(r.dt) for r in got] == ["2024-01-05", "None", "None"]
    assert [r.updated_at is None for r in got] == [True, False, True]


def test_canonical_id_fallbacks(spark):
    schema = "lat_region string, lon_region string, zip_code string, usable_areas double, bedrooms int, unit_type string"
    data = [
        ("-20.3", "-40.3", "z1", 58.0, 2, "APARTMENT"),
        ("-20.3", "-40.3", "z2", 51.0, 2, "APARTMENT"),
        (None, "-40.3", "z1", 51.0, 2, "APARTMENT"),
        (None, None, None, None, None, None),
        ("bad", "x", None, None, None, None),
    ]
    got = [r.fingerprint for r in listings.with_fingerprint(spark.createDataFrame(data, schema)).collect()]
    assert got[0] == got[1] and got[0].endswith("|50|2|APARTMENT")
    assert got[2] == "z1|50|2|APARTMENT"
    assert got[3] == got[4] == "UNKNOWN_GEO|-1|0|UNKNOWN"


def test_latest_active_version(spark):
    data = [("a", "ACTIVE", 1, "x"), ("a", "ACTIVE", 2, "x"), ("a", "ACTIVE", 2, "y"), ("a", "INACTIVE", 9, "z"), ("b", "INACTIVE", 1, "x"), ("c", "ACTIVE", None, "q")]
    df = spark.createDataFrame(data, "anonymized_listing_id string, status string, updated_at int, tag string")
    assert rows(listings.latest_active(df), "anonymized_listing_id", "tag") == [("a", "y"), ("c", "q")]


def test_item_numbers_are_shared_by_canonical_id(spark):
    data = [("a", "ACTIVE", 1, "k2"), ("b", "ACTIVE", 1, "k1"), ("c", "ACTIVE", 1, "k2")]
    df = spark.createDataFrame(data, "anonymized_listing_id string, status string, updated_at int, canonical_listing_id string")
    _, mapping = listings.map_item_ids(df)
    assert rows(mapping, "anonymized_listing_id", "listing_id_numeric") == [("a", 2), ("b", 1), ("c", 2)]


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_dense_keys_do_not_depend_on_partitions(spark, parts):
    ids = [f"id{i % 1000:04d}" for i in range(1500)] + [None]
    df = spark.createDataFrame([(i,) for i in ids], "id string").repartition(parts)
    got = {r.id: r.key for r in keys.dense_key(df, "id").collect()}
    assert got == {f"id{i:04d}": i + 1 for i in range(1000)}


def test_dense_key_has_no_single_partition_step(spark):
    df = spark.range(1000).selectExpr("cast(id % 300 as string) as id")
    plan = keys.dense_key(df, "id")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


PAIRS = "anonymized_anonymous_id string, anonymized_user_id string"


def identity_rows(spark):
    data = [("n", "b")] * 9 + [("n", "a")] + [("m", f"u{i}") for i in range(8)] + [("o", None)] * 3 + [(None, "q")]
    return spark.createDataFrame(data, PAIRS)


def test_identity_policies(spark):
    df = identity_rows(spark)
    low = {r.anonymous_id: r.id for r in events.resolve_identities(df).collect()}
    most = {r.anonymous_id: r.id for r in events.resolve_identities(df, policy="most_frequent").collect()}
    assert low == {"n": "a", "o": None, None: "q"}
    assert most == {"n": "b", "o": None, None: "q"}
    with pytest.raises(ValueError):
        events.resolve_identities(df, policy="other")


def test_identity_counts(spark):
    got = {r.anonymous_id: r.user_counts for r in events.identity_counts(identity_rows(spark)).collect()}
    assert got == {"n": {"a": 1, "b": 9}, "o": {}, None: {"q": 1}}


def test_identities_fill_missing_users(spark):
    df = spark.createDataFrame(
        [("n", None, "L1", 1), ("n", "x", "L1", 2), (None, None, "L1", 3), ("o", None, "L1", 4), ("n", None, "L9", 5)],
        "anonymized_anonymous_id string, anonymized_user_id string, anonymized_listing_id string, event_id int",
    )
    known = spark.createDataFrame([("L1",)], "anonymized_listing_id string")
    got = events.apply_identities(df, events.resolve_identities(identity_rows(spark)), known)
    assert [tuple(r) for r in got.orderBy("event_id").select("event_id", "user_id").collect()] == [
        (1, "a"), (2, "x"), (3, None), (4, None)
    ]


def test_numeric_keys_prefer_the_user(spark):
    df = spark.createDataFrame(
        [("u2", "a1", "s1"), (None, "a2", "s1"), ("u1", None, "s2"), (None, None, None)],
        "user_id string, anonymous_id string, anonymized_session_id string",
    )
    got = {tuple(r)[-4:] for r in events.numeric_keys(df).collect()}
    assert got == {
        ("U_2", "A_1", "S_1", "U_2"), (None, "A_2", "S_1", "A_2"), ("U_1", None, "S_2", "U_1"), (None, None, None, None)
    }


def test_labels(spark):
    one = spark.range(1)

    def value(c):
        return one.select(c).first()[0]

    assert value(labels.parse_id_list(F.lit("1, 2,,3"))) == [1, 2, 3]
    with pytest.raises(Exception):
        value(labels.parse_id_list(F.lit("1,x")))
    assert [value(labels.cluster_band(F.lit(n))) for n in (1, 5, 6, 50, 51)] == [
        "1 (Singleton)", "2-5 (Pequeno)", "6-10 (Médio)", "11-50 (Grande)", "50+ (Muito Grande)"
    ]
    assert [value(labels.rank_tier(F.lit(n))) for n in (3, 5, 6)] == ["red", "orange", "lightred"]
    assert value(labels.percent_difference(F.lit(0.0), F.lit(5.0))) == 0.0
    assert value(labels.metric_name(F.lit("test_mrr@10"))) == "mrr"
    assert value(labels.metric_cutoff(F.lit("test_mrr@10"))) == 10
    assert value(labels.show_number(F.lit(None).cast("double"), 2)) == "N/A"
    assert value(labels.show_number(F.lit(1.005), 1)) == "1.0"
    assert value(labels.show_timestamp(F.timestamp_seconds(F.lit(0)))) == "1970-01-01 00:00:00"
    assert value(labels.marker_radius(F.lit(3))) == 14.0
    assert value(labels.marker_size(F.lit(1.0), F.lit(2.0))) == 350.0


def test_session_statistics(spark):
    data = [("s", "e1", 1, None, 0), ("s", None, 1, None, 2500), ("t", "e2", 1, None, 0), ("t", "e3", 2, "u", 0)]
    df = spark.createDataFrame(
        data, "session_id string, event_id string, listing_id int, original_user_id string, ms bigint"
    ).withColumn("event_ts", F.timestamp_millis("ms"))
    numbers = stats.session_stats(df)
    assert rows(numbers, "session_id", "n_events", "n_items", "is_anonymous", "duration_seconds") == [
        ("s", 1, 1, True, 2.5), ("t", 2, 2, False, 0.0)
    ]
    described = {r.user_type: r for r in stats.describe_sessions(numbers).collect()}
    assert described["all"]["mean"] == 1.5 and described["all"].p50 == 1.5
    assert described["logged"]["std"] is None
    curve = stats.cdf(numbers).orderBy("value").collect()
    assert [(r.value, r.cdf, r.level) for r in curve] == [(1, 0.5, 0.5), (2, 1.0, 0.9)]


def test_cluster_sample_is_repeatable(spark):
    mapping = spark.range(400).selectExpr("concat('L', id) as anonymized_listing_id", "md5(cast(id div 4 as string)) as canonical_listing_id")
    first, again = (clusters.sample_clusters(mapping, mapping.repartition(n), 3, fraction=0.5) for n in (2, 7))
    assert rows(first, "anonymized_listing_id") == rows(again, "anonymized_listing_id")
    assert first.count() == 12


def write_gz(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    with gzip.open(path, "wt") as f:
        f.write("\n".join(lines) + "\n")


def test_raw_files_to_dataset(spark, tmp_path):
    """CSV in, keyed events, sessions, interaction files and reports out."""
    write_gz(
        tmp_path / "listings" / "part.csv.gz",
        ["anonymized_listing_id,status,updated_at,price,usable_areas,bedrooms,lat_region,lon_region,zip_code,unit_type,city"]
        + [f'l{i},ACTIVE,2024-01-0{1 + i % 3} 00:00:00,"R$ {100 + i}",{20 * i},{i % 3},-20.{i},-40.{i},z{i},APT,"Two\nlines"' for i in range(8)]
        + ["l9,INACTIVE,2024-01-01 00:00:00,1,1,1,-20,-40,z,APT,x"],
    )
    lines = ["event_id,anonymized_user_id,anonymized_anonymous_id,anonymized_session_id,anonymized_listing_id,collector_timestamp,event_type,business_type,dt,browser_family"]
    for s in range(6):
        for i in range(5):
            user = "" if s % 2 else f"user{s}"
            lines.append(f"e{s}{i},{user},anon{s},sess{s},l{(s + i) % 8},{1709510400000 + s * 1000 + i},ListingRendered,SALE,2024-03-0{4 + s % 2},ff")
    lines.append("e99, ,anon1,sess1,l9,1709510400000,ListingRendered,SALE,2024-03-04,ff")
    write_gz(tmp_path / "events" / "part.csv.gz", lines)

    raw.prepare_listings(spark, str(tmp_path / "listings"), str(tmp_path / "l"), str(tmp_path / "m"), partitions=2)
    mapping = spark.read.parquet(str(tmp_path / "m"))
    assert mapping.count() == 8 and "l9" not in {r.anonymized_listing_id for r in mapping.collect()}
    scratch = Path(scratch_folder(spark).removeprefix("file://"))
    before = set(scratch.iterdir())
    raw.prepare_events(spark, str(tmp_path / "events"), str(tmp_path / "m"), str(tmp_path / "e"))
    assert set(scratch.iterdir()) == before  # nothing is left of the job's own tables
    keyed = spark.read.parquet(str(tmp_path / "e"))
    assert keyed.columns[:6] == ["listing_id", "unique_user_id", "session_id", "user_id", "anonymous_id", "event_type"]
    assert keyed.count() == 30
    assert {r.session_id for r in keyed.collect()} == {f"S_{i}" for i in range(1, 7)}

    totals = dataset.build_dataset(spark, str(tmp_path / "e"), str(tmp_path / "l"), str(tmp_path / "out"), support=2).first()
    assert (totals.interactions, totals.sessions) == (30, 6)
    inter = readers.read_inter(spark, str(tmp_path / "out" / "realestate" / "realestate.inter"))
    assert inter.dtypes == [("user_id", "string"), ("item_id", "string"), ("timestamp", "double")]
    saved = spark.read.parquet(str(tmp_path / "out" / "sessions"))
    assert rows(inter) == rows(saved.selectExpr("user_id", "cast(item_id as string) item_id", "cast(timestamp as double) timestamp"))
    assert spark.read.parquet(str(tmp_path / "out" / "sessions_for_api.parquet")).columns == ["session_id", "item_id", "timestamp", "user_id"]

    rich = raw.keyed_events(readers.read_raw_events(spark, str(tmp_path / "events")), mapping)
    assert rows(rich.select("event_id", "session_id")) == rows(keyed.select("event_id", "session_id"))
    listed = spark.read.parquet(str(tmp_path / "l"))
    assert report.cluster_report(mapping, listed)["sparsity"].first().original_ids == 8


def test_sessions_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("s", 'say "hi", ok', 5)], "id string, note string, ms bigint").withColumn("event_ts", F.timestamp_millis("ms"))
    writers.write_csv(df, str(tmp_path / "c"))
    assert readers.read_sessions_csv(spark, str(tmp_path / "c"), df.schema).collect() == df.collect()
