"""As-of joins, closes and editions."""

import random

import pytest
from pyspark.sql import functions as F

from leadflow import rules
from leadflow.operators import windows as w
from leadflow.operators.asof import asof_join


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("salts", [1, 3])
def test_asof_join_matches_brute_force(spark, strict, salts):
    rnd = random.Random(6)
    left = [(k, rnd.choice(["a", "a", "a", "b", "c", None]), rnd.choice([None, *range(0, 400, 3)])) for k in range(300)]
    right = [(rnd.choice(["a", "b", None, "d"]), rnd.randint(0, 400), k) for k in range(60)]
    stamp = lambda df: df.withColumn("t", F.timestamp_seconds(F.col("t") * 3600))
    out = asof_join(stamp(spark.createDataFrame(left, "k int, key string, t int")), stamp(spark.createDataFrame(right, "key string, t int, v int")).withColumnRenamed("t", "at"), ["key"], "t", "at", ["v"],
                    strict, width=24 * 3_600_000_000, salts=salts)
    got = {r["k"]: r["v"] for r in out.collect()}
    want = {}
    for k, key, t in left:
        earlier = [(at, v) for other, at, v in right if other == key and t is not None and (at < t or at == t and not strict)]
        want[k] = max(earlier)[1] if earlier else None
    assert got == want


def closes_by_day(as_of, zone_rules, special):
    """The rule read day by day; ``special`` maps (market, day) to a clock or None."""
    from datetime import datetime, time, timedelta
    from zoneinfo import ZoneInfo

    out = {}
    for market, zone, clock, basis in zone_rules:
        day = as_of.astimezone(ZoneInfo(zone)).date()
        for _ in range(370):
            listed = (market, str(day)) in special
            at = special[market, str(day)] if listed else clock if day.weekday() < 5 else None
            if at:
                closed = datetime.combine(day, time.fromisoformat(at), ZoneInfo(zone))
                if closed <= as_of:
                    out[market] = (closed.astimezone(ZoneInfo("UTC")).replace(tzinfo=None), day, "session override" if listed else basis)
                    break
            day -= timedelta(days=1)
    return out


def test_closes_match_the_rule_read_day_by_day(spark):
    from datetime import datetime, timedelta, timezone

    rnd = random.Random(3)
    start = datetime(2026, 3, 20, tzinfo=timezone.utc)
    stamps = [start + timedelta(minutes=rnd.randint(0, 60 * 24 * 60)) for _ in range(60)]
    special = {(m, str((start + timedelta(days=d)).date())): rnd.choice([None, None, "12:00", "23:59:30"]) for m in ("JP", "HK", "AU", "NZ") for d in range(-9, 55) if rnd.random() < 0.45}
    editions = spark.createDataFrame([(str(k), s.replace(tzinfo=None)) for k, s in enumerate(stamps)], "edition_id string, as_of timestamp_ntz").withColumn("as_of", F.to_timestamp("as_of"))
    overrides = spark.createDataFrame([(m, d, c) for (m, d), c in special.items()], "market string, session_date string, close string")
    found = w.latest_close(editions, rules.market_rules(spark), overrides).select("edition_id", "market", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("s"), "session_date", "basis").collect()
    got = {(r["edition_id"], r["market"]): (r["s"], r["session_date"], r["basis"]) for r in found}
    want = {(str(k), m): (str(v[0]), v[1], v[2]) for k, s in enumerate(stamps) for m, v in closes_by_day(s, rules.MARKET_CLOSES, special).items()}
    assert got == want


def test_any_windows_are_assigned(spark):
    """Nested, crossing, equal, empty and strict windows; several leads at one time."""
    rnd = random.Random(11)
    spans = [(f"e{k}", rnd.choice(["JP", "HK"]), *sorted(rnd.sample(range(60), 2)), rnd.random() < 0.5, rnd.choice(["active", "active", "pending_start"])) for k in range(40)] + [("z", "JP", 7, 7, True, "active")]
    leads = [(k, rnd.choice(["JP", "HK", "AU", None]), rnd.choice([*range(61), None]), rnd.choice(["time", "time", "day"])) for k in range(200)]
    at = lambda c: F.timestamp_seconds(F.lit(1_790_000_000) + F.col(c) * 86_400)
    windows = spark.createDataFrame(spans, "edition_id string, market string, s int, e int, start_inclusive boolean, status string").select(
        "edition_id", "market", at("s").alias("window_start"), at("e").alias("as_of"), "start_inclusive", "status")
    rows = spark.createDataFrame(leads, "lead_seq int, market string, p int, date_precision string").withColumn("published", at("p"))
    got = sorted((r["lead_seq"], r["edition_id"]) for r in w.assign_editions(rows, windows).collect())
    want = sorted((k, e) for k, m, p, precision in leads for e, market, s, end, inclusive, status in spans
                  if precision == "time" and p is not None and status == "active" and market == m and p <= end and (p > s or inclusive and p == s))
    assert got == want and len(want) > 100


def test_nothing_is_listed_by_day(spark):
    editions = spark.createDataFrame([("e", "2026-09-28 00:00:00")], "edition_id string, t string").select("edition_id", F.col("t").cast("timestamp").alias("as_of"))
    overrides = spark.createDataFrame([("JP", "2026-09-25", None)], "market string, session_date string, close string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    built = w.build_windows(editions, rules.market_rules(spark), overrides)
    leads = spark.range(3).select(F.col("id").alias("lead_seq"), F.lit("JP").alias("market"), F.current_timestamp().alias("published"), F.lit("time").alias("date_precision"))
    for text in (plan(w.latest_close(editions, rules.market_rules(spark), overrides)), plan(built), plan(w.assign_editions(leads, built))):
        assert "sequence(date_sub" not in text and "sequence(cast(window_start" not in text and "as date), Some(INTERVAL" not in text


def test_rolling_hours(spark):
    editions = spark.createDataFrame([("e", "2026-09-28 00:00:00")], "edition_id string, t string").select("edition_id", F.col("t").cast("timestamp").alias("as_of"))
    none = spark.createDataFrame([], "market string, session_date string, close string")
    rolling = w.build_windows(editions, rules.market_rules(spark), none, timing="rolling_hours")
    assert rolling.count() == 0 and str(w.fallback_start(editions, rolling, 36).first()["start"]) == "2026-09-26 12:00:00"
    closes = w.build_windows(editions, rules.market_rules(spark), none)
    assert w.fallback_start(editions, closes).first()["start"] == closes.agg(F.min("window_start")).first()[0]
    resolved = w.record_window(spark.createDataFrame([(["JP"],), ([],)], "timing_markets array<string>"), rolling, "2026-09-26 12:00:00")
    assert {r["timing_resolved"] for r in resolved.collect()} == {True}
    with pytest.raises(ValueError):
        w.build_windows(editions, rules.market_rules(spark), none, timing="other")
