import datetime as dt
import hashlib
import uuid

from pyspark.sql import functions as F

from wattline.functions.display import quality_label
from wattline.functions.filters import parse_exclude_bad
from wattline.functions.keys import building_key, dedupe_key, device_key, with_keys
from wattline.functions.text import (canonical_metric, canonical_unit, canonical_value, is_bad_flag,
                                     is_normal_flag, normalize_key)
from wattline.functions.time import bucket, calendar_range, iso_utc

NS = uuid.UUID("2f5d9c5d-6b32-4b6d-97aa-5f7c516f9833")


def test_building_key_golden_ignores_case_and_padding(spark):
    df = spark.createDataFrame([("North Campus",), ("  north campus ",), ("NORTH CAMPUS\t",), (" North Campus　",)], "n string")
    got = {r[0] for r in df.select(building_key("n")).collect()}
    assert got == {"36e43e35-3a25-5057-85e9-69d3fb4df778"}


def test_keys_equal_python_uuid5(spark):
    names = ["meter-n1", "Ünïcødé meter", "", "x" * 300, "a|b"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [tuple(r) for r in df.select(device_key("n"), building_key("n")).collect()]
    exp = [(str(uuid.uuid5(NS, "device:" + n.strip().lower())), str(uuid.uuid5(NS, "building:" + n.strip().lower())))
           for n in names]
    assert got == exp
    wk = [tuple(r) for r in with_keys(df.withColumn("d", F.col("n")), "n", "d").select("device_id", "building_id").collect()]
    assert wk == exp


def test_normalize_key_strips_python_whitespace(spark):
    df = spark.createDataFrame([(" \t Wh  \n",)], "u string")
    assert df.select(normalize_key("u")).first()[0] == "wh"


def test_metric_unit_value_rules(spark):
    rows = [("energy", "kWh", 5.0), ("Energy_Total", " Wh ", 500.0), ("energy", "kals", 100.0),
            ("ENERGY_KWH_TOTAL", "KWH", 2.0), ("power", " KW ", 3.0)]
    df = spark.createDataFrame(rows, "m string, u string, v double")
    got = [tuple(r) for r in df.select(canonical_metric("m"), canonical_unit("m", "u"), canonical_value("m", "u", "v"),
                                       is_normal_flag("m", "u"), is_bad_flag("m", "u")).collect()]
    assert got == [("energy_kwh_total", "kWh", 5.0, False, False),
                   ("energy_kwh_total", "kWh", 0.5, True, False),
                   ("energy_kwh_total", "kals", 100.0, False, True),
                   ("energy_kwh_total", "kWh", 2.0, False, False),
                   ("power", "kw", 3.0, False, False)]


def test_parse_exclude_bad():
    assert parse_exclude_bad(None) is True
    assert parse_exclude_bad("") is True
    assert parse_exclude_bad("true") is True
    assert parse_exclude_bad("maybe") is True
    assert parse_exclude_bad(" No ") is False
    assert parse_exclude_bad("FALSE") is False
    assert parse_exclude_bad("0") is False
    assert parse_exclude_bad(0) is True
    assert parse_exclude_bad(False) is False


def test_calendar_range():
    s, e = calendar_range("2024-03-01", "2024-03-02")
    assert s == dt.datetime(2024, 3, 1, 0, 0) and e == dt.datetime(2024, 3, 2, 23, 59, 59, 999000)
    s, e = calendar_range("2024-03-01", "2024-03-01", "08:30", "17:05")
    assert s == dt.datetime(2024, 3, 1, 8, 30) and e == dt.datetime(2024, 3, 1, 17, 5, 59, 999000)
    s, e = calendar_range("2024-03-01", None, None, None, tz="Europe/Berlin")
    assert s == dt.datetime(2024, 2, 29, 23, 0) and e is None


def test_bucket_and_iso(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 3, 1, 8, 44, 59),)], "ts timestamp")
    r = df.select(iso_utc(bucket("ts", 30)), iso_utc(bucket("ts", 60)), iso_utc(bucket("ts", 1440))).first()
    assert tuple(r) == ("2024-03-01T08:30:00Z", "2024-03-01T08:00:00Z", "2024-03-01T00:00:00Z")


def test_quality_label(spark):
    df = spark.createDataFrame([(True, True, False, True, False), (False,) * 5],
                               "is_normal boolean, is_reset boolean, is_duplicate boolean, is_late boolean, is_bad boolean")
    assert [r[0] for r in df.select(quality_label()).collect()] == ["Normalized, Reset, Late", ""]


def test_dedupe_key(spark):
    df = spark.createDataFrame([("k1", "m", "energy", "t", "1.0"), ("", "m", "energy", "t", "1.0"), (None, "m", "energy", "t", "1.0")],
                               "k string, e string, me string, t string, v string")
    got = [r[0] for r in df.select(dedupe_key("k", "e", "me", "t", "v")).collect()]
    h = hashlib.sha256(b"m|energy|t|1.0").hexdigest()
    assert got == ["k1", h, h]


def test_display_rounding(spark):
    from wattline.functions.display import display, round_total
    df = spark.createDataFrame([(1234.56789, 529.98999)], "v double, t double")
    r = df.select(display("v", 3), round_total("t")).first()
    assert tuple(r) == ("1,234.568", 529.99)
