"""Own sample: three buildings with six meters, small enough to check by hand (FIXTURES.md), and
helpers to turn reading tuples into a readings DataFrame."""

import datetime as dt

T0 = dt.datetime(2024, 3, 1, 8, 0)


def at(hh, mm):
    return dt.datetime(2025, 2, 3, hh, mm)


def _b(building, ext, name, rows):
    return dict(building=building, ext=ext, name=name,
                rows=[(at(*map(int, t.split(":"))), "energy", float(v), u) for t, v, u in rows])


# One batch per meter, in this order.  The pump reports late, twice, and starts over; the press counts in Wh
# and stands still; the crane and the belt have a reading in an unknown unit; the oven reports late.
SAMPLE = [
    _b("Mill", "pump", "Water pump", [
        ("06:00", 0, "kWh"), ("06:20", 4, "kWh"), ("06:40", 9, "kWh"), ("07:00", 12, "kWh"), ("07:40", 20, "kWh"),
        ("07:20", 15, "kWh"), ("08:00", 26, "kWh"), ("08:00", 26, "kWh"), ("08:20", 3, "kWh"), ("08:40", 7, "kWh")]),
    _b("Mill", "press", "Press", [("06:00", 1000, "Wh"), ("06:30", 2500, "Wh"), ("07:00", 2500, "Wh"), ("07:30", 6000, "Wh")]),
    _b("Quay", "crane", "Crane", [("06:00", 10, "kWh"), ("07:00", 14, "kWh"), ("08:00", 50, "kals"), ("09:00", 21, "kWh")]),
    _b("Quay", "gate", "Gate", [("06:15", 2, "kWh"), ("06:45", 2.5, "kWh"), ("07:15", 4, "kWh")]),
    _b("Depot", "oven", "Oven", [("06:00", 100, "kWh"), ("07:00", 130, "kWh"), ("09:00", 190, "kWh"), ("08:00", 150, "kWh")]),
    _b("Depot", "belt", "Belt", [("06:00", 5, "kWh"), ("06:30", 900, "kals"), ("07:00", 9, "kWh")]),
]
ROWS = sum(len(b["rows"]) for b in SAMPLE)

SCHEMA = ("reading_id long, arrival_seq long, building_name string, device_external_id string, "
          "device_name string, ts timestamp, metric string, value double, unit string, ingest_time timestamp")


def batches_to_rows(batches):
    rows, seq = [], 0
    for b in batches:
        for ts, metric, value, unit in b["rows"]:
            rows.append((seq, seq, b["building"], b["ext"], b.get("name"), ts, metric, value, unit,
                         dt.datetime(2024, 3, 2) + dt.timedelta(seconds=seq)))
            seq += 1
    return rows


def readings(spark, batches):
    return spark.createDataFrame(batches_to_rows(batches), SCHEMA)


def series_rows(spark, arrivals, ext="m1", building="B1", metric="energy"):
    """arrivals: list of (minute offset, value, unit) in arrival order."""
    b = dict(building=building, ext=ext, name=None,
             rows=[(T0 + dt.timedelta(minutes=m), metric, float(v), u) for m, v, u in arrivals])
    return readings(spark, [b])


def as_model_input(batches):
    return [dict(key=r[0], device=r[3].strip().lower(), ts=r[5], metric=r[6], value=r[7], unit=r[8])
            for r in batches_to_rows(batches)]
