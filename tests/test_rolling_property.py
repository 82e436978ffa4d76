"""Rolling windows against a direct simulation of a trailing queue (values
added one by one in order, entries older than the width dropped)."""
import datetime as dt

from hypothesis import HealthCheck, given, settings, strategies as st

from wattline.operators.rolling import rolling

T0 = dt.datetime(2024, 3, 1)


def simulate(rows, mode, width_min):
    width = width_min * 60
    out = {}
    by_label = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[4])):
        by_label.setdefault(r[0], []).append(r)
    for label, rs in by_label.items():
        q = []
        for lab, sec, value, delta, rid in rs:
            base = value if mode == "rolling_avg" else (0.0 if delta is None else delta)
            q.append((sec, base))
            q = [(s, b) for s, b in q if sec - s <= width]
            vals = [b for _, b in q if b is not None]
            out[rid] = (sum(vals) / len(vals) if vals else None) if mode == "rolling_avg" else sum(vals)
    return out


row = st.tuples(st.sampled_from(["a", "b"]), st.integers(0, 6 * 3600),
                st.one_of(st.none(), st.integers(0, 50).map(float)),
                st.one_of(st.none(), st.integers(0, 9).map(float)))


@settings(max_examples=30, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(row, min_size=1, max_size=40), mode=st.sampled_from(["rolling_avg", "rolling_sum"]),
       width=st.sampled_from([1, 30, 90, 200]))
def test_rolling_matches_queue(spark, rows, mode, width):
    rows = [(lab, sec - sec % 60 if i % 3 else sec, v, d, i) for i, (lab, sec, v, d) in enumerate(rows)]
    df = spark.createDataFrame([(lab, T0 + dt.timedelta(seconds=sec), v, d, rid) for lab, sec, v, d, rid in rows],
                               "label string, ts timestamp, value double, delta double, id long")
    got = {r.id: r.value for r in rolling(df, mode, width, order=["id"], slice_micros=3600 * 10**6).collect()}
    exp = simulate(rows, mode, width)
    assert set(got) == set(exp)
    for k, v in exp.items():
        if v is None:
            assert got[k] is None, k
        else:
            assert abs(got[k] - v) < 1e-9, (k, got[k], v)


def test_a_frame_of_a_hundred_thousand_rows_is_linear(spark):
    """Every frame holds up to 10^5 rows; summing each anew would be 5 * 10^9 additions."""
    import time

    import numpy as np
    from pyspark.sql import functions as F
    n = 100_000
    df = spark.range(n).select(F.lit("x").alias("label"), F.timestamp_micros(F.col("id") * 250_000).alias("ts"),
                               (F.col("id") % 997 / 7).alias("value"), (F.col("id") % 13 / 3).alias("delta"), "id")
    began = time.time()
    got = {r["id"]: r["value"] for r in rolling(df, "rolling_sum", 24 * 60, by=["label"], order=["id"]).where("id % 9973 = 0 or id > 99990").collect()}
    assert time.time() - began < 60
    sums = np.cumsum([i % 13 / 3 for i in range(n)])
    assert got and all(abs(v - sums[i]) < 1e-6 for i, v in got.items())


def test_values_that_left_the_frame_leave_no_trace(spark):
    """Infinities, NaN and huge values count while they are in the frame and not after it."""
    import math
    import datetime as dt
    values = [0.1, math.inf, 0.2, math.nan, 0.3, -math.inf, 1e20, 0.7, None, 1e15, 2.5, 0.1]
    at = dt.datetime(2024, 1, 1)
    rows = [("x", at + dt.timedelta(minutes=10 * i), v, v, i) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "label string, ts timestamp, value double, delta double, id long")
    got = {r["id"]: r["value"] for r in rolling(df, "rolling_avg", 10, by=["label"], order=["id"]).collect()}
    for i in range(len(values)):
        inside = [v for v in values[max(0, i - 1):i + 1] if v is not None]
        want = sum(inside) / len(inside) if inside else None
        assert (got[i] is None) if want is None else (math.isnan(got[i]) if math.isnan(want) else got[i] == want or abs(got[i] - want) < 1e-12 * abs(want))
