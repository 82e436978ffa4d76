"""Randomised parity: both delta modes against the sequential model, with tiny
slices so every carry-over path (time slices, arrival blocks, bit levels) runs."""
import datetime as dt
import random

import pytest

import fixtures as fx
import seqmodel
from wattline.operators.measure import derive_measurements


def random_batches(seed, devices=4, n=60):
    rnd = random.Random(seed)
    out = []
    for d in range(devices):
        rows = []
        for _ in range(n):
            minute = rnd.randint(0, 40)
            unit = rnd.choice(["kWh", "kWh", "kWh", "Wh", "kals"])
            value = float(rnd.randint(0, 30)) * (1000 if unit == "Wh" else 1)
            rows.append((fx.T0 + dt.timedelta(minutes=minute), "energy", value, unit))
        out.append(dict(building=f"B{d % 2}", ext=f"m{d}", name=None, rows=rows))
    # interleave arrivals of devices
    flat = [(b, r) for b in out for r in b["rows"]]
    rnd.shuffle(flat)
    return [dict(building=b["building"], ext=b["ext"], name=None, rows=[r]) for b, r in flat]


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("mode", ["event_time", "arrival"])
def test_parity_with_sequential_model(spark, seed, mode):
    batches = random_batches(seed)
    recs = fx.as_model_input(batches)
    model = seqmodel.ingest(recs) if mode == "arrival" else seqmodel.event_time(recs)
    exp = {s["key"]: s for s in model}
    got = derive_measurements(fx.readings(spark, batches), mode, slice_seconds=300,
                              arrival_slice_bits=3).collect()
    assert len(got) == len(exp)
    for g in got:
        e = exp[g.reading_id]
        assert (g.is_late, g.is_duplicate, g.is_reset, g.is_bad) == (e["is_late"], e["is_duplicate"], e["is_reset"], e["is_bad"]), g.reading_id
        if e["delta"] is None:
            assert g.delta is None, g.reading_id
        else:
            assert g.delta == pytest.approx(e["delta"]), g.reading_id


def mostly_in_order(seed, devices=5, n=50):
    """Cumulative meters reporting every minute, in order, with a few late
    readings, copies and bad units; some devices have none of those."""
    rnd = random.Random(seed)
    out = []
    for d in range(devices):
        rows, total = [], 0.0
        for i in range(n):
            total += rnd.randint(0, 5)
            rows.append((fx.T0 + dt.timedelta(minutes=i), "energy", total, "kWh"))
        if d % 2:  # odd devices get disorder
            for _ in range(4):
                j = rnd.randrange(1, n - 3)
                rows.insert(j + rnd.randint(2, 3), rows.pop(j))  # arrives late
            k = rnd.randrange(n)
            rows.insert(min(n, k + 2), rows[k])  # a copy
            rows.append((fx.T0 + dt.timedelta(minutes=rnd.randrange(n), seconds=30), "energy", 999.0, "kals"))
        out.append(dict(building="B", ext=f"m{d}", name=None, rows=rows))
    return out


@pytest.mark.parametrize("mode", ["event_time", "arrival"])
def test_parity_mostly_in_order(spark, mode):
    batches = mostly_in_order(7)
    recs = fx.as_model_input(batches)
    model = seqmodel.ingest(recs) if mode == "arrival" else seqmodel.event_time(recs)
    exp = {s["key"]: s for s in model}
    got = derive_measurements(fx.readings(spark, batches), mode, slice_seconds=600, arrival_slice_bits=4).collect()
    assert len(got) == len(exp)
    for g in got:
        e = exp[g.reading_id]
        assert (g.is_late, g.is_duplicate, g.is_reset) == (e["is_late"], e["is_duplicate"], e["is_reset"]), g.reading_id
        assert (g.delta is None) == (e["delta"] is None), g.reading_id
        if e["delta"] is not None:
            assert g.delta == pytest.approx(e["delta"]), g.reading_id
