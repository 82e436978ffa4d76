"""A tiny sequential model of the ingest rules, used only as a test oracle.

It applies readings one at a time in arrival order against an in-memory list
of stored rows, the way a row-at-a-time service would.  Plain Python, O(n^2):
only for small fixtures.
"""

from __future__ import annotations

# Spellings of cumulative energy; unit -> (stored unit, factor).
ENERGY = {"energy", "energy_total", "energy_kwh_total"}
ENERGY_UNITS = {"kwh": ("kWh", 1.0), "wh": ("kWh", 1000.0)}


def normalize(metric: str, unit: str, value: float):
    """(metric, unit, value, is_normal, is_bad) as stored."""
    name, key = (x.lower().strip() for x in (metric, unit))
    energy = name in ENERGY
    known = energy and key in ENERGY_UNITS
    stored, factor = ENERGY_UNITS[key] if known else (unit if energy else key, 1.0)
    return "energy_kwh_total" if energy else name, stored, value / factor, factor != 1.0, energy and not known


def ingest(readings):
    """readings: iterable of dicts with key, device, ts, metric, value, unit, in
    arrival order.  Returns stored rows (dicts) in arrival order."""
    stored = []
    for r in readings:
        metric, unit, value, is_normal, is_bad = normalize(r["metric"], r["unit"], r["value"])
        series = [s for s in stored if s["device"] == r["device"] and s["metric"] == metric]
        ts = r["ts"]
        good_orig = [s for s in series if not s["is_duplicate"] and not s["is_bad"]]
        max_ts = max((s["ts"] for s in good_orig), default=None)
        is_late = max_ts is not None and ts < max_ts
        prev = [s for s in series if s["ts"] < ts and not s["is_bad"]]
        if prev:
            p = max(prev, key=lambda s: (s["ts"], s["pos"]))
            delta = max(0.0, value - p["value"])
        else:
            delta = None
        is_reset = delta == 0
        is_dup = any(s["ts"] == ts for s in series)
        row = dict(key=r["key"], device=r["device"], metric=metric, ts=ts, value=value, unit=unit,
                   is_normal=is_normal, is_bad=is_bad, is_late=is_late, is_duplicate=is_dup,
                   is_reset=is_reset, delta=None if is_dup else delta, pos=len(stored))
        stored.append(row)
        if is_late and not is_dup:
            nxt = [s for s in series if s["ts"] > ts and not s["is_duplicate"] and not s["is_bad"]]
            if nxt:
                n = min(nxt, key=lambda s: (s["ts"], s["pos"]))
                d = max(0.0, n["value"] - value)
                n["delta"] = d
                n["is_reset"] = d == 0
    return stored


def event_time(readings):
    """Event-time definition: flags as in ``ingest``; delta against the previous
    good original by event time."""
    rows = ingest(readings)
    by_series = {}
    for s in rows:
        by_series.setdefault((s["device"], s["metric"]), []).append(s)
    for series in by_series.values():
        good = sorted((s for s in series if not s["is_duplicate"] and not s["is_bad"]), key=lambda s: s["ts"])
        for s in series:
            before = [g for g in good if g["ts"] < s["ts"]]
            raw = max(0.0, s["value"] - before[-1]["value"]) if before else None
            s["is_reset"] = raw == 0
            s["delta"] = None if s["is_duplicate"] else raw
    return rows
