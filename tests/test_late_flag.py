"""The stateful late flag against the derivation."""

import random
import tempfile

from test_generations import batches_of, random_parts

from wattline.operators.measure import derive_measurements
from wattline.sources.batches import append_log
from wattline.streaming.late_flag import flagged, late_flag_stream


def test_stream_flags_equal_the_derivation_and_the_state_stays_small(spark):
    root = tempfile.mkdtemp(prefix="wl-r4-")
    batches = batches_of(spark, random_parts(3, 3, 60, 12))
    for k, b in enumerate(batches):
        append_log(b, f"{root}/log", 4, batch_id=k)
        late_flag_stream(spark, f"{root}/log", f"{root}/out", f"{root}/checkpoint").awaitTermination()
    got = {r.reading_id: r.is_late for r in spark.read.parquet(f"{root}/out").collect()}
    every = batches[0].unionByName(batches[1]).unionByName(batches[2])
    want = {r.reading_id: r.is_late for r in derive_measurements(every).select("reading_id", "is_late").collect()}
    assert got == want and any(want.values()) and not all(want.values())
    assert max(r.kept for r in spark.read.parquet(f"{root}/out").collect()) < 20


def plain(rows):
    out, seen, goods = [], set(), []
    for at, bad in rows:
        out.append(any(g > at for g in goods))
        if at not in seen and not bad:
            goods.append(at)
        seen.add(at)
    return out


def test_state_in_any_split_equals_the_plain_rule():
    rng = random.Random(7)
    for _ in range(300):
        rows = [(rng.randrange(12), rng.random() < 0.4) for _ in range(rng.randrange(1, 25))]
        cut = rng.randrange(len(rows) + 1)
        a, high, ahead, _ = flagged(rows[:cut], None, set())
        b, high, ahead, _ = flagged(rows[cut:], high, set(ahead))
        assert a + b == plain(rows)
        assert high is None or all(x > high for x in ahead)


def test_one_call_takes_a_shard_of_series_and_keeps_state_per_series():
    import pandas as pd
    from wattline.streaming.late_flag import LateFlag

    class Kept(dict):
        getValue, updateValue = dict.get, dict.__setitem__
    p, rng = LateFlag(), random.Random(3)
    p.series = Kept()
    rows = [(f"d{rng.randrange(4)}", k, rng.randrange(9), rng.random() < 0.4) for k in range(60)]
    got = {}
    for part in (rows[:25], rows[25:]):
        shuffled = rng.sample(part, len(part))
        frames = [pd.DataFrame([(d, "m", k, k, at, bad) for d, k, at, bad in some],
                               columns=["device_id", "metric", "arrival_seq", "reading_id", "at", "is_bad"]) for some in (shuffled[:9], shuffled[9:])]
        out = list(p.handleInputRows((0,), iter(frames), None))
        assert len(out) == 1
        got.update(zip(out[0]["reading_id"].tolist(), zip(out[0]["device_id"], out[0]["is_late"])))
    for d in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == d]
        assert [got[k] for _, k, _, _ in mine] == [(d, late) for late in plain([(at, bad) for _, _, at, bad in mine])]
    assert set(p.series) == {(d, "m") for d in {r[0] for r in rows}}
