"""SQL oracle texts (DuckDB dialect) for the registered queries.

The oracle is written independently of the Spark plans: plain windows and
correlated subqueries that state each rule directly (e.g. "the latest earlier
arrival that ...").  It is only a checker for small scale factors.
"""

from __future__ import annotations

# Fixed values that must equal the reference's: energy spellings, key namespace.
ENERGY = "('energy','energy_total','energy_kwh_total')"
NS_HEX = "2f5d9c5d6b324b6d97aa5f7c516f9833"


def uuid5_sql(text_expr: str) -> str:
    h = f"sha1(unhex('{NS_HEX}') || encode({text_expr}))"
    return (f"(substr({h},1,8) || '-' || substr({h},9,4) || '-5' || substr({h},14,3) || '-' || "
            f"translate(substr({h},17,1), '0123456789abcdef', '89ab89ab89ab89ab') || substr({h},18,3) || '-' || "
            f"substr({h},21,12))")


def _key(x: str) -> str:
    return f"lower(regexp_replace(coalesce({x}, ''), '^\\s+|\\s+$', '', 'g'))"


# Readings from events (FIXTURES.md §3), normalised.
READINGS = f"""
r AS (
  SELECT event_id AS reading_id,
         event_id + CASE WHEN event_id % 13 = 0 THEN 900 ELSE 0 END AS arrival_seq,
         concat('Building ', CAST(user_id % 5 AS VARCHAR)) AS building_name,
         concat('meter-', CAST(user_id AS VARCHAR)) AS device_external_id,
         CAST(NULL AS VARCHAR) AS device_name,
         date_trunc('hour', ts) AS ts, 'energy' AS raw_metric, value AS raw_value,
         CASE event_type WHEN 'error' THEN 'kals' WHEN 'view' THEN 'Wh' ELSE 'kWh' END AS raw_unit,
         props AS raw_payload, ts AS ingest_time
  FROM events),
rk AS (SELECT *, {_key('raw_metric')} AS mk, {_key('raw_unit')} AS uk FROM r),
c AS (
  SELECT reading_id, arrival_seq, building_name, device_external_id, device_name, ts, ingest_time,
         raw_metric, raw_unit, raw_value, raw_payload,
         {uuid5_sql("'building:' || " + _key('building_name'))} AS building_id,
         {uuid5_sql("'device:' || " + _key('device_external_id'))} AS device_id,
         CASE WHEN mk IN {ENERGY} THEN 'energy_kwh_total' ELSE mk END AS metric,
         CASE WHEN mk IN {ENERGY} AND uk IN ('kwh','wh') THEN 'kWh' WHEN mk IN {ENERGY} THEN raw_unit ELSE uk END AS unit,
         CASE WHEN mk IN {ENERGY} AND uk = 'wh' THEN raw_value / 1000.0 ELSE raw_value END AS value,
         (mk IN {ENERGY} AND uk = 'wh') AS is_normal,
         (mk IN {ENERGY} AND uk NOT IN ('kwh','wh')) AS is_bad
  FROM rk)"""

# Flags (W1-W3) stated in arrival order, event-time delta.
FLAGS = """
f0 AS (
  SELECT c.*, row_number() OVER (PARTITION BY device_id, metric, ts ORDER BY arrival_seq, reading_id) > 1 AS is_duplicate
  FROM c),
f AS (
  SELECT f0.*,
    coalesce(ts < max(CASE WHEN NOT is_bad AND NOT is_duplicate THEN ts END) OVER (
      PARTITION BY device_id, metric ORDER BY arrival_seq, reading_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS is_late,
    last_value(CASE WHEN NOT is_bad AND NOT is_duplicate THEN value END IGNORE NULLS) OVER (
      PARTITION BY device_id, metric ORDER BY epoch_us(ts)
      RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_value
  FROM f0),
fd AS (SELECT f.*, CASE WHEN prev_value IS NOT NULL THEN greatest(CAST(0.0 AS DOUBLE), value - prev_value) END AS d_raw FROM f),
m AS (
  SELECT arrival_seq, reading_id, building_id, building_name, device_id, device_external_id, device_name,
         ts, metric, value, unit, is_normal, coalesce(d_raw = 0, false) AS is_reset, is_duplicate, is_late, is_bad,
         reading_id AS raw_event_id, CASE WHEN NOT is_duplicate THEN d_raw END AS delta,
         ingest_time AS created_at, CASE WHEN is_late OR is_duplicate THEN ingest_time END AS updated_at
  FROM fd)"""

# Arrival mode (W7) by direct definition: a good original's delta is written
# last by the latest-arriving non-duplicate reading L with an earlier ts whose
# "next good original" at L's arrival was this row; otherwise the insert-time
# delta against the greatest (ts, arrival) good reading that arrived earlier.
ARRIVAL = """
ins AS (
  SELECT a.reading_id,
    (SELECT b.value FROM f b
      WHERE b.device_id = a.device_id AND b.metric = a.metric AND NOT b.is_bad AND b.ts < a.ts
        AND (b.arrival_seq < a.arrival_seq OR (b.arrival_seq = a.arrival_seq AND b.reading_id < a.reading_id))
      ORDER BY b.ts DESC, b.arrival_seq DESC, b.reading_id DESC LIMIT 1) AS ins_prev
  FROM f a),
wr AS (
  SELECT a.reading_id,
    (SELECT l.value FROM f l
      WHERE l.device_id = a.device_id AND l.metric = a.metric AND NOT l.is_duplicate AND l.ts < a.ts
        AND (l.arrival_seq > a.arrival_seq OR (l.arrival_seq = a.arrival_seq AND l.reading_id > a.reading_id))
        AND NOT EXISTS (
          SELECT 1 FROM f j
          WHERE j.device_id = a.device_id AND j.metric = a.metric AND NOT j.is_bad AND NOT j.is_duplicate
            AND j.ts > l.ts AND j.ts < a.ts
            AND (j.arrival_seq < l.arrival_seq OR (j.arrival_seq = l.arrival_seq AND j.reading_id < l.reading_id)))
      ORDER BY l.arrival_seq DESC, l.reading_id DESC LIMIT 1) AS writer_value
  FROM f a WHERE NOT a.is_bad AND NOT a.is_duplicate),
ad AS (
  SELECT f.*, coalesce(wr.writer_value, ins.ins_prev) AS prev_arr
  FROM f JOIN ins USING (reading_id) LEFT JOIN wr USING (reading_id)),
am AS (
  SELECT reading_id, is_duplicate, is_late, is_bad,
         CASE WHEN prev_arr IS NOT NULL THEN greatest(CAST(0.0 AS DOUBLE), value - prev_arr) END AS d_raw
  FROM ad)"""


def with_m(body: str, arrival: bool = False) -> str:
    ctes = READINGS + "," + FLAGS + ("," + ARRIVAL if arrival else "")
    return f"WITH {ctes}\n{body}"


def iso(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%dT%H:%M:%SZ')"


def bucket(col: str, minutes: int) -> str:
    w = int(minutes) * 60
    return f"make_timestamp(CAST(floor(epoch({col}) / {w}) * {w} AS BIGINT) * 1000000)"
