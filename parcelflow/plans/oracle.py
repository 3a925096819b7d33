"""SQL twins of the registered queries, for an independent engine to check them.

Written against the generated tables only; nothing of the DataFrame code is reused but
the fixed domain values.
"""

from __future__ import annotations

from parcelflow import schemas as S


def _values(rows: list[tuple]) -> str:
    def lit(v: object) -> str:
        return f"'{v}'" if isinstance(v, str) else "NULL" if v is None else repr(v)

    return "VALUES " + ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)


def _list(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


EVENT_COLS = ", ".join(S.EVENT_COLUMNS)
SILVER_COLS = ", ".join(S.SILVER_COLUMNS)
VALIDATION_AS_OF = "TIMESTAMP '2001-06-01 00:00:00'"
LIVE_AS_OF = "TIMESTAMP '2001-07-01 00:00:00'"
LIVE_ACCEL = "0.001::DOUBLE"


def _rounded(expr: str, digits: int) -> str:
    """Half-up rounding of the decimal text of a double, as Spark rounds."""
    return f"CAST(round(CAST(CAST({expr} AS VARCHAR) AS DECIMAL(38, 18)), {digits}) AS DOUBLE)"


CTES = {
    "hubs": f"hubs AS (SELECT * FROM ({_values([(h[0], h[2], h[3], i) for i, h in enumerate(S.HUBS)])}) t(id, hlat, hlon, pos))",
    "weather": """weather AS (SELECT * FROM (VALUES ('AMS', true), ('RTM', true), ('UTR', false), ('EIN', false),
        ('DHG', true), ('GRO', false), ('ZWO', true)) t(hub_id, weather_bad))""",
    "raw": """raw AS (
        SELECT l_orderkey || '-' || l_linenumber AS event_id,
               'P' || l_orderkey AS parcel_id,
               CASE WHEN l_linenumber <= 3 THEN ['CREATED', 'LABEL_PRINTED', 'COLLECTED'][l_linenumber]
                    WHEN l_linenumber = 4 THEN if(l_linestatus = 'F', 'AT_SORTING_HUB', 'IN_TRANSIT')
                    WHEN l_linenumber = 5 THEN if(l_returnflag = 'R', 'RESCHEDULED', 'IN_TRANSIT')
                    WHEN l_linenumber = 6 THEN 'OUT_FOR_DELIVERY'
                    WHEN l_returnflag = 'A' THEN 'DELIVERED'
                    WHEN l_returnflag = 'R' THEN 'DELIVERY_FAILED'
                    ELSE 'RETURNED' END AS event_type,
               ['AMS', 'RTM', 'UTR', 'EIN', 'DHG', 'GRO', 'ZWO', 'MST', 'XXX'][l_suppkey % 9 + 1] AS hub_id,
               50.5::DOUBLE + (l_partkey % 330)::DOUBLE / 100.0::DOUBLE AS lat,
               3.3::DOUBLE + (l_suppkey % 400)::DOUBLE / 100.0::DOUBLE AS lon,
               o_orderdate + to_hours(l_linenumber * (1 + trunc(l_quantity)::INT % 8)) AS event_ts,
               l_linenumber::INT AS version
        FROM lineitem, orders WHERE l_orderkey = o_orderkey)""",
    "events": "events_raw AS (SELECT *, event_type AS status FROM raw)",
    "distinct": """scans AS (
        SELECT * EXCLUDE (copy) FROM (
            SELECT *, row_number() OVER (PARTITION BY event_id
                ORDER BY event_ts, hub_id, lat, lon, event_type, version) AS copy
            FROM events_raw) WHERE copy = 1)""",
    "flagged": f"""flagged AS (
        SELECT *, hub_id IN (SELECT id FROM hubs) AS ok_hub,
               lat BETWEEN {S.LAT_MIN}::DOUBLE AND {S.LAT_MAX}::DOUBLE
                   AND lon BETWEEN {S.LON_MIN}::DOUBLE AND {S.LON_MAX}::DOUBLE AS ok_box,
               event_ts <= {VALIDATION_AS_OF} + INTERVAL 5 MINUTE AS ok_time
        FROM scans)""",
    "silver": f"""silver AS (
        SELECT event_id, parcel_id, event_type, status, f.hub_id, lat, lon, event_ts, version,
               weather_bad, CAST(event_ts AS DATE) AS event_date
        FROM flagged f LEFT JOIN weather w ON f.hub_id = w.hub_id
        WHERE ok_hub AND ok_box AND ok_time)""",
    "parcels": """parcels_now AS (
        SELECT o_orderkey, 'P' || o_orderkey AS parcel_id,
               ['AMS', 'RTM', 'UTR', 'EIN', 'DHG', 'GRO', 'ZWO', 'MST'][o_custkey % 8 + 1] AS origin_hub,
               (1000 + o_custkey) || ' AB' AS destination_postcode,
               if(o_custkey % 10 = 9, NULL, r_name) AS destination_region,
               ['PostNL', 'DHL', 'DPD', 'GLS'][o_custkey % 4 + 1] AS carrier,
               CASE WHEN o_orderpriority = '1-URGENT' THEN 'SAME_DAY'
                    WHEN o_orderpriority IN ('2-HIGH', '3-MEDIUM') THEN 'NEXT_DAY' ELSE 'STANDARD' END AS service_level,
               CASE WHEN o_orderpriority = '1-URGENT' THEN 6
                    WHEN o_orderpriority IN ('2-HIGH', '3-MEDIUM') THEN 24 ELSE 48 END AS sla_hours,
               o_orderdate AS created_at
        FROM orders JOIN customer ON o_custkey = c_custkey
             JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        WHERE o_orderkey % 20 <> 0),
    parcels_raw AS (
        SELECT *, created_at + to_hours(sla_hours) AS promised_by FROM parcels_now
        UNION ALL
        SELECT * REPLACE (created_at - INTERVAL 1 HOUR AS created_at, 'OLD' AS carrier),
               created_at + to_hours(sla_hours) AS promised_by
        FROM parcels_now WHERE o_orderkey % 7 = 0)""",
    "stg_parcels": f"""stg_parcels AS (
        SELECT {", ".join(S.PARCEL_COLUMNS)} FROM parcels_raw
        QUALIFY row_number() OVER (PARTITION BY parcel_id ORDER BY created_at DESC) = 1)""",
    "outcome": """outcome AS (
        SELECT s.parcel_id, max(event_ts) FILTER (WHERE event_type = 'DELIVERED') AS delivered_ts,
               bool_or(event_type = 'DELIVERY_FAILED') AS failed, bool_or(event_type = 'RETURNED') AS came_back,
               min(destination_region) AS region, min(created_at) AS created_at, min(sla_hours) AS sla_hours
        FROM silver s LEFT JOIN stg_parcels p ON s.parcel_id = p.parcel_id GROUP BY s.parcel_id)""",
    "state": """state AS (
        SELECT parcel_id, version, event_type, status, event_ts, c.hub_id, lat, lon, weather_bad
        FROM scans c LEFT JOIN weather w ON c.hub_id = w.hub_id
        QUALIFY row_number() OVER (PARTITION BY parcel_id ORDER BY version DESC, event_type DESC, event_ts DESC) = 1)""",
    "merged": """merged AS (
        SELECT *, version % 2 = 1 AS changed FROM (
            SELECT parcel_id, version, event_type, status, event_ts, c.hub_id, lat, lon, weather_bad
            FROM scans c LEFT JOIN weather w ON c.hub_id = w.hub_id)
        QUALIFY row_number() OVER (PARTITION BY parcel_id
            ORDER BY version DESC, version % 2, event_type DESC, event_ts DESC) = 1)""",
    "viewed": f"""aged AS (
        SELECT s.*, p.* EXCLUDE (parcel_id),
               (epoch_us({LIVE_AS_OF}) - epoch_us(created_at))::DOUBLE / 1e6::DOUBLE * {LIVE_ACCEL} AS elapsed
        FROM state s LEFT JOIN stg_parcels p ON s.parcel_id = p.parcel_id),
    viewed AS (
        SELECT *, CASE WHEN status IN ('DELIVERED', 'RETURNED') THEN 'delivered'
                       WHEN created_at IS NULL THEN 'unknown'
                       WHEN elapsed > sla_hours * 3600 THEN 'breached'
                       WHEN elapsed > (sla_hours * 3600)::DOUBLE * 0.8::DOUBLE THEN 'at_risk'
                       ELSE 'on_time' END AS sla,
               {_rounded("((sla_hours * 3600)::DOUBLE - elapsed) / 3600::DOUBLE", 1)} AS sim_hours_remaining
        FROM aged)""",
    # Weather responses, straight from the arithmetic that makes them.
    "observed": """observed AS (
        SELECT event_id AS response_id, ts AS fetched_at, i,
               hubs.id AS hub_id,
               (event_id * 7 + i * 13) % 300 / 10.0::DOUBLE AS temperature,
               CASE WHEN (event_id + i) % 13 = 0 OR (event_id + i) % 17 = 0 THEN NULL
                    ELSE (event_id * 11 + user_id + i * 17) % 150 / 10.0::DOUBLE END AS wind_speed,
               CASE WHEN (event_id + i) % 19 = 0 THEN NULL
                    ELSE (event_id * 3 + i * 5) % 10 / 10.0::DOUBLE END AS precipitation,
               strftime(ts, '%Y-%m-%dT%H:%M') AS observed_at
        FROM (SELECT *, unnest(range(event_id % 9)) AS i FROM events) JOIN hubs ON hubs.pos = i)""",
    "paired": f"""ordered AS (
        SELECT parcel_id, version, event_type,
               lag(event_type) OVER w AS from_type, row_number() OVER w AS place
        FROM silver WINDOW w AS (PARTITION BY parcel_id ORDER BY version)),
    edges AS (SELECT * FROM ({_values(S.LIFECYCLE_EDGES)}) t(a, b))""",
    "ended": """ended AS (
        SELECT parcel_id, max_by(event_type, version) AS last_event_type,
               bool_or(event_type = 'DELIVERY_FAILED') AS failed
        FROM silver GROUP BY parcel_id)""",
    "landed": """landed AS (
        SELECT event_id, split_part(event_id, '-', 1)::BIGINT AS k FROM events_raw)""",
}

_NEEDS = {
    "events": ["raw"],
    "distinct": ["events"],
    "flagged": ["hubs", "distinct"],
    "silver": ["flagged", "weather"],
    "stg_parcels": ["parcels"],
    "outcome": ["silver", "stg_parcels"],
    "state": ["distinct", "weather"],
    "merged": ["distinct", "weather"],
    "viewed": ["state", "stg_parcels"],
    "observed": ["hubs"],
    "paired": ["silver"],
    "ended": ["silver"],
    "landed": ["events"],
}


def _with(*names: str) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        for needed in _NEEDS.get(name, []):
            add(needed)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    return "WITH " + ",\n".join(CTES[n] for n in order) + "\n"


VIEW = """parcel_id, status, sla, service_level, destination_region AS region, destination_postcode,
    carrier, origin_hub, hub_id, version, lat, lon, weather_bad, event_ts AS last_scan, created_at,
    promised_by, sla_hours, sim_hours_remaining"""

FACT = f"""SELECT {", ".join("s." + c for c in S.SILVER_COLUMNS)}, p.service_level, p.sla_hours, p.created_at,
    p.promised_by, p.destination_region, p.carrier, p.origin_hub
FROM silver s LEFT JOIN stg_parcels p ON s.parcel_id = p.parcel_id"""


def _worklist(where: str) -> str:
    return (
        _with("viewed")
        + f"""SELECT {VIEW}, replace(lower(status), '_', ' ') AS status_title,
    CASE WHEN sim_hours_remaining IS NULL THEN ''
         WHEN sim_hours_remaining < 0 THEN 'overdue ' || regexp_replace(printf('%.1f', -sim_hours_remaining), '\\.0$', '') || 'h'
         ELSE regexp_replace(printf('%.1f', sim_hours_remaining), '\\.0$', '') || 'h left' END AS time_label
FROM viewed WHERE {where}
ORDER BY list_position(['breached', 'at_risk', 'on_time', 'delivered', 'unknown'], sla),
         coalesce(sim_hours_remaining, 1e9), parcel_id
LIMIT 200"""
    )


def _failures(table: str, column: str, source: str, condition: str) -> str:
    return (
        f"SELECT '{table}' AS \"table\", '{column}' AS \"column\", "
        f"count(*) FILTER (WHERE {condition}) AS failures FROM {source}"
    )


def _repeats(table: str, column: str, source: str) -> str:
    return (
        f"SELECT '{table}' AS \"table\", '{column}' AS \"column\", count(*) AS failures "
        f"FROM (SELECT {column} FROM {source} GROUP BY {column} HAVING count(*) > 1)"
    )


GOLD_ON_TIME = """SELECT coalesce(region, 'Unknown') AS region, count(*) AS parcels, count(delivered_ts) AS delivered,
    count(*) FILTER (WHERE delivered_ts <= created_at + to_hours(sla_hours)) AS on_time, {rate} AS on_time_rate
FROM outcome GROUP BY ALL ORDER BY parcels DESC, region""".format(
    rate=_rounded(
        "count(*) FILTER (WHERE delivered_ts <= created_at + to_hours(sla_hours))::DOUBLE"
        " / nullif(count(delivered_ts), 0)",
        4,
    )
)
GOLD_FAILURES = """SELECT coalesce(region, 'Unknown') AS region, count(*) AS parcels,
    count(*) FILTER (WHERE failed) AS parcels_with_failure, count(*) FILTER (WHERE came_back) AS returned,
    {failed} AS failure_rate, {returned} AS return_rate
FROM outcome GROUP BY ALL ORDER BY parcels DESC, region""".format(
    failed=_rounded("count(*) FILTER (WHERE failed)::DOUBLE / count(*)", 4),
    returned=_rounded("count(*) FILTER (WHERE came_back)::DOUBLE / count(*)", 4),
)
_HITS = "sum(if(event_type = 'DELIVERY_FAILED', 1, 0))"
_TRIES = "sum(if(event_type = 'OUT_FOR_DELIVERY', 1, 0))"
GOLD_WEATHER = f"""SELECT weather_bad IS NOT DISTINCT FROM true AS bad_weather,
    {_TRIES}::BIGINT AS delivery_attempts, {_HITS}::BIGINT AS failures,
    {_rounded(f"{_HITS}::DOUBLE / nullif({_TRIES}, 0)", 4)} AS failure_rate
FROM silver GROUP BY ALL ORDER BY bad_weather"""
GOLD_FUNNEL = """SELECT event_type, count(*) AS events, count(DISTINCT parcel_id) AS parcels
FROM silver GROUP BY ALL ORDER BY parcels DESC, event_type"""

_KM = (
    "2 * 6371.0::DOUBLE * asin(sqrt(pow(sin(radians({lat2} - lat) / 2), 2) + cos(radians(lat)) "
    "* cos(radians({lat2})) * pow(sin(radians({lon2} - lon) / 2), 2)))"
)

ORACLE: dict[str, str] = {
    "decode_events": _with("events")
    + f"""SELECT {", ".join(f"if(cut, NULL, {c}) AS {c}" for c in S.EVENT_COLUMNS)}, NOT cut AS is_decoded
FROM (SELECT *, substr(parcel_id, 2)::BIGINT % 50 = 0 AS cut FROM events_raw)""",
    "validate_events": _with("events", "hubs")
    + f"""SELECT {EVENT_COLS}, hub_id IN (SELECT id FROM hubs)
    AND lat >= 50.75::DOUBLE AND lat <= 53.55::DOUBLE AND lon >= 3.36::DOUBLE AND lon <= 7.23::DOUBLE
    AND event_ts <= {VALIDATION_AS_OF} + INTERVAL 5 MINUTE AS is_valid
FROM events_raw""",
    "dead_letter": _with("flagged")
    + """SELECT event_id, parcel_id, concat_ws(',', if(ok_box, NULL, 'bbox'), if(ok_time, NULL, 'future'),
    if(ok_hub, NULL, 'hub')) AS reject_reason
FROM flagged WHERE NOT (ok_box AND ok_time AND ok_hub)""",
    "enrich_weather": _with("events", "weather")
    + f"""SELECT {", ".join("e." + c for c in S.EVENT_COLUMNS)}, weather_bad
FROM events_raw e LEFT JOIN weather w ON e.hub_id = w.hub_id""",
    "silver_events": _with("silver") + f"SELECT {SILVER_COLS} FROM silver",
    "stg_parcel_events": _with("silver") + f"SELECT {SILVER_COLS} FROM silver",
    "stg_parcels": _with("stg_parcels") + "SELECT * FROM stg_parcels",
    "dim_parcels": _with("stg_parcels") + "SELECT * FROM stg_parcels",
    "fct_parcel_events": _with("silver", "stg_parcels") + FACT,
    "gold_delivery_funnel": _with("silver") + GOLD_FUNNEL,
    "gold_on_time_by_region": _with("outcome") + GOLD_ON_TIME,
    "gold_failure_analysis": _with("outcome") + GOLD_FAILURES,
    "gold_weather_impact": _with("silver") + GOLD_WEATHER,
    "current_state": _with("state") + "SELECT * FROM state",
    "upsert_state": _with("merged") + "SELECT * FROM merged",
    "upsert_state_bucketed": _with("merged") + "SELECT * FROM merged",
    "alerts": _with("merged", "stg_parcels")
    + f"""SELECT parcel_id, status, breached, 'parcelflow alert: ' || parcel_id AS subject,
    'Parcel ' || parcel_id || ': status=' || status || ', breached=' || if(breached, 'True', 'False') || '.' AS message
FROM (SELECT m.parcel_id, m.status, m.status NOT IN ('DELIVERED', 'RETURNED') AND coalesce(
          (epoch_us({LIVE_AS_OF}) - epoch_us(created_at))::DOUBLE / 1e6::DOUBLE * {LIVE_ACCEL} > sla_hours * 3600,
          false) AS breached
      FROM merged m LEFT JOIN stg_parcels p ON m.parcel_id = p.parcel_id WHERE changed)
WHERE breached OR status = 'RETURNED'""",
    "sla_state": _with("viewed") + "SELECT parcel_id, status, sla FROM viewed",
    "live_summary_sla": _with("viewed")
    + """SELECT c.sla, count(v.parcel_id) AS n
FROM (VALUES ('on_time'), ('at_risk'), ('breached'), ('delivered'), ('unknown')) c(sla)
LEFT JOIN viewed v ON v.sla = c.sla GROUP BY c.sla""",
    "live_by_status": _with("state") + "SELECT status AS key, count(*) AS n FROM state GROUP BY status",
    "live_by_hub": _with("state") + "SELECT hub_id AS key, count(*) AS n FROM state GROUP BY hub_id ORDER BY hub_id",
    "live_totals": _with("state")
    + """SELECT count(*) AS total, count(*) FILTER (WHERE status NOT IN ('DELIVERED', 'RETURNED')) AS in_flight
FROM state""",
    "live_parcels": _worklist("true"),
    "live_parcels_at_risk": _worklist("sla = 'at_risk'"),
    "live_parcels_meta": _with("state") + "SELECT count(*) AS total, least(count(*), 200) AS shown FROM state",
    "live_map": _with("viewed") + "SELECT parcel_id, lat, lon, status, sla FROM viewed WHERE lat IS NOT NULL AND lon IS NOT NULL",
    "parcel_detail": _with("viewed") + f"SELECT {VIEW} FROM viewed WHERE parcel_id = 'P77'",
    "parcel_detail_stored": _with("viewed") + f"SELECT {VIEW} FROM viewed WHERE parcel_id = 'P77'",
    "haversine_km": _with("events", "hubs")
    + f"""SELECT event_id, round({_KM.format(lat2="hlat", lon2="hlon")}, 6) AS km
FROM events_raw LEFT JOIN hubs ON id = hub_id""",
    "nearest_hub": _with("events", "hubs")
    + f"""SELECT event_id, list_extract(near, 1) AS hub_id FROM (
    SELECT event_id, (SELECT list(id ORDER BY {_KM.format(lat2="hlat", lon2="hlon")}, pos) FROM hubs) AS near
    FROM events_raw
    WHERE event_type IN ({_list(S.DELIVERY_AREA_TYPES)}))""",
    "postcode_region": _with("stg_parcels")
    + f"""SELECT parcel_id, coalesce(region, 'Unknown') AS region,
    CASE service_level WHEN 'SAME_DAY' THEN 6 WHEN 'NEXT_DAY' THEN 24 WHEN 'STANDARD' THEN 48 END AS sla_hours
FROM stg_parcels LEFT JOIN ({_values(S.POSTCODE_REGIONS)}) t(digit, region) ON destination_postcode[1] = digit""",
    "weather_parse": _with("observed")
    + "SELECT response_id, hub_id, temperature, wind_speed, precipitation, observed_at FROM observed",
    "weather_flags": _with("observed")
    + """SELECT hub_id, coalesce(wind_speed >= 10, false) OR coalesce(precipitation >= 0.5::DOUBLE, false) AS weather_bad
FROM observed QUALIFY row_number() OVER (PARTITION BY hub_id ORDER BY fetched_at DESC, weather_bad DESC) = 1""",
    "lifecycle_violations": _with("paired")
    + """SELECT parcel_id, version, from_type, event_type AS to_type FROM ordered
WHERE place > 1 AND NOT EXISTS (SELECT 1 FROM edges WHERE a = from_type AND b = event_type)""",
    "version_gaps": _with("silver")
    + """SELECT parcel_id, count(*) AS events, min(version) AS min_version, max(version) AS max_version
FROM silver GROUP BY parcel_id HAVING list(version ORDER BY version) <> range(1, count(*)::INT + 1)""",
    "open_parcels": _with("ended")
    + "SELECT parcel_id, last_event_type FROM ended WHERE last_event_type NOT IN ('DELIVERED', 'RETURNED')",
    "lifecycle_rates": _with("ended")
    + """SELECT *, failed_share >= 0.02::DOUBLE AND failed_share <= 0.09::DOUBLE AND returned_share <= 0.03::DOUBLE AS plausible
FROM (SELECT count(*) AS parcels, count(*) FILTER (WHERE failed)::DOUBLE / count(*) AS failed_share,
             count(*) FILTER (WHERE last_event_type = 'RETURNED')::DOUBLE / count(*) AS returned_share FROM ended)""",
    "dq_orphan_events": _with("silver", "stg_parcels")
    + """SELECT parcel_id, count(*) AS events FROM silver
WHERE parcel_id NOT IN (SELECT parcel_id FROM stg_parcels) GROUP BY parcel_id""",
    "dq_promised_by": _with("parcels")
    + """SELECT parcel_id, promised_by, created_at + to_hours(sla_hours) AS expected FROM parcels_raw
WHERE promised_by <> created_at + to_hours(sla_hours)""",
    "dq_weather_coverage": _with("hubs")
    + "SELECT event_id AS response_id, id AS hub_id FROM events JOIN hubs ON pos >= event_id % 9",
    "contract_violations": _with("landed")
    + """SELECT event_id, 'parcel_id' AS field, 'missing' AS problem FROM landed WHERE k % 31 = 0
UNION ALL SELECT event_id, 'event_type', 'enum' FROM landed WHERE k % 37 = 0
UNION ALL SELECT event_id, 'lat', 'type' FROM landed WHERE k % 41 = 0
UNION ALL SELECT event_id, 'event_ts', 'type' FROM landed WHERE k % 43 = 0
UNION ALL SELECT event_id, 'version', 'type' FROM landed WHERE k % 47 = 0""",
    "dq_not_null": _with("outcome")
    + f", fact AS ({FACT}), funnel AS ({GOLD_FUNNEL}), on_time AS ({GOLD_ON_TIME}), "
    + f"failing AS ({GOLD_FAILURES}), impact AS ({GOLD_WEATHER})\n"
    + "\nUNION ALL ".join(
        _failures(table, column, source, f"{column} IS NULL")
        for table, column, source in [
            ("stg_parcel_events", "event_id", "silver"),
            ("stg_parcel_events", "parcel_id", "silver"),
            ("stg_parcel_events", "version", "silver"),
            ("stg_parcels", "parcel_id", "stg_parcels"),
            ("stg_parcels", "sla_hours", "stg_parcels"),
            ("dim_parcels", "parcel_id", "stg_parcels"),
            ("fct_parcel_events", "event_id", "fact"),
            ("gold_delivery_funnel", "event_type", "funnel"),
            ("gold_on_time_by_region", "region", "on_time"),
            ("gold_failure_analysis", "region", "failing"),
            ("gold_weather_impact", "bad_weather", "impact"),
        ]
    ),
    "dq_unique": _with("silver", "stg_parcels")
    + f", fact AS ({FACT}), funnel AS ({GOLD_FUNNEL})\n"
    + "\nUNION ALL ".join(
        _repeats(table, column, source)
        for table, column, source in [
            ("stg_parcel_events", "event_id", "silver"),
            ("stg_parcels", "parcel_id", "stg_parcels"),
            ("dim_parcels", "parcel_id", "stg_parcels"),
            ("fct_parcel_events", "event_id", "fact"),
            ("gold_delivery_funnel", "event_type", "funnel"),
            ("raw_parcel_events", "event_id", "events_raw"),
            ("raw_parcels", "parcel_id", "parcels_raw"),
        ]
    ),
    "dq_accepted_values": _with("silver", "stg_parcels", "landed")
    + "\nUNION ALL ".join(
        [
            _failures("stg_parcel_events", "event_type", "silver", f"event_type NOT IN ({_list(S.EVENT_TYPES)})"),
            _failures("stg_parcels", "service_level", "stg_parcels", f"service_level NOT IN ({_list(S.SERVICE_LEVELS)})"),
            _failures("landed_events", "event_type", "landed", "k % 37 = 0"),
        ]
    ),
}
ORACLE["nearest_hub_grid"] = ORACLE["nearest_hub"]
