"""The registered queries as plain SQL over the same tables.

Written from the definitions, not from the Spark plans: speed hits are an
interval self join, lookups are aggregates over joined pairs, CAN signals are
arithmetic on the integers the payloads were made of.
"""

from __future__ import annotations

# Fixed values, written out here once more so that a change of the library's own is noticed.
SYSTEM = {
    "AEB": ("AEB_TRIGGERED", "HIGH", "Autonomous Emergency Braking activated", "AEB system intervention detected"),
    "NOA_EXIT": ("NOA_EXIT", "MEDIUM", "Navigate on Autopilot exited", "NOA system disengaged"),
    "ACC_EXIT": ("ACC_EXIT", "MEDIUM", "Adaptive Cruise Control exited", "ACC system disengaged"),
    "LKA_EXIT": ("LKA_EXIT", "MEDIUM", "Lane Keeping Assist exited", "LKA system disengaged"),
}
ALLOWED = [1, 2, 3, 4, 5, 44, 62, 123, 345]
QUEUES = ["default_triggers", "production_car_triggers", "test_drive_car_triggers", "media_car_triggers",
          "internal_car_triggers", "fusion_car_triggers", "write_db_triggers"]
USAGE_ROUTES = {"production": "production_car_triggers", "test_drive": "test_drive_car_triggers",
                "media": "media_car_triggers", "internal": "internal_car_triggers"}
# Signal, threshold, reason code and text of each crash rule.
CRASH_RULES = [
    ("LongitudinalAcceleration", 1.5, 2, "信号 LongitudinalAcceleration 超过阈值 1.500000,"),
    ("LateralAcceleration", 0.8, 1, "信号 LateralAcceleration 超过阈值 0.800000,"),
    ("crash", 0.5, 3, "信号 CollisionSignal 超过阈值 0.500000,"),
]
CRASH_REASONS = {0: "未发生碰撞", 1: "横行加速度超限", 2: "纵向加速度超限", 3: "气囊弹出", 4: "方向盘转角超限"}
BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]
# The integers behind the CAN payloads.
HALF_A = "((event_id * 4 + i) % 1000003 * 2654435761) % 4294967296"
HALF_B = "((event_id * 4 + i) % 1000003 * 40503 * 1009 + 12345) % 4294967296"

VIN = "'VIN' || lpad(cast(user_id as varchar), 14, '0')"
MS = "(epoch_us(ts) // 1000)"
SIG_TS = f"({MS} // 3600)"
TEXT = "cast(cast(value as decimal(10,2)) as varchar)"
K = "cast(regexp_extract(props, '([0-9]+)', 1) as int)"


def _case(column: str, mapping: dict, default: str = "null") -> str:
    branches = " ".join(f"when {k!r} then {v!r}" for k, v in mapping.items())
    return f"case {column} {branches} else {default} end"


def _batch_of(batches: int, event: str = "event_id") -> str:
    """Number of the micro-batch of an event: cuts at multiples of 32."""
    low, high = "(select min(event_id) from events)", "(select max(event_id) from events)"
    cuts = [f"({event} >= ((({low} + ({high} + 1 - {low}) * {i} // {batches}) >> 5) << 5))::int" for i in range(1, batches)]
    return "(" + " + ".join(cuts) + ")"


SIGNALS = f"""sig as (
  select {VIN} as vin, {SIG_TS} + event_id % 1000 as kafka_ts, {SIG_TS} as sig_ts,
    xor(event_id, 31) as seq, value, event_id,
    case event_type when 'click' then 'speed' when 'error' then 'AEB' when 'purchase' then 'NOA_EXIT'
      when 'signup' then 'ACC_EXIT' when 'view' then 'LKA_EXIT' end as sig_name
  from events)"""
SPEEDS = f"""spd as (
  select {VIN} as vin, {SIG_TS} + event_id % 1000 as kafka_ts, {SIG_TS} as sig_ts,
    xor(event_id, 31) as seq, 'speed' as sig_name, value as speed
  from events)"""
STATES = f"""spd as (
  select {VIN} as vin, {SIG_TS} - event_id % 7 * 4000 as sig_ts, xor(event_id, 31) as seq,
    case when event_id % 13 = 5 then cast('NaN' as double) else value end as speed
  from events)"""
CLICKS = "spd as (select vin, kafka_ts, sig_ts, seq, sig_name, value as speed from sig where sig_name = 'speed')"
FIRED = f"""fired as (
  select vin, kafka_ts, sig_ts, seq,
    {_case('sig_name', {k: r[0] for k, r in SYSTEM.items()})} as anomaly_type,
    {_case('sig_name', {k: r[1] for k, r in SYSTEM.items()})} as severity,
    {_case('sig_name', {k: r[2] for k, r in SYSTEM.items()})} as description,
    sig_name,
    case event_id % 4 when 0 then 'true' when 1 then 'TRUE' else '1' end as current_value,
    'true' as threshold_value,
    case event_id % 4 when 0 then 'boolean' when 1 then 'string' else 'integer' end as value_type,
    {_case('sig_name', {k: r[3] for k, r in SYSTEM.items()})} as additional_info
  from sig where sig_name <> 'speed' and event_id % 4 <> 3 and value > 60)"""
HITS = f"""hits as (
  select vin, seq, kafka_ts, sig_ts, sig_name, speed, min(h) as h from (
    select a.vin, a.seq, a.kafka_ts, a.sig_ts, a.sig_name, a.speed,
      {{'tier': case when b.sig_ts >= a.sig_ts - 1000 and abs(a.speed - b.speed) > 18 then 1 else 2 end,
       'seq': b.seq, 'ts': b.sig_ts, 'speed': b.speed}} as h
    from spd a join spd b on a.vin = b.vin and b.seq < a.seq
      and b.sig_ts between a.sig_ts - 2000 and a.sig_ts
      and ((b.sig_ts >= a.sig_ts - 1000 and abs(a.speed - b.speed) > 18) or abs(a.speed - b.speed) > 24))
  group by all),
spd_anom as (
  select vin, kafka_ts, sig_ts, seq,
    case h.tier when 1 then 'SPEED_CHANGE_1S' else 'SPEED_CHANGE_2S' end as anomaly_type,
    case h.tier when 1 then 'HIGH' else 'MEDIUM' end as severity,
    case h.tier when 1 then 'Speed changed too rapidly within 1 second'
      else 'Speed changed too rapidly within 2 seconds' end as description,
    sig_name,
    case h.tier when 1 then '18.0' else '24.0' end as threshold_value,
    printf('Previous speed: %.2f m/s, Current speed: %.2f m/s, Time diff: %d ms',
      h.speed, speed, sig_ts - h.ts) as additional_info,
    speed as current_speed, h.speed as previous_speed, h.seq as previous_seq
  from hits)"""
ALL_ANOMALIES = f"""with {SIGNALS}, {CLICKS}, {FIRED}, {HITS}, allof as (
  select vin, kafka_ts, sig_ts, seq, anomaly_type, severity, description, sig_name,
    cast(cast(abs(current_speed - previous_speed) as decimal(10,2)) as varchar) as current_value,
    threshold_value, 'decimal' as value_type, additional_info,
    current_speed, previous_speed, previous_seq from spd_anom
  union all
  select *, null, null, null from fired)"""

MESSAGES = f"""msg as (
  select xor(event_id, 31) as seq, event_id, event_type, value, {VIN} as vin, {SIG_TS} as sig_ts,
    event_id % 17 as m from events)"""

# Two records per page: the sound one and the one with an odd time stamp.
RECORDS = f"""ev as (
  select *, {VIN} as vin, {MS} as ms, {K} as k, 'T' || (user_id % 5) as car_type from events
  where event_type <> 'signup'),
rec as (
  select vin, car_type, cast(ms as varchar) as stamp, [k + 100, k, k % 7] as ids from ev
  union all
  select vin, car_type,
    case event_id % 6 when 0 then '12a' when 1 then ' 12' when 2 then '1.5'
      when 3 then '9223372036854775808' when 4 then '+' || ms else cast(ms - 1000 as varchar) end,
    case when event_id % 3 = 0 then [] else [k + 100, k, k % 7] end
  from ev),
labelled as (
  select vin, car_type,
    case when regexp_full_match(stamp, '[+-]?[0-9]+') then try_cast(stamp as bigint) end as "timestamp",
    cast(list_filter(ids, lambda x: list_contains({ALLOWED}, x))[1]
      as varchar) as trigger_id
  from rec)"""

USAGE = f"""usage as (
  select case when user_id % 2 = 0 then event_id else 1000000000000 - event_id end as id,
    {VIN} as vin, {MS} as create_ms,
    case event_id % 5 when 0 then 'production' when 1 then 'test_drive' when 2 then 'media'
      when 3 then 'internal' else 'perception' end as use_type
  from events where event_type = 'signup')"""
TRIGGERS = f"""trg as (
  select event_id, {VIN} as vin, {MS} as "timestamp" from events where event_type <> 'signup')"""
FIRST = "coalesce(arg_min(u.use_type, u.id), 'none')"
LATEST = "coalesce(arg_max(u.use_type, (u.create_ms, u.id)), 'none')"


def _usage(pick: str) -> str:
    return f"""with {USAGE}, {TRIGGERS}, used as (
  select t.event_id, t.vin, t."timestamp", {pick} as usage_type
  from trg t left join usage u on t.vin = u.vin and u.create_ms <= t."timestamp"
  group by t.event_id, t.vin, t."timestamp")"""


ROUTE = _case("usage_type", USAGE_ROUTES, "'production_car_triggers'")

# One row per line that is not blank. The payload is half_a (bits 0-31) and half_b (bits 32-63).
LINES = f"""raw as (
  select event_id, {VIN} as vin, {MS} as "timestamp", {SIG_TS} as sig_ts, i, event_id % 23 as m
  from events, range(4) r(i) where event_type <> 'signup'),
halves as (select *, {HALF_A} as half_a, {HALF_B} as half_b from raw),
kinds as (
  select *, 'clip/' || event_id as file,
    printf('%08X', half_a) || printf('%08X', half_b) as hex16,
    case when i = 2 and m in (0, 1, 2, 3, 4, 5, 6, 7, 8, 9) then m when m = 10 then 10 else 99 end as kind
  from halves),
frames as (
  select file, vin, "timestamp", event_id, i as line_no,
    case kind when 1 then 'fields' when 5 then 'timestamp' when 2 then 'frame' when 3 then 'can_id'
      when 4 then 'odd_hex' when 9 then 'hex' end as error,
    case kind when 8 then 0 when 99 then sig_ts + case i when 3 then 0 else i end else sig_ts end as ts,
    cast(case when kind = 6 then 2047 when kind = 10 then 502 when kind = 99 and i = 1 then 501 else 500 end
      as bigint) as can_id,
    case kind when 7 then 'AABB' else hex16 end as payload, half_a, half_b, kind
  from kinds where kind <> 0)"""
DECODED = f"""judged as (
  select *, coalesce(error, case kind when 6 then 'unknown_id' when 7 then 'signal_range' end) as err
  from frames),
vals as (
  select file, vin, "timestamp", ts, line_no, unnest([
    {{'signal': 'LongitudinalAcceleration', 'can': 500,
      'value': (case when (half_a >> 16) >= 32768 then (half_a >> 16) - 65536 else half_a >> 16 end)
               * cast(0.0001 as double) + cast(0 as double)}},
    {{'signal': 'LateralAcceleration', 'can': 500,
      'value': (case when half_a % 4096 >= 2048 then half_a % 4096 - 4096 else half_a % 4096 end)
               * cast(0.001 as double) + cast(-0.25 as double)}},
    {{'signal': 'crash', 'can': 501, 'value': cast((half_b >> 24) % 2 as double)}}]) as v, can_id
  from judged where err is null and ts <> 0),
lastv as (
  select file, vin, "timestamp", ts, v.signal as signal, arg_max(v.value, line_no) as value
  from vals where v.can = can_id group by all),
status as (
  select j.file, count(*) as n_lines, count(j.err) as n_bad,
    coalesce(arg_min(j.err, j.line_no) filter (where j.err is not null),
      case when count(*) filter (where j.err is null and j.ts <> 0 and j.can_id in (500, 501)) = 0
        then 'no_signal' end) as error
  from judged j group by j.file)"""
# Log files of the lines of 2500 events each, blank lines counted.
NUMBERED = """numbered as (
  select event_id, i, (event_id // 2500)::varchar as log,
    row_number() over (partition by event_id // 2500 order by event_id, i) as line_no
  from raw)"""
RULE_ROWS = ", ".join(
    f"({i + 1}, {signal!r}, cast({threshold} as double), {code}, {text!r})"
    for i, (signal, threshold, code, text) in enumerate(CRASH_RULES)
)


def _verdict(usable: str, rule_rows: str = RULE_ROWS, more: str = "") -> str:
    return _usage(FIRST) + f""", {LINES}, {DECODED},
rule(idx, signal, threshold, reason_code, info) as (values {rule_rows}),
crossed as (
  select file, min({{'ts': ts, 'idx': idx}}) as c
  from lastv join rule using (signal) where value > threshold {more} group by file),
verdict as (
  select u.vin, u."timestamp", u.usage_type, cast(u.event_id as varchar) as trigger_id,
    'in;' || coalesce(r.info, '') as threshold_log,
    cast(coalesce(c.c.idx, 0) as int) as is_crash, coalesce(r.reason_code, 0) as reason_code,
    c.c.ts as crash_ts,
    case when c.c.idx is null then 'fusion_car_triggers' else 'write_db_triggers' end as route
  from used u join status s on s.file = 'clip/' || u.event_id
    left join crossed c using (file) left join rule r on r.idx = c.c.idx
  where {usable})"""


LATER_RULES = [(s, t / 2 if s == "LongitudinalAcceleration" else t, c, x.replace("1.500000", "0.750000"))
               for s, t, c, x in CRASH_RULES]
LIVE_RULE_ROWS = RULE_ROWS + ", " + ", ".join(
    f"({i + 11}, {signal!r}, cast({threshold} as double), {code}, {text!r})"
    for i, (signal, threshold, code, text) in enumerate(LATER_RULES)
)
LIVE = f"(idx > 10) = ({_batch_of(3, 'cast(substr(file, 6) as bigint)')} > 0)"
STRICT = _verdict("s.error is null")
LENIENT = _verdict("exists (select 1 from lastv l where l.file = s.file)")

STEPS = f"""st as (
  select event_id // 6 as log_id, event_id % 6 as step,
    case when event_id % 6 = 5 and event_id % 4 = 0 then 'DB Write Success'
      else event_type || '_triggers' end as name,
    (event_id % 6 = 0 and (event_id // 6) % 11 <> 0) as is_insert,
    event_type || '_triggers' as queue_type, 'T' || (user_id % 5) as vehicle_type,
    case when value > 60 then 'failed' else 'ok' end as status,
    cast(round(value * 20) as bigint) as duration_ms, event_id % 11 * 5 as wait_ms,
    {MS} as ts, event_id as seq, cast(trunc(value) as bigint) as size
  from events)"""


def _histogram(column: str, more: str = "") -> str:
    bounds = ", ".join(f"('{b}', {round(b * 1000)})" for b in BOUNDS)
    return f"""with {STEPS}, bound(le, ms) as (values {bounds}, ('+Inf', null))
select {more} queue_type, vehicle_type, le,
  count(*) filter (where ms is null or {column} <= ms) as count,
  cast(sum({column}) as double) / 1000 as sum_seconds, count(*) as total
from st, bound group by all"""


WINDOW = "ts // 21600000 * 21600000 as window_start,"


LOG_ID = """cast('0x' || substr(md5(k.vin || '|' || k."timestamp" || '|' || k.trigger_id), 1, 15) as bigint)"""
TAKEN = f"""kept as (select *, row_number() over () as n from labelled
  where "timestamp" is not null and trigger_id is not null),
taken as (
  select k.vin, k."timestamp", k.car_type, {FIRST} as usage_type, k.trigger_id, {LOG_ID} as log_id
  from kept k left join usage u on k.vin = u.vin and u.create_ms <= k."timestamp"
  group by k.n, k.vin, k."timestamp", k.car_type, k.trigger_id)"""


ORACLE: dict[str, str] = {
    "filter_valid_signals": f"""with {SIGNALS}
select vin, kafka_ts, sig_ts, seq, sig_name from sig where seq % 9 <> 0""",
    "system_signal_anomalies": f"with {SIGNALS}, {FIRED} select * from fired",
    "speed_change_anomalies": f"""with {SPEEDS}, {HITS}
select * exclude (sig_name), round(abs(current_speed - previous_speed), 2) as speed_diff from spd_anom""",
    "latest_speed": f"""with {STATES}
select vin, sig_ts, case when not isnan(speed) then speed end as speed, isnan(speed) as is_nan, seq from spd
qualify row_number() over (partition by vin order by sig_ts desc, seq) = 1""",
    # A row goes once a newcomer, itself or an earlier one, is over 30 s newer than it and all before it.
    "speed_history_size": f"""with {STATES}, run as (
  select *, max(sig_ts) over (partition by vin order by seq) as latest from spd)
select a.vin, a.seq, a.sig_ts, count(*) as history_size, count(*) > 1 as has_history
from run a join run b on a.vin = b.vin and b.seq <= a.seq and b.latest >= a.latest - 30000
group by a.vin, a.seq, a.sig_ts""",
    "vehicle_anomalies": f"{ALL_ANOMALIES} select * from allof",
    "recent_anomalies": f"""{ALL_ANOMALIES}
select vin, sig_ts, seq, anomaly_type, severity, additional_info from allof
order by sig_ts desc, vin, anomaly_type, seq limit 100""",
    "decode_signals": f"""with {MESSAGES}, good as (select * from msg where m > 4)
select vin,
  case when m = 6 then 0 when m in (5, 7) then sig_ts else sig_ts + event_id % 1000 end as kafka_ts,
  case when m = 6 then 0 else sig_ts end as sig_ts, seq, event_type as sig_name,
  case when m = 5 then 'boolean' when m = 6 then 'null' when m = 7 then 'string' else 'decimal' end as value_type,
  case when m > 6 then value end as as_double,
  case when m > 7 then cast(trunc(value) as bigint) end as as_integer,
  case when m = 5 then true when m = 7 then false when m > 7 then trunc(value) <> 0 end as as_boolean,
  case when m = 5 then 'true' when m = 7 then {TEXT} when m > 7 then cast(value as varchar) end as as_string
from good""",
    "coerce_signal_value": f"""with ev as (select event_id, event_id % 16 as m, value,
    case when event_id % 32 = 14 then cast(event_id % 1000 as hugeint) * 4294967296
      else cast((event_id % 1000 + 1) || '0000000000000000000003' as hugeint) end as big
  from events)
select event_id as seq,
  case when m < 2 then 'boolean' when m < 10 then 'string' when m = 12 then 'null'
    when m in (13, 14) then 'integer' else 'decimal' end as value_type,
  case m when 4 then 1.0 when 5 then value when 9 then 12.0 when 10 then 0.5 when 11 then -1.9
    when 13 then cast(event_id as double) when 14 then cast(big as double)
    when 15 then value end as as_double,
  m = 6 as is_nan,
  cast(case m when 4 then 1 when 10 then 0 when 11 then -1 when 13 then event_id
    when 14 then case when big % 4294967296 >= 2147483648 then big % 4294967296 - 4294967296 else big % 4294967296 end
    when 15 then trunc(value) end as bigint) as as_integer,
  case when m in (0, 2) then true when m < 11 then false when m = 11 then true
    when m = 14 then big % 4294967296 <> 0 when m = 13 then event_id <> 0 when m = 15 then trunc(value) <> 0 end as as_boolean,
  case m when 0 then 'true' when 1 then 'false' when 2 then 'TRUE' when 3 then 'yes' when 4 then '1'
    when 5 then {TEXT} when 6 then 'NaN' when 7 then 'nan' when 8 then '12abc' when 9 then ' 12 '
    when 10 then '0.5' when 11 then '-1.9' when 13 then cast(event_id as varchar)
    when 14 then cast(big as varchar) when 15 then cast(value as varchar)
    end as as_string
from ev""",
    "encode_anomaly_json": f"""with {SIGNALS}, {FIRED}
select vin, seq, anomaly_type,
  '{{"vin":"' || vin || '","kafkaTimestamp":' || kafka_ts || ',"sigTimestamp":' || sig_ts
  || ',"anomalyType":"' || anomaly_type || '","severity":"' || severity
  || '","description":"' || description || '","sigName":"' || sig_name || '","currentValue":'
  || case value_type when 'string' then '"' || current_value || '"' else current_value end
  || ',"thresholdValue":true,"additionalInfo":"' || additional_info || '"}}' as value
from fired""",
    "message_quarantine": f"""with {MESSAGES}
select seq,
  case m when 0 then '' when 1 then '{{bad' || event_id
    when 2 then '{{"vin":"' || vin || '","sigTimestamp":' || sig_ts || '}}'
    when 3 then '{{"sig":{{"sigName":"' || event_type || '","value":1}}}}'
    else '{{"vin":"' || vin || '","sigTimestamp":"' || sig_ts || 'x","sig":{{"sigName":"' || event_type
      || '","value":1}}}}' end as raw,
  case m when 0 then 'empty' when 1 then 'malformed_json' when 2 then 'no_sig' when 3 then 'no_vin'
    else 'bad_timestamp' end as reason
from msg where m <= 4""",
    "ingest_drop_reasons": f"""with {MESSAGES}, {RECORDS}, dropped as (
  select case m when 0 then 'empty' when 1 then 'malformed_json' when 2 then 'no_sig' when 3 then 'no_vin'
    else 'bad_timestamp' end as reason from msg where m <= 4
  union all
  select case when "timestamp" is null then 'bad_timestamp' else 'no_allowed_trigger' end from labelled
  where "timestamp" is null or trigger_id is null)
select reason, count(*) as total from dropped group by reason""",
    "ingest_triggers": f"""with {RECORDS}, {USAGE},
kept as (select *, row_number() over () as n from labelled
  where "timestamp" is not null and trigger_id is not null)
select k.vin, k."timestamp", k.car_type, {FIRST} as usage_type, k.trigger_id,
  {LOG_ID} as log_id, '' as threshold_log, 0 as is_crash
from kept k left join usage u on k.vin = u.vin and u.create_ms <= k."timestamp"
group by k.n, k.vin, k."timestamp", k.car_type, k.trigger_id""",
    "route_messages": f"""with {RECORDS}, {USAGE}, {TAKEN}
select vin, "timestamp", car_type, usage_type, trigger_id, log_id, '' as threshold_log, 0 as is_crash, {ROUTE} as route
from taken""",
    "trail_from_ingest": f"""with {RECORDS}, {USAGE}, {TAKEN}, {LINES}, {DECODED},
rule(idx, signal, threshold, reason_code, info) as (values {RULE_ROWS}),
crossed as (select distinct file from lastv join rule using (signal) where value > threshold),
judged_logs as (
  select distinct f.vin, f."timestamp", case when c.file is null then 'fusion_car_triggers' else 'write_db_triggers' end as verdict
  from frames f join status s using (file) left join crossed c using (file) where s.error is null),
st as (
  select distinct log_id, unnest([1, 2, 3, 4]) as step,
    unnest(['default_triggers', {ROUTE}, verdict, case when verdict = 'write_db_triggers' then 'DB Write Success' end]) as name
  from taken left join judged_logs using (vin, "timestamp"))
select log_id, string_agg(name, ' -> ' order by step) as process_log,
  replace(arg_max(name, step), 'DB Write Success', 'Completed') as process_status, count(*) as n_steps
from st where name is not null group by log_id""",
    "anomaly_files": f"""with {SPEEDS}, {HITS}
select vin, sig_ts, anomaly_type, severity, cast(threshold_value as double) as threshold, additional_info from spd_anom""",
    "verdict_from_manifests": f"""{STRICT}
select vin, "timestamp", trigger_id, case cast(trigger_id as bigint) % 4 when 0 then 'a/' else 'b/' end || trigger_id as file,
  is_crash, crash_ts, route
from verdict where cast(trigger_id as bigint) % 4 < 2 and cast(trigger_id as bigint) % 13 <> 0""",
    "verdict_missing": f"""{STRICT}, why as (
  select case when u.event_id % 4 > 1 then 'no_can_file' when u.event_id % 13 = 0 then 'missing_file' else s.error end as reason
  from used u join status s on s.file = 'clip/' || u.event_id)
select reason, count(*) as total from why where reason is not null group by reason""",
    "match_trigger_id": f"""with ids as (
  select event_id, unnest([1, 2, 3]) as p, unnest([k + 100, k, k % 7]) as x
  from (select event_id, {K} as k from events where event_type <> 'signup'))
select event_id, cast(arg_min(x, p) as varchar) as trigger_id from ids
where x in ({', '.join(map(str, ALLOWED))}) group by event_id""",
    "usage_type_lookup": f"{_usage(FIRST)} select * from used",
    "usage_type_asof": f"{_usage(LATEST)} select * from used",
    "route_by_usage": f"{_usage(FIRST)} select *, {ROUTE} as route from used",
    "select_can_file": f"""select event_id, {VIN} as vin, cast({MS} as varchar) as "timestamp",
  case event_id % 4 when 0 then 'a/' || event_id when 1 then 'b/' || event_id end as file_url,
  case when event_id % 4 > 1 then 'no_can_file' end as error
from events""",
    "parse_can_frames": f"""with {LINES}
select file, line_no,
  case when error is null then ts end as ts,
  case when error is null then can_id end as can_id,
  case when error is null then payload end as payload, error
from frames""",
    "decode_can_signals": f"with {LINES}, {DECODED} select file, ts, signal, value from lastv",
    "can_file_status": f"with {LINES}, {DECODED} select *, error is null as usable from status",
    "can_timestamps": f"with {LINES}, {DECODED} select distinct file, ts from lastv",
    "crash_verdict": f"{STRICT} select * from verdict",
    "crash_verdict_lenient": f"""{LENIENT}
select vin, "timestamp", trigger_id, is_crash, crash_ts, route from verdict""",
    "data_log_rows": f"""{STRICT}
select vin, make_timestamp("timestamp" * 1000) as trigger_timestamp, 'T' as car_type, usage_type as use_type, trigger_id,
  is_crash, {_case('reason_code', CRASH_REASONS, "''")} as crash_reason,
  threshold_log as criterion_judgment
from verdict""",
    "queue_depth": f"""{_usage(LATEST)},
queues(route) as (values {', '.join(f"('{q}')" for q in QUEUES)}),
routed as (select {ROUTE} as route from used)
select q.route, count(r.route) as depth from queues q left join routed r on q.route = r.route group by q.route""",
    "queue_backlog_alerts": f"""{_usage(LATEST)},
routed as (select {ROUTE} as route from used)
select route, count(*) as depth,
  'Alert: Queue ' || route || ' length ' || count(*) || ' exceeds or equals threshold 1000' as message
from routed group by route having count(*) >= 1000""",
    "queue_head": f"""{_usage(LATEST)},
routed as (select *, {ROUTE} as route from used)
select route, cast(row_number() over (partition by route order by event_id) as int) as place, event_id, vin
from routed qualify place <= 10""",
    "process_trail": f"""with {STEPS}
select log_id, string_agg(name, ' -> ' order by step) as process_log,
  replace(arg_max(name, step), 'DB Write Success', 'Completed') as process_status, count(*) as n_steps
from st group by log_id""",
    "process_log_orphans": f"""with {STEPS}
select log_id, count(*) as n_updates from st u where not exists
  (select 1 from st i where i.log_id = u.log_id and i.is_insert) group by log_id""",
    "messages_processed": f"""with {STEPS}
select queue_type, vehicle_type, status, count(*) as total from st group by all""",
    "message_duration_histogram": _histogram("duration_ms"),
    "message_errors": f"""with {STEPS}
select queue_type, vehicle_type, case when duration_ms > 2000 then 'timeout' else 'other' end as error_type,
  count(*) as total
from st where status = 'failed' group by all""",
    "queue_size_latest": f"""with {STEPS}
select queue_type, vehicle_type, arg_max(size, (ts, seq)) as size from st group by all""",
    "queue_wait_histogram": _histogram("wait_ms"),
    "stream_system_signals": f"""with {SIGNALS}, {FIRED}
select vin, kafka_ts, sig_ts, seq, anomaly_type, severity, current_value from fired""",
    "stream_speed_exact": f"""with {SPEEDS}, {HITS}
select vin, kafka_ts, sig_ts, seq, anomaly_type, severity, additional_info,
  current_speed, previous_speed, previous_seq from spd_anom""",
    "stream_speed_joined": f"""with {SPEEDS}, {HITS}
select vin, kafka_ts, sig_ts, seq, anomaly_type, severity, additional_info,
  current_speed, previous_speed, previous_seq from spd_anom""",
    "stream_speed_by_vehicle": f"""with {SPEEDS}, {HITS}
select vin, kafka_ts, sig_ts, seq, anomaly_type, severity, additional_info,
  current_speed, previous_speed, previous_seq from spd_anom""",
    # A slot is kept from its last rows on while the watermark, 28 s behind the newest of the earlier batches,
    # is not 30 s past its end and past what it was then.
    "stream_speed_late": f"""with ev as (
  select event_id, {VIN} as vin, {_batch_of(6)} as batch,
    {SIG_TS} - case event_id % 97 when 3 then 60000 when 50 then 200000 else 0 end as ts
  from events),
marks as (
  select batch, coalesce(max(newest) over (order by batch rows between unbounded preceding and 1 preceding) - 28000, 0) as mark
  from (select batch, max(ts) as newest from ev group by batch)),
touched as (
  select distinct vin, batch, unnest(case when ts % 10000 >= 8000 then [ts // 10000, ts // 10000 + 1] else [ts // 10000] end) as slot
  from ev),
late as (
  select event_id, vin, batch, ts // 10000 as slot, mark, mark - ts as late_ms from ev join marks using (batch) where ts < mark),
lasting as (
  select l.event_id, l.mark, l.slot, l.late_ms, max(t.batch) as last
  from late l left join touched t on t.vin = l.vin and t.slot = l.slot and t.batch < l.batch
  group by l.event_id, l.mark, l.slot, l.late_ms)
select case when last is not null and l.mark < greatest((slot + 1) * 10000, at_last.mark) + 30000 then 'slot_kept' else 'slot_gone' end as reason,
  count(*) as total, sum(late_ms)::bigint as late_ms
from lasting l left join marks at_last on at_last.batch = l.last
group by reason""",
    "stream_messages_processed": f"""with {STEPS}
select {WINDOW} queue_type, vehicle_type, status, count(*) as total from st group by all""",
    "stream_message_errors": f"""with {STEPS}
select {WINDOW} queue_type, vehicle_type, case when duration_ms > 2000 then 'timeout' else 'other' end as error_type,
  count(*) as total
from st where status = 'failed' group by all""",
    "stream_duration_histogram": _histogram("duration_ms", WINDOW),
    "stream_queue_wait_histogram": _histogram("wait_ms", WINDOW),
    "stream_queue_size": f"""with {STEPS}
select {WINDOW} queue_type, vehicle_type, arg_max(size, (ts, seq)) as size from st group by all""",
    "stream_depth_alerts": f"""with moves as (
  select {MS} // 21600000 as tick, event_type || '_triggers' as route, case when event_id % 3 = 2 then -1 else 1 end as delta
  from events),
ticks as (
  select tick, route from (select unnest(range(min(tick), max(tick) + 1)) as tick from moves),
    (select unnest(['click', 'view', 'purchase', 'error', 'signup', 'quiet']) || '_triggers' as route)),
depths as (
  select t.tick, t.route, (select coalesce(sum(delta), 0) from moves m where m.route = t.route and m.tick <= t.tick)::bigint as depth
  from ticks t)
select tick, route, depth, 'Alert: Queue ' || route || ' length ' || depth || ' exceeds or equals threshold 100' as message
from depths where depth >= 100""",
    # Rules of the first batch have indexes to 3, those of the later ones from 11 on.
    "stream_live_rules": _verdict("s.error is null", LIVE_RULE_ROWS, "and " + LIVE)
    + " select * replace (is_crash % 10 as is_crash) from verdict",
    "speed_in_event_order": f"""with {STATES}, sound as (select * from spd where not isnan(speed)), hits as (
  select a.vin, a.sig_ts, a.seq, min({{
      'tier': case when b.sig_ts >= a.sig_ts - 1000 and abs(a.speed - b.speed) > 18 then 1 else 2 end,
      'ts': b.sig_ts, 'seq': b.seq}}) as h
  from sound a join sound b on a.vin = b.vin and b.sig_ts between a.sig_ts - 2000 and a.sig_ts
    and (b.sig_ts < a.sig_ts or b.seq < a.seq)
    and ((b.sig_ts >= a.sig_ts - 1000 and abs(a.speed - b.speed) > 18) or abs(a.speed - b.speed) > 24)
  group by all)
select vin, sig_ts, seq, 'SPEED_CHANGE_' || h.tier || 'S' as anomaly_type, h.seq as previous_seq from hits""",
    # le and be: the payload's bytes as one number, from the last byte down and from the first byte down.
    "decode_byte_orders": f"""with {LINES}, {DECODED}, words as (
  select *, (half_a::hugeint << 32) + half_b as be,
    (half_a >> 24) + (((half_a >> 16) % 256) << 8) + (((half_a >> 8) % 256) << 16) + ((half_a % 256) << 24)
      + (((half_b >> 24)::hugeint + (((half_b >> 16) % 256) << 8) + (((half_b >> 8) % 256) << 16) + ((half_b % 256) << 24)) << 32) as le
  from judged where err is null and ts <> 0 and kind <> 10),
cut as (
  select file, line_no, can_id, unnest([
    {{'can': 500, 'signal': 'low_word', 'bits': (le >> 8) % 65536, 'size': 16, 'factor': 1, 'shift': 0}},
    {{'can': 500, 'signal': 'high_word', 'bits': be >> 48, 'size': 0, 'factor': 0.5, 'shift': -3}},
    {{'can': 500, 'signal': 'whole', 'bits': le, 'size': 64, 'factor': 1, 'shift': 0}},
    {{'can': 500, 'signal': 'across', 'bits': (le >> 13) % 2097152, 'size': 0, 'factor': 1, 'shift': 0}},
    {{'can': 500, 'signal': 'down', 'bits': (be >> 30) % 16384, 'size': 14, 'factor': 1, 'shift': 0}},
    {{'can': 501, 'signal': 'flag', 'bits': (le >> 39) % 2, 'size': 0, 'factor': 1, 'shift': 0}}]) as s
  from words)
select file, line_no, s.signal as signal,
  (case when s.size > 0 and s.bits >= (1::hugeint << (s.size - 1)) then s.bits - (1::hugeint << s.size) else s.bits end)::bigint::double
    * s.factor::double + s.shift as value
from cut where s.can = can_id""",
    "can_numbered_lines": f"""with {LINES}, {NUMBERED}
select log as file, n.line_no, ts, case when error is null then can_id end as can_id, error from frames f join numbered n
  on n.event_id = f.event_id and n.i = f.line_no""".replace(" ts, case", " case when error is null then ts end as ts, case"),
    "can_landed_verdicts": f"""with {LINES}, {DECODED}, {NUMBERED},
rule(idx, signal, threshold, reason_code, info) as (values {RULE_ROWS}),
good as (
  select log, ts, n.line_no, v.signal as signal, v.value as value
  from vals join numbered n on 'clip/' || n.event_id = vals.file and n.i = vals.line_no where v.can = can_id),
latest as (select log, ts, signal, arg_max(value, line_no) as value from good group by all),
crossed as (
  select log, min({{'ts': ts, 'idx': idx}}) as c from latest join rule using (signal) where value > threshold group by log),
bad as (
  select log, min(n.line_no) as first_bad_line, count(*) as n_bad
  from judged j join numbered n on n.event_id = j.event_id and n.i = j.line_no where err is not null group by log)
select log as file, c.ts as crash_ts, c.idx::int as is_crash, first_bad_line, n_bad
from (select distinct log from good) left join crossed using (log) left join bad using (log)""",
    "speed_repeated_arrivals": f"""with {SPEEDS}, {HITS}
select vin, sig_ts, seq, anomaly_type, previous_seq from spd_anom
union all
select vin, sig_ts, seq, anomaly_type, previous_seq from spd_anom where xor(seq, 31) % 3 = 0""",
}
ORACLE["trail_by_increments"] = ORACLE["process_trail"]
ORACLE["orphans_by_increments"] = ORACLE["process_log_orphans"]
ORACLE["facts_exactly_once"] = ORACLE["data_log_rows"]
ORACLE["stream_ingest"] = ORACLE["route_messages"]
ORACLE["stream_without_repeats"] = f"with {SPEEDS} select vin, seq, sig_ts from spd"
ORACLE["anomaly_table"] = f"""with {SPEEDS}, {HITS}
select vin, seq, kafka_ts as kafka_timestamp, sig_ts as sig_timestamp, anomaly_type, severity, additional_info,
  (epoch_ms(sig_ts))::date as event_date from spd_anom"""
ORACLE["decode_queue_messages"] = f"""{ORACLE["decode_signals"].split("select vin,")[0]}
select vin,
  case when m = 6 then 0 when m in (5, 7) then sig_ts else sig_ts + event_id % 1000 end as kafka_ts,
  case when m = 6 then 0 else sig_ts end as sig_ts, seq % 3 * 281474976710656 + seq // 3 as seq, event_type as sig_name
from good"""
