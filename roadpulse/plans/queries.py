"""Registered queries: each operator run over the whole of the driver's tables."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadpulse import rules
from roadpulse.operators import anomalies, can, operations, triggers, verdict
from roadpulse.plans import fixtures as fx
from roadpulse.session import shared_dir
from roadpulse.sinks import exactly_once, kept_trail, writers
from roadpulse.sources import can_logs, signals, trigger_feed
from roadpulse.streaming import depth, live_rules, run, speed, speed_join

Query = Callable[[SparkSession, str], DataFrame]

REGISTRY: dict[str, Query] = {}
WANTED = can.wanted_signals(can.rule_sets(rules.RULES_BY_ROUTE))


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def two_decimals(text: str) -> Column:
    return F.when(
        F.col("sig_name") == rules.SPEED_SIGNAL, F.col(text).cast("decimal(10,2)").cast("string")
    ).otherwise(F.col(text))


# --- signals and anomalies ---------------------------------------------------------------


@query
def filter_valid_signals(spark, sf_dir):
    """Decoded or not, a row without a signal is dropped."""
    nested = fx.signals(spark, sf_dir).withColumn(
        "sig", F.when(F.col("seq") % 9 != 0, F.struct("sig_name", "value"))
    )
    return signals.filter_valid(nested).select("vin", "kafka_ts", "sig_ts", "seq", "sig.sig_name")


@query
def system_signal_anomalies(spark, sf_dir):
    return anomalies.system_signals(fx.signals(spark, sf_dir)).select(
        "vin", "kafka_ts", "sig_ts", "seq", "anomaly_type", "severity", "description", "sig_name",
        "current_value", "threshold_value", "value_type", "additional_info",
    )


@query
def speed_change_anomalies(spark, sf_dir):
    found = anomalies.speed_change(fx.speed_signals(spark, sf_dir))
    return found.select(
        "vin", "kafka_ts", "sig_ts", "seq", "anomaly_type", "severity", "description",
        "threshold_value", "additional_info", "current_speed", "previous_speed", "previous_seq",
        F.round(F.abs(F.col("current_speed") - F.col("previous_speed")), 2).alias("speed_diff"),
    )


@query
def speed_repeated_arrivals(spark, sf_dir):
    """A third of the rows arrives twice, and each arrival is judged."""
    rows = fx.speed_signals(spark, sf_dir)
    found = anomalies.speed_change(rows.union(rows.where("(seq ^ 31) % 3 = 0")))
    return found.select("vin", "sig_ts", "seq", "anomaly_type", "previous_seq")


@query
def speed_in_event_order(spark, sf_dir):
    """Rows up to 24 s late, judged by their times."""
    found = anomalies.speed_change(fx.state_signals(spark, sf_dir), order="event")
    return found.select("vin", "sig_ts", "seq", "anomaly_type", "previous_seq")


@query
def latest_speed(spark, sf_dir):
    latest = anomalies.latest_speed(anomalies.speed_rows(fx.state_signals(spark, sf_dir)))
    return latest.select(
        "vin", "sig_ts", F.when(~F.isnan("speed"), F.col("speed")).alias("speed"),
        F.isnan("speed").alias("is_nan"), "seq",
    )


@query
def speed_history_size(spark, sf_dir):
    return anomalies.speed_history_size(anomalies.speed_rows(fx.state_signals(spark, sf_dir)))


@query
def vehicle_anomalies(spark, sf_dir):
    return anomalies.vehicle_anomalies(fx.signals(spark, sf_dir)).withColumn(
        "current_value", two_decimals("current_value")
    )


@query
def recent_anomalies(spark, sf_dir):
    newest = anomalies.recent_anomalies(anomalies.vehicle_anomalies(fx.signals(spark, sf_dir)), 100)
    return newest.select("vin", "sig_ts", "seq", "anomaly_type", "severity", "additional_info")


# --- decoding and typing -----------------------------------------------------------------


@query
def decode_signals(spark, sf_dir):
    good = signals.coerce_values(signals.decode_signals(fx.messages(spark, sf_dir)))
    return good.select(
        "vin", "kafka_ts", "sig_ts", "seq", "sig_name", "value_type",
        "as_double", "as_integer", "as_boolean", "as_string",
    )


@query
def decode_queue_messages(spark, sf_dir):
    """Messages with the partition and offset of a queue, from which their order of arrival is made."""
    rows = fx.messages(spark, sf_dir).selectExpr("value", "cast(seq % 3 as int) as partition", "seq div 3 as offset")
    return signals.decode_signals(rows).select("vin", "kafka_ts", "sig_ts", "seq", "sig_name")


@query
def coerce_signal_value(spark, sf_dir):
    typed = signals.coerce_values(fx.mixed_values(spark, sf_dir))
    return typed.select(
        "seq", "value_type",
        F.when(~F.isnan("as_double"), F.col("as_double")).alias("as_double"),
        F.isnan("as_double").alias("is_nan"),
        "as_integer", "as_boolean", "as_string",
    )


@query
def encode_anomaly_json(spark, sf_dir):
    return anomalies.encode_json(anomalies.system_signals(fx.signals(spark, sf_dir)))


@query
def message_quarantine(spark, sf_dir):
    return signals.quarantine(fx.messages(spark, sf_dir))


@query
def ingest_drop_reasons(spark, sf_dir):
    """Dropped messages and dropped trigger records, counted together."""
    bad_messages = signals.quarantine(fx.messages(spark, sf_dir)).select("reason")
    bad_records = triggers.dropped_records(fx.trigger_pages(spark, sf_dir)).select("reason")
    return operations.drop_reasons(bad_messages.unionByName(bad_records))


# --- triggers ----------------------------------------------------------------------------


@query
def ingest_triggers(spark, sf_dir):
    return triggers.ingest(fx.trigger_pages(spark, sf_dir), fx.usage(spark, sf_dir))


@query
def match_trigger_id(spark, sf_dir):
    rows = fx.triggers(spark, sf_dir).withColumn(
        "ids", F.array(F.col("k") + 100, F.col("k"), F.col("k") % 7)
    )
    return rows.select(
        "event_id", triggers.first_allowed(F.col("ids")).alias("trigger_id")
    ).where("trigger_id is not null")


def _usage(spark, sf_dir, pick):
    found = triggers.usage_lookup(fx.triggers(spark, sf_dir), fx.usage(spark, sf_dir), pick)
    return found.select("event_id", "vin", "timestamp", "usage_type")


@query
def usage_type_lookup(spark, sf_dir):
    return _usage(spark, sf_dir, "first")


@query
def usage_type_asof(spark, sf_dir):
    return _usage(spark, sf_dir, "latest")


@query
def route_by_usage(spark, sf_dir):
    return triggers.route_by_usage(_usage(spark, sf_dir, "first"))


@query
def select_can_file(spark, sf_dir):
    return trigger_feed.select_can_file(fx.manifests(spark, sf_dir), "event_id")


# --- CAN logs and verdicts ---------------------------------------------------------------


def _frames(spark, sf_dir):
    return can_logs.parse_frames(fx.can_lines(spark, sf_dir))


def _verdicts(spark, sf_dir, mode="strict"):
    rows = _usage(spark, sf_dir, "first").select(
        "vin", "timestamp", "usage_type", F.lit("T").alias("car_type"),
        F.col("event_id").cast("string").alias("trigger_id"), F.lit("in").alias("threshold_log"),
    )
    return verdict.crash_verdict(rows, _frames(spark, sf_dir), fx.signal_defs(spark), mode=mode)


@query
def parse_can_frames(spark, sf_dir):
    return _frames(spark, sf_dir).select(
        "file", "line_no", "ts", "can_id", "payload", can_logs.error_name(F.col("error")).alias("error")
    )


@query
def decode_can_signals(spark, sf_dir):
    decoded = can.decode(_frames(spark, sf_dir), fx.signal_defs(spark), WANTED)
    return can.last_values(decoded)


@query
def can_file_status(spark, sf_dir):
    return can.file_status(_frames(spark, sf_dir), fx.signal_defs(spark), WANTED)


@query
def decode_byte_orders(spark, sf_dir):
    names = [d[2] for d in fx.ORDERED_DEFS]
    return can.decode(_frames(spark, sf_dir), fx.ordered_defs(spark), names).select("file", "line_no", "signal", "value")


def _landed_frames(spark, sf_dir):
    """Frames of log files written below the shared folder and read back in blocks of 64 KiB."""
    path, conf = shared_dir(spark, "can-logs"), "spark.sql.files.maxPartitionBytes"
    fx.write_logs(spark, sf_dir, path)
    size = spark.conf.get(conf)
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set(conf, "65536")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        # Read now, as Spark asks for the size of a block when it runs.
        can_logs.read_lines(spark, path).write.parquet(f"{path}-read")
    finally:
        spark.conf.set(conf, size)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    lines = spark.read.schema("file string, line_no bigint, line string").parquet(f"{path}-read")
    return can_logs.parse_frames(lines.withColumn("file", F.regexp_extract("file", "log=([0-9]+)/", 1)))


@query
def can_numbered_lines(spark, sf_dir):
    """Lines by their true numbers; blank ones count and are left out."""
    return _landed_frames(spark, sf_dir).select(
        "file", "line_no", "ts", "can_id", can_logs.error_name(F.col("error")).alias("error"))


@query
def can_landed_verdicts(spark, sf_dir):
    """Per landed log its first bad line, and its first crossing by the sound ones."""
    frames = _landed_frames(spark, sf_dir)
    judged = can.read_values(frames, fx.signal_defs(spark), WANTED)
    bad = judged.where("error is not null").groupBy("file").agg(F.min("line_no").alias("first_bad_line"), F.count("*").alias("n_bad"))
    crossed = can.first_crossing(frames, fx.signal_defs(spark), rules.RULES_BY_ROUTE, "lenient").select(
        "file", F.col("crossings")[0]["ts"].alias("crash_ts"), F.col("crossings")[0]["rule_index"].alias("is_crash"))
    return crossed.join(bad, "file", "left")


@query
def can_timestamps(spark, sf_dir):
    """Distinct times of each log that carry a wanted signal."""
    decoded = can.decode(_frames(spark, sf_dir), fx.signal_defs(spark), WANTED)
    return decoded.select("file", "ts").distinct()


@query
def crash_verdict(spark, sf_dir):
    return _verdicts(spark, sf_dir).select(
        "vin", "timestamp", "usage_type", "trigger_id", "threshold_log",
        "is_crash", "reason_code", "crash_ts", "route",
    )


@query
def crash_verdict_lenient(spark, sf_dir):
    return _verdicts(spark, sf_dir, "lenient").select(
        "vin", "timestamp", "trigger_id", "is_crash", "crash_ts", "route"
    )


@query
def data_log_rows(spark, sf_dir):
    return verdict.data_log_rows(_verdicts(spark, sf_dir))


def _landed(spark, sf_dir):
    """Triggers, their manifests, and the lines of the files that the manifests name."""
    rows = _usage(spark, sf_dir, "first").select(
        "vin", "timestamp", "usage_type", F.lit("T").alias("car_type"),
        F.col("event_id").cast("string").alias("trigger_id"), F.lit("in").alias("threshold_log"),
    )
    listed = trigger_feed.select_can_file(fx.manifests(spark, sf_dir)).withColumn(
        "timestamp", F.col("timestamp").cast("bigint"))
    lines = fx.can_lines(spark, sf_dir).withColumn("file", F.expr(
        "concat(if(cast(substring(file, 6) as bigint) % 4 = 0, 'a/', 'b/'), substring(file, 6))"))
    # Every thirteenth file has not landed.
    lines = lines.where("cast(substring(file, 3) as bigint) % 13 <> 0")
    return verdict.attach_logs(rows, listed, lines)


@query
def verdict_from_manifests(spark, sf_dir):
    lines, rows = _landed(spark, sf_dir)
    judged = verdict.crash_verdict(rows, can_logs.parse_frames(lines), fx.signal_defs(spark))
    return judged.select("vin", "timestamp", "trigger_id", "file", "is_crash", "crash_ts", "route")


@query
def verdict_missing(spark, sf_dir):
    """Triggers without a verdict, by reason."""
    lines, rows = _landed(spark, sf_dir)
    status = can.file_status(can_logs.parse_frames(lines), fx.signal_defs(spark), WANTED)
    return operations.drop_reasons(verdict.unjudged(rows, status))


# --- operations --------------------------------------------------------------------------


def _routed(spark, sf_dir):
    return triggers.route_by_usage(_usage(spark, sf_dir, "latest"))


@query
def queue_depth(spark, sf_dir):
    return operations.queue_depth(_routed(spark, sf_dir))


@query
def queue_backlog_alerts(spark, sf_dir):
    return operations.backlog_alerts(operations.queue_depth(_routed(spark, sf_dir)))


@query
def queue_head(spark, sf_dir):
    head = operations.queue_head(_routed(spark, sf_dir), 10, "event_id")
    return head.select("route", "place", "event_id", "vin")


@query
def process_trail(spark, sf_dir):
    trails = operations.process_trail(fx.step_events(spark, sf_dir), chunk=4)
    return operations.completed_trail(trails)


@query
def trail_from_ingest(spark, sf_dir):
    """From the trigger feed to each trigger's trail: ingest, route, crash verdict where there is a usable log, the write."""
    taken = triggers.ingest(fx.trigger_pages(spark, sf_dir), fx.usage(spark, sf_dir))
    judged = verdict.crash_verdict(taken, _frames(spark, sf_dir), fx.signal_defs(spark), keep_unjudged=True)
    steps = operations.trail_steps(judged, triggers.route_of(F.col("usage_type")))
    return operations.completed_trail(operations.process_trail(steps))


def _kept_trail(spark, sf_dir):
    """Step events merged in three increments, the second one twice; the third brings steps of logs the second has begun."""
    path = shared_dir(spark, "kept-trail")
    steps = fx.step_events(spark, sf_dir)
    for part in (0, 1, 1, 2):
        kept_trail.merge_steps(steps.where((F.col("seq") * 7 + F.col("step")) % 3 == part), path, parts=16)
    return path


@query
def trail_by_increments(spark, sf_dir):
    return operations.completed_trail(kept_trail.kept_trails(spark, _kept_trail(spark, sf_dir)))


@query
def orphans_by_increments(spark, sf_dir):
    return kept_trail.kept_orphans(spark, _kept_trail(spark, sf_dir))


@query
def route_messages(spark, sf_dir):
    """Triggers written to their routes below the shared folder and read back, route by route."""
    path = shared_dir(spark, "routes")
    taken = triggers.ingest(fx.trigger_pages(spark, sf_dir), fx.usage(spark, sf_dir))
    writers.write_routes(triggers.route_by_usage(taken), path)
    waiting = [writers.read_route(spark, path, r) for r in sorted(set(rules.USAGE_ROUTES.values()))]
    return functools.reduce(DataFrame.unionByName, waiting)


@query
def anomaly_files(spark, sf_dir):
    """Speed anomalies as JSON lines from the second place, as the first fails, read back."""
    path = shared_dir(spark, "anomaly-files")

    def fails(batch, batch_id):
        raise OSError("this place is down")

    writers.two_tier(fails, writers.json_batches(path))(anomalies.speed_change(fx.speed_signals(spark, sf_dir)), 0)
    fields = "vin string, sigTimestamp bigint, anomalyType string, severity string, thresholdValue double, additionalInfo string"
    read = spark.read.text(path).select(F.from_json("value", fields).alias("m")).select("m.*")
    return read.select("vin", F.col("sigTimestamp").alias("sig_ts"), F.col("anomalyType").alias("anomaly_type"), "severity",
                       F.col("thresholdValue").alias("threshold"), F.col("additionalInfo").alias("additional_info"))


@query
def anomaly_table(spark, sf_dir):
    """Speed anomalies as rows of the SQL table, by day, read back."""
    path = shared_dir(spark, "anomaly-table")
    writers.table_batches(path)(anomalies.speed_change(fx.speed_signals(spark, sf_dir)), 0)
    return spark.read.parquet(f"{path}/batch_id=0").select(
        "vin", "seq", "kafka_timestamp", "sig_timestamp", "anomaly_type", "severity", "additional_info", "event_date")


FACTS = ("vin string, trigger_timestamp timestamp_ntz, car_type string, use_type string, trigger_id string, is_crash int, "
         "crash_reason string, criterion_judgment string")


@query
def facts_exactly_once(spark, sf_dir):
    """Fact rows in three batches: the first breaks off between write and commit and is repeated, the second is sent
    again after its commit, and the third goes to the second place, as the first is down by then."""
    path = shared_dir(spark, "facts")
    judged = verdict.data_log_rows(_verdicts(spark, sf_dir))
    # Judged once: each batch and each try reads its rows from here.
    judged.write.parquet(f"{path}/judged")
    rows = spark.read.schema(judged.schema).parquet(f"{path}/judged")
    down = []

    def save_first(batch, folder):
        exactly_once.save_parquet(batch, folder)
        if down:
            raise OSError("this place broke off after writing")

    write = exactly_once.committed_batches(
        f"{path}/commits", [(f"{path}/first", save_first), (f"{path}/second", exactly_once.save_parquet)])
    lone = exactly_once.committed_batches(f"{path}/commits", [(f"{path}/first", save_first)])
    parts = [rows.where(f"pmod(cast(trigger_id as bigint), 3) = {i}") for i in range(3)]
    down.append(True)
    try:
        lone(parts[0], 0)
    except OSError:
        down.clear()
    for batch_id in (0, 1, 1):
        write(parts[batch_id], batch_id)
    down.append(True)
    write(parts[2], 2)
    return exactly_once.read_committed(spark, f"{path}/commits", FACTS)


@query
def process_log_orphans(spark, sf_dir):
    return operations.process_log_orphans(fx.step_events(spark, sf_dir))


@query
def messages_processed(spark, sf_dir):
    return operations.messages_processed(fx.step_events(spark, sf_dir))


@query
def message_duration_histogram(spark, sf_dir):
    return operations.duration_histogram(fx.step_events(spark, sf_dir), "duration_ms")


@query
def message_errors(spark, sf_dir):
    failed = fx.step_events(spark, sf_dir).where("status = 'failed'")
    return operations.message_errors(
        failed.withColumn("error_type", F.when(F.col("duration_ms") > 2000, "timeout").otherwise("other"))
    )


@query
def queue_size_latest(spark, sf_dir):
    return operations.queue_size_latest(fx.step_events(spark, sf_dir))


@query
def queue_wait_histogram(spark, sf_dir):
    return operations.duration_histogram(fx.step_events(spark, sf_dir), "wait_ms")


# --- the same rules on a stream ----------------------------------------------------------


def _speed_columns(found):
    return found.select(
        "vin", "kafka_ts", "sig_ts", "seq", "anomaly_type", "severity", "additional_info",
        "current_speed", "previous_speed", "previous_seq",
    )


@query
def stream_system_signals(spark, sf_dir):
    stream = fx.derive_signals(fx.event_stream(spark, sf_dir))
    found = run.drain(anomalies.system_signals(stream), "stream-system")
    return found.select("vin", "kafka_ts", "sig_ts", "seq", "anomaly_type", "severity", "current_value")


@query
def stream_speed_exact(spark, sf_dir):
    """State per time slot, as one vehicle may send a third of the feed."""
    stream = fx.derive_speed_signals(fx.event_stream(spark, sf_dir))
    return _speed_columns(run.drain(speed.exact_by_slot(stream), "stream-exact"))


@query
def stream_speed_by_vehicle(spark, sf_dir):
    """One state per vehicle; the feed in several batches by arrival, so that rows meet earlier batches."""
    stream = fx.derive_speed_signals(fx.event_batches(spark, sf_dir))
    return _speed_columns(run.drain(speed.exact(stream), "stream-vehicle"))


@query
def stream_speed_joined(spark, sf_dir):
    """The join of the stream with itself; a closing batch moves the watermark past the last rows."""
    stream = fx.derive_speed_signals(fx.event_batches(spark, sf_dir, closing=True))
    return _speed_columns(run.drain(speed_join.joined(stream), "stream-joined"))


@query
def stream_speed_late(spark, sf_dir):
    """Rows over 28 s late by what their slot still had, written beside the hits by the same pass."""
    path = shared_dir(spark, "stream-late")
    judged = speed.judge_by_slot(fx.derive_late_signals(fx.event_batches(spark, sf_dir, batches=6)))
    write = speed.hits_and_late(writers.json_batches(f"{path}/hits"), writers.row_batches(f"{path}/late"))
    run.start(judged, write, f"{path}/checkpoint", every=None).awaitTermination()
    late = spark.read.schema("vin string, seq bigint, sig_ts bigint, late_ms bigint, reason string").parquet(f"{path}/late")
    return late.groupBy("reason").agg(F.count("*").alias("total"), F.sum("late_ms").alias("late_ms"))


# --- operations on a stream ----------------------------------------------------------------


def _steps_in_windows(spark, sf_dir):
    steps = fx.derive_step_events(fx.event_batches(spark, sf_dir, closing=True))
    return operations.in_windows(steps, "6 hours")


def _metrics(metrics, purpose):
    return run.drain(operations.window_start(metrics), purpose)


@query
def stream_messages_processed(spark, sf_dir):
    return _metrics(operations.messages_processed(_steps_in_windows(spark, sf_dir), "window"), "stream-processed")


@query
def stream_message_errors(spark, sf_dir):
    failed = _steps_in_windows(spark, sf_dir).withColumn(
        "error_type", F.expr("case when status = 'failed' then if(duration_ms > 2000, 'timeout', 'other') end"))
    counted = operations.message_errors(failed, "window").where("error_type is not null")
    return _metrics(counted, "stream-errors")


LABELS = ("window", "queue_type", "vehicle_type")


@query
def stream_duration_histogram(spark, sf_dir):
    return _metrics(operations.duration_histogram(_steps_in_windows(spark, sf_dir), "duration_ms", LABELS), "stream-durations")


@query
def stream_queue_wait_histogram(spark, sf_dir):
    return _metrics(operations.duration_histogram(_steps_in_windows(spark, sf_dir), "wait_ms", LABELS), "stream-waits")


@query
def stream_queue_size(spark, sf_dir):
    return _metrics(operations.queue_size_latest(_steps_in_windows(spark, sf_dir), "window"), "stream-sizes")


@query
def stream_depth_alerts(spark, sf_dir):
    """The depth check of every six hours; a queue is listed by the events' types."""
    path = shared_dir(spark, "stream-depth")
    moves = fx.derive_queue_moves(fx.event_batches(spark, sf_dir, closing=True))
    queues = [f"{t}_triggers" for t in ("click", "view", "purchase", "error", "signup", "quiet")]
    depth.check_depth(moves, path, f"{path}/checkpoint", queues, limit=100, every=None, tick_ms=21_600_000).awaitTermination()
    return depth.alerts(spark, path)


@query
def stream_without_repeats(spark, sf_dir):
    """A third of the rows is sent twice, and each is taken once."""
    sent = fx.derive_speed_signals(fx.event_batches(spark, sf_dir)).withColumn(
        "nth", F.explode(F.expr("if(seq % 3 = 0, array(1, 2), array(1))")))
    return run.drain(run.without_repeats(speed.with_event_time(sent)).select("vin", "seq", "sig_ts"), "stream-repeats")


@query
def stream_ingest(spark, sf_dir):
    """Trigger pages ingested as they land and put on their routes, read back route by route."""
    path = shared_dir(spark, "stream-ingest")
    pages = fx.derive_trigger_pages(fx.event_batches(spark, sf_dir))
    run.ingest_pages(pages, fx.usage(spark, sf_dir), f"{path}/routes", f"{path}/checkpoint", every=None).awaitTermination()
    waiting = [writers.read_route(spark, f"{path}/routes", r) for r in sorted(set(rules.USAGE_ROUTES.values()))]
    return functools.reduce(DataFrame.unionByName, waiting)


@query
def stream_live_rules(spark, sf_dir):
    """Crash verdicts by rules read anew for every batch: after the first batch, the longitudinal limit is halved."""
    path = shared_dir(spark, "stream-rules")
    first = live_rules.threshold_rows()
    second = [(*r[:4], r[4] / 2, r[5]) if r[3] == "LongitudinalAcceleration" else r for r in first]
    live_rules.publish(spark, first, live_rules.THRESHOLDS, f"{path}/rules")

    def judge(batch, rules_by_route):
        rows = triggers.usage_lookup(fx.derive_triggers(batch), fx.usage(spark, sf_dir)).select(
            "vin", "timestamp", "usage_type", F.lit("T").alias("car_type"),
            F.col("event_id").cast("string").alias("trigger_id"), F.lit("in").alias("threshold_log"))
        frames = can_logs.parse_frames(fx.derive_can_lines(batch))
        return verdict.crash_verdict(rows, frames, fx.signal_defs(spark), rules_by_route)

    def write(judged, batch_id):
        writers.row_batches(f"{path}/verdicts")(judged, batch_id)
        if batch_id == 0:
            live_rules.publish(spark, second, live_rules.THRESHOLDS, f"{path}/rules")

    judge_batch = live_rules.judged_by(live_rules.thresholds, f"{path}/rules", judge, write)
    run.start(fx.event_batches(spark, sf_dir), judge_batch, f"{path}/checkpoint", every=None).awaitTermination()
    return spark.read.parquet(f"{path}/verdicts").select(
        "vin", "timestamp", "usage_type", "trigger_id", "threshold_log", "is_crash", "reason_code", "crash_ts", "route")
