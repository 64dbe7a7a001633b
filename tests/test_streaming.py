import json
import os
import random
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.test_detection import THRESHOLDS, beat, edi, iso, reading
from tests.test_memory import PEAKS, cascade
from tracewell.operators import matches as M
from tracewell.plans.detection import cascades, missing_heartbeats, order_violations
from tracewell.schemas import RECORD
from tracewell.sources.dimensions import baselines_from
from tracewell.sources.topics import file_record_stream, file_records, kafka_options, pattern_topics
from tracewell.streaming import jobs
from tracewell.streaming.detectors import (
    distinct_stream,
    stream_cascades,
    stream_missing_heartbeats,
    stream_order_violations,
)
from tracewell.streaming.processors import CHUNK, DeadlineProcessor


def write_files(folder, batches, first=0):
    """One file per micro-batch of (offset, value) pairs; files are read in order of their time."""
    folder.mkdir(exist_ok=True)
    for i, batch in enumerate(batches, first):
        lines = [json.dumps({"topic": "plant.sensors", "value": v if isinstance(v, str) else json.dumps(v), "offset": o}) for o, v in batch]
        path = folder / f"{i:03d}.json"
        path.write_text("\n".join(lines))
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    return str(folder)


def run(stream, tmp_path, name="q"):
    out, checkpoint = str(tmp_path / f"{name}-out"), str(tmp_path / f"{name}-cp")
    query = (
        stream.withColumn("source_json", F.to_json("source_json")).writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.parquet(out), query


def rows(df):
    return sorted((r.machine_id, r.detected_at, r.violation_type or "", r.source_json) for r in df.collect())


def batch_rows(df):
    return rows(df.withColumn("source_json", F.to_json("source_json")))


def jittered(values, seconds, batches, seed):
    """Values with their time in seconds, in an arrival order that is off by at most ``seconds``."""
    rng = random.Random(seed)
    ordered = sorted(values, key=lambda x: x[0] + rng.random() * seconds)
    numbered = [(i, v) for i, (_, v) in enumerate(ordered)]
    size = -(-len(numbered) // batches)
    return [numbered[i : i + size] for i in range(0, len(numbered), size)]


def test_stream_cascades_equal_batch(spark, tmp_path):
    rng = random.Random(1)
    machines = [f"m{i}" for i in range(4)]
    values = []
    for i in range(500):
        t = rng.randrange(0, 6000) + rng.random()
        steps = "".join(s for s in "ABC" if rng.random() < 0.2)
        values.append((t, reading(t, steps, rng.choice(machines))))
    files = jittered(values, 4.5, 5, 2)
    files[2].append((9000, "{broken"))
    drain = [(10_000, reading(20_000, "", "drain"))], [(10_001, reading(20_001, "", "drain"))]
    source = write_files(tmp_path / "in", [*files, *drain])
    baselines = baselines_from(spark, {m: THRESHOLDS for m in [*machines, "drain"]})
    stream = stream_cascades(file_record_stream(spark, source, files_per_batch=1), baselines)
    got, query = run(stream, tmp_path)
    want = batch_rows(cascades(file_records(spark, source), baselines))
    assert len(want) > 20 and rows(got) == want


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    baselines = baselines_from(spark, {"Machine-03": THRESHOLDS})
    source = write_files(tmp_path / "in", [
        [(0, reading(0, "A"))], [(1, reading(300, "C"))], [(2, reading(400))], [(3, reading(500))],
        [(4, reading(100, "B"))], [(5, reading(5000))], [(6, reading(5001))],
    ])
    got, query = run(stream_cascades(file_record_stream(spark, source, files_per_batch=1), baselines), tmp_path)
    assert got.count() == 0
    dropped = sum(o.numRowsDroppedByWatermark for p in query.recentProgress for o in p.stateOperators)
    assert dropped == 1


def test_stream_heartbeats_equal_batch_across_restart(spark, tmp_path):
    rng = random.Random(3)
    batches, offset = [], 0
    for _ in range(4):
        batch = []
        for _ in range(60):
            batch.append((offset, beat(offset * 20 + rng.randrange(-60, 60), offset, rng.choice(["a", "b", "c"]))))
            offset += 1
        batches.append(batch)
    source = write_files(tmp_path / "in", batches[:2])
    stream = lambda: stream_missing_heartbeats(file_record_stream(spark, source, files_per_batch=1))
    run(stream(), tmp_path)
    write_files(tmp_path / "in", batches[2:], first=2)
    got, _ = run(stream(), tmp_path)
    want = batch_rows(missing_heartbeats(file_records(spark, source)))
    assert len(want) > 20 and rows(got) == want


@pytest.mark.parametrize("retain_ms", [None, 10 * 86_400_000])
def test_stream_order_flow_equals_batch(spark, tmp_path, retain_ms):
    rng = random.Random(6)
    values = []
    for i in range(300):
        minutes = rng.randrange(0, 3000)
        event = edi(rng.choice(["order", "shipment", "invoice"]), minutes, f"o{rng.randrange(25)}")
        event["event_id"] = f"e{i}"
        values.append((minutes * 60 + i / 1000, dict(event, event_time=iso(minutes * 60 + i / 1000))))
    files = jittered(values, 4, 4, 7)
    far = 3000 + 100_000
    drain = [(5000, edi("other", far, "drain"))], [(5001, edi("other", far, "drain"))]
    source = write_files(tmp_path / "in", [*files, *drain])
    stream = stream_order_violations(file_record_stream(spark, source, files_per_batch=1), retain_ms=retain_ms)
    got, _ = run(stream, tmp_path)
    end = file_records(spark, source)
    want = batch_rows(order_violations(end, as_of=1767225600000 + far * 60_000))
    kinds = {r[2] for r in want}
    assert len(kinds) == 3 and rows(got) == want


def test_stream_order_flow_by_arrival_equals_batch(spark, tmp_path):
    """Files with hours of disorder: no row is dropped as late, whatever the watermark."""
    rng = random.Random(16)
    values = []
    for i in range(400):
        minutes = i * 20 - rng.randrange(200)
        event = edi(rng.choice(["order", "shipment", "invoice"]), minutes, f"o{rng.randrange(30)}")
        values.append((i, dict(event, event_id=f"e{i}", event_time=iso(minutes * 60 + i / 1000))))
    files = [values[i : i + 80] for i in range(0, 400, 80)]
    far = 100_000
    drain = [(5000, edi("other", far, "drain"))], [(5001, edi("other", far, "drain"))]
    source = write_files(tmp_path / "in", [*files, *drain])
    # No deadline passes the watermark before the answer is in, as the window is longer than the disorder.
    stream = stream_order_violations(file_record_stream(spark, source, files_per_batch=1), order_by="arrival", delay="4 hours")
    got, _ = run(stream, tmp_path)
    want = batch_rows(order_violations(file_records(spark, source), as_of=1767225600000 + far * 60_000, order_by="arrival"))
    by_time = batch_rows(order_violations(file_records(spark, source), as_of=1767225600000 + far * 60_000))
    assert len({r[2] for r in want}) == 3 and rows(got) == want != by_time


def test_many_open_starts(spark, tmp_path):
    """Starts by the hundred on one machine, ended now and then."""
    rng = random.Random(3)
    values = [(t, reading(t, "A" if rng.random() < 0.97 else rng.choice(["B", "C", "AB", "BC"]), "m0")) for t in range(0, 4000, 2)]
    files = jittered(values, 4.5, 3, 2)
    drain = [(10_000, reading(20_000, "", "drain"))], [(10_001, reading(20_001, "", "drain"))]
    source = write_files(tmp_path / "in", [*files, *drain])
    baselines = baselines_from(spark, {m: THRESHOLDS for m in ("m0", "drain")})
    got, _ = run(stream_cascades(file_record_stream(spark, source, files_per_batch=1), baselines), tmp_path)
    want = batch_rows(cascades(file_records(spark, source), baselines))
    assert len(want) > 3 and rows(got) == want


def test_distinct_stream(spark, tmp_path):
    values = [cascade(*p) for p in PEAKS]
    batches = [[(0, values[0]), (1, values[1])], [(2, values[1]), (3, values[2])]]
    source = write_files(tmp_path / "in", batches)
    from tracewell.sources.ingest import accepted, parse_matches

    typed = M.with_match_id(accepted(parse_matches(file_record_stream(spark, source, files_per_batch=1))))
    out = str(tmp_path / "out")
    distinct_stream(typed, "90 days").select("match_id").writeStream.format("parquet").option("path", out).option(
        "checkpointLocation", str(tmp_path / "cp")
    ).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(out).count() == 3


def test_memory_and_alert_jobs(spark, tmp_path):
    values = [cascade(*p) for p in PEAKS]
    source = write_files(tmp_path / "in", [[(i, v) for i, v in enumerate([*values, values[0], "{bad"])]])
    store, alerts = str(tmp_path / "store"), str(tmp_path / "alerts")
    stream = lambda: file_record_stream(spark, source)
    jobs.remember(stream(), store, str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination()
    episodes, facts = spark.read.parquet(f"{store}/episodes"), spark.read.parquet(f"{store}/facts")
    assert episodes.count() == 6 and facts.count() == 12
    assert spark.read.parquet(f"{store}/rejects").count() == 1
    job = lambda: jobs.alert(stream(), lambda: facts, lambda: episodes, alerts, str(tmp_path / "c2"), "plant")
    job().trigger(availableNow=True).start().awaitTermination()
    job().trigger(availableNow=True).start().awaitTermination()
    sent = spark.read.json(f"{alerts}/alerts")
    assert sent.count() == 6 and {r.topic for r in sent.select("topic").distinct().collect()} == {"plant.alerts.machine-03"}
    body = json.loads(sent.collect()[0].value)
    assert set(body) == {"schema_version", "machine_id", "pattern_name", "detected_at", "alerted_at", "severity", "alert_text",
                         "reasoning", "confidence", "confidence_raw", "validation_flags", "retrieved_episode_count"}
    training = spark.read.json(f"{alerts}/training")
    assert training.count() == 6 and "outcome_id" in training.columns and "alert_date" in training.columns
    assert spark.read.parquet(f"{alerts}/episodes").count() == 6


def test_kafka_options():
    options = kafka_options("h:1", topic_pattern=pattern_topics("plant"), starting_offsets="EARLIEST", user="u", password="p")
    assert options["subscribePattern"] == "^plant\\.patterns\\..+" and options["startingOffsets"] == "earliest"
    assert options["kafka.security.protocol"] == "SASL_PLAINTEXT"
    with pytest.raises(ValueError):
        kafka_options("h:1")


def test_topic_files(spark, tmp_path):
    from tracewell.sources.sinks import append_messages, topic_messages

    df = spark.createDataFrame([("a", 1), ("b", 2)], "machine_id string, x int")
    topic = F.concat(F.lit("plant.patterns."), F.col("machine_id"))
    messages = topic_messages(df, topic, F.col("machine_id"))
    for by_topic in (False, True):
        path = str(tmp_path / f"t{by_topic}")
        append_messages(messages, path, by_topic)
        append_messages(messages.withColumn("topic", F.lit("plant.sensors")), path, by_topic)
        got = file_records(spark, path, pattern_topics("plant"))
        assert sorted(json.loads(r.value)["x"] for r in got.collect()) == [1, 2]


def test_redelivery_in_a_later_batch(spark, tmp_path):
    """A match that comes again in another batch makes no second episode, fact, alert or record."""
    values = [cascade(*p) for p in PEAKS[:3]]
    source = write_files(tmp_path / "in", [[(0, values[0]), (1, values[1])], [(2, values[1]), (3, values[2])], [(4, values[0])]])
    store, alerts = str(tmp_path / "store"), str(tmp_path / "alerts")
    stream = lambda: file_record_stream(spark, source, files_per_batch=1)
    jobs.remember(stream(), store, str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination()
    episodes, facts = spark.read.parquet(f"{store}/episodes"), spark.read.parquet(f"{store}/facts")
    assert episodes.count() == episodes.select("episode_id").distinct().count() == 3
    assert facts.count() == 6
    jobs.alert(stream(), lambda: facts, lambda: episodes, alerts, str(tmp_path / "c2"), "plant").trigger(
        availableNow=True
    ).start().awaitTermination()
    assert spark.read.json(f"{alerts}/alerts").count() == 3
    training = spark.read.json(f"{alerts}/training")
    assert training.count() == 3
    # The source events keep every field they came with.
    assert "machine_type" in training.select("pattern_match.source_events").schema.simpleString()


class Calls:
    """A state handle in memory that counts calls and the entries that are written."""

    def __init__(self):
        self.held, self.calls, self.entries, self.timers = {}, 0, 0, []

    def getListState(self, name, schema):
        return Entry(self, name)

    getValueState = getMapState = getListState

    def listTimers(self):
        self.calls += 1
        return iter(self.timers)

    def registerTimer(self, at):
        self.calls += 1
        self.timers = sorted({*self.timers, at})

    def deleteTimer(self, at):
        self.calls += 1
        self.timers = [t for t in self.timers if t != at]


class Entry:
    def __init__(self, handle, name, *_):
        self.handle, self.name = handle, name

    def _count(self, entries=0):
        self.handle.calls += 1
        self.handle.entries += entries

    def get(self):
        self._count()
        held = self.handle.held.get(self.name)
        return iter(held or []) if self.name == "buffer" else held

    def exists(self):
        self._count()
        return self.name in self.handle.held

    def appendList(self, rows):
        self._count(len(rows))
        self.handle.held.setdefault(self.name, []).extend(rows)

    def put(self, rows):
        self._count(len(rows))
        self.handle.held[self.name] = list(rows)

    def update(self, value):
        self._count(1)
        self.handle.held[self.name] = value

    def clear(self):
        self._count()
        self.handle.held.pop(self.name, None)


def test_held_rows_take_few_entries_and_calls():
    """A batch of a key is one entry for every ``CHUNK`` rows, and a wake-up a few calls, however many rows wait."""
    handle, processor = Calls(), DeadlineProcessor(["user"], [("signup", "click", 50)])
    processor.init(handle)
    n, size = 2 * CHUNK + 3, 7
    table = [(i * size, i, "signup" if i % 2 else "view", f"t{i}", None if i % 3 else "é\"}") for i in range(n)]
    frame = pd.DataFrame(table[::-1], columns=["ms", "seq", "kind", "event_time", "event_json"])
    assert list(processor.handleInputRows(("u",), iter([frame]), None)) == []
    assert handle.entries == 3
    half = table[n // 2][0]
    info, values = SimpleNamespace(getExpiryTimeInMs=lambda: 0), SimpleNamespace(getCurrentWatermarkInMs=lambda: half)
    before = handle.calls
    assert list(processor.handleExpiredTimer(("u",), values, info)) == []
    assert handle.calls - before <= 6 and [tuple(r) for e in handle.held["buffer"] for r in json.loads(e[0])] == table[n // 2 + 1 :]
    values = SimpleNamespace(getCurrentWatermarkInMs=lambda: 10**6)
    (found,) = processor.handleExpiredTimer(("u",), values, info)
    last = max(r for r in table if r[2] == "signup")
    assert found.detected_at.tolist() == [last[3]] and "buffer" not in handle.held
