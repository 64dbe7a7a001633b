import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tracewell.operators import matches as M
from tracewell.plans.detection import cascades, missing_heartbeats, order_violations
from tracewell.schemas import RECORD
from tracewell.sources.dimensions import baselines_from, load_baselines, require_machines
from tracewell.sources.ingest import accepted, parse_matches, parse_order_events, parse_telemetry, rejected

THRESHOLDS = {
    "baseline_temperature_c": 320, "baseline_current_a": 415, "cascade_temperature_offset_c": 60,
    "cascade_vibration_threshold_mm_s": 4.5, "cascade_current_deviation_pct": 0.15,
}
T0 = 1767225600000


def iso(seconds):
    moment = datetime(2026, 1, 1) + timedelta(milliseconds=round(seconds * 1000))
    return moment.isoformat(timespec="milliseconds") + "Z"


def records(spark, values):
    rows = [("t", None, v if isinstance(v, str) else json.dumps(v), i, None) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, RECORD)


def reading(seconds, steps="", machine="Machine-03", drop=(), temperature=None):
    sensors = {
        "temperature_c": temperature or (400.0 if "A" in steps else 320.0),
        "vibration_rms_mm_s": 5.0 if "B" in steps else 3.0,
        "current_a": 482.25 if "C" in steps else 415.0,
    }
    for name in drop:
        del sensors[name]
    return {"machine_id": machine, "machine_type": "rolling_mill", "event_time": iso(seconds),
            "event_type": "telemetry", "sensors": sensors, "meta": {"sim_seed": 42, "injected_fault": None}}


def events(text):
    return [reading(float(e.split(":")[0]), e.split(":")[1]) for e in text.split()]


CASES = {
    1: ("0:A 60:B 120:C", 1), 2: ("10:A 8:B 60:C", 0), 3: ("0:A 100:B 599:C", 1), 4: ("0:A 100:B 601:C", 0),
    7: ("0:A 100:B 600:C", 0), 8: ("0:A 10:A 20:B 30:C 40:C", 1), 9: ("0:A 20:B 25:A 30:C 40:B 50:C", 1),
    10: ("0:A 20:B 30:C 31:A 40:B 50:C", 2), 11: ("0:A 500:A 550:B 700:C", 1), 13: ("0:AB 60:C", 0),
    131: ("0:AB 30:B 60:C", 1), 14: ("0:A 0:B 0:C", 1), 141: ("0:C 0:B 0:A", 0),
}


@pytest.fixture(scope="module")
def baselines(spark):
    machines = ["Machine-03", "Machine-04", "X"] + [f"case-{c}" for c in CASES]
    return baselines_from(spark, {m: THRESHOLDS for m in machines})


def test_sequence_fixtures(spark, baselines):
    values = []
    for case, (text, _) in CASES.items():
        values += [dict(e, machine_id=f"case-{case}") for e in events(text)]
    got = cascades(records(spark, values), baselines).groupBy("machine_id").count().collect()
    counts = {r.machine_id: r["count"] for r in got}
    assert counts == {f"case-{c}": n for c, (_, n) in CASES.items() if n}


def test_match_document(spark, baselines):
    values = events("0:A 60:B 120:C") + ["{broken", "[]", ""]
    rows = records(spark, values)
    match = cascades(rows, baselines).select(M.match_value().alias("v")).collect()
    assert len(match) == 1
    doc = json.loads(match[0].v)
    assert list(doc) == ["schema_version", "pattern_name", "machine_id", "detected_at", "severity", "source_events"]
    assert doc["schema_version"] == "1.0" and doc["detected_at"] == iso(120) and doc["severity"] == "CRITICAL"
    assert doc["source_events"] == values[:3]
    assert rejected(parse_telemetry(rows)).count() == 3


def test_other_machine_threshold_edge_and_missing_current(spark, baselines):
    other = [reading(0, "A"), reading(60, "B", "Machine-04"), reading(120, "C")]
    assert cascades(records(spark, other), baselines).count() == 0
    edge = [reading(0, temperature=380.0), reading(60, "B"), reading(120, "C")]
    assert cascades(records(spark, edge), baselines).count() == 0
    silent = [reading(0, "A"), reading(60, "B"), reading(120, "", drop=["current_a"])]
    assert cascades(records(spark, silent), baselines).count() == 1
    assert cascades(records(spark, silent), baselines, strict_missing=True).count() == 0


def test_cascades_with_hot_machine(spark, baselines):
    values = []
    for i in range(60):
        start = i * 700
        values += [reading(start, "A"), reading(start + 5, "A"), reading(start + 10, "B"), reading(start + 20, "C")]
    rows = records(spark, values)
    plain = sorted(r.detected_at for r in cascades(rows, baselines).collect())
    assert len(plain) == 60
    assert sorted(r.detected_at for r in cascades(rows, baselines, max_rows=9).collect()) == plain


def beat(seconds, seq, machine="Machine-04"):
    return {"machine_id": machine, "event_time": iso(seconds), "event_type": "heartbeat", "sequence": seq}


def test_heartbeat_document(spark):
    values = [beat(0, 1), beat(65, 2), "nope", beat(90, 3, ""), {"machine_id": "Machine-04", "sequence": 9}]
    got = missing_heartbeats(records(spark, values)).select(M.match_value().alias("v")).collect()
    assert [json.loads(r.v) for r in got] == [{
        "schema_version": "1.0", "pattern_name": "MissingHeartbeat", "machine_id": "Machine-04",
        "detected_at": iso(65), "severity": "CRITICAL", "source_events": [values[0]],
    }]


def edi(kind, minutes, order="o1", payload='{"amount_usd": 5}', **extra):
    return {"event_id": f"e{minutes}", "event_type": kind, "order_id": order, "event_time": iso(minutes * 60),
            "payload": payload, **extra}


def test_order_flow_documents(spark):
    values = [
        edi("order", 0), edi("invoice", 60), edi("shipment", 5, "o2", "plain text"), edi("shipment", 6, "o3", {"x": 1}),
        {"event_id": "n", "event_type": "shipment", "event_time": iso(7), "payload": "[1]"}, "oops",
    ]
    got = order_violations(records(spark, values), as_of=T0 + 1000 * 60_000)
    docs = {}
    for r in got.select(M.match_value().alias("v")).collect():
        doc = json.loads(r.v)
        docs[(doc["violation_type"], doc["source_events"][0]["order_id"])] = doc
    assert set(docs) == {
        ("invoice_without_shipment", "o1"), ("order_unfulfilled", "o1"), ("shipment_without_order", "o2"),
        ("shipment_without_order", "o3"), ("shipment_without_order", ""),
    }
    invoice = docs[("invoice_without_shipment", "o1")]
    assert invoice["machine_id"] == "EDI-System" and invoice["severity"] == "HIGH" and invoice["detected_at"] == iso(3600)
    assert [e["payload"] for e in invoice["source_events"]] == [{"amount_usd": 5}] * 2
    assert docs[("order_unfulfilled", "o1")]["detected_at"] == iso(0)
    assert docs[("shipment_without_order", "o2")]["source_events"][0]["payload"] == "plain text"
    assert docs[("shipment_without_order", "o3")]["source_events"][0]["payload"] == ""
    assert docs[("shipment_without_order", "")]["source_events"][0]["payload"] == [1]
    assert rejected(parse_order_events(records(spark, values))).count() == 1


def test_match_validation(spark):
    good = {"machine_id": "m", "pattern_name": "p", "detected_at": iso(0), "severity": "HIGH",
            "source_events": [{"order_id": "o", "payload": {"a": 1}}]}
    values = [good, dict(good, detected_at="2026-01-01T00:00:00+00:00"), dict(good, detected_at="not-a-date"), "{"]
    for name in list(good):
        values.append({k: v for k, v in good.items() if k != name})
        values.append(dict(good, **{name: None}))
        values.append(dict(good, **{name: [] if name == "source_events" else ""}))
    parsed = parse_matches(records(spark, values))
    assert accepted(parsed).count() == 2
    reasons = [r.reject_reason for r in rejected(parsed).orderBy("offset").collect()]
    assert reasons[0] == "detected_at is not ISO-8601: not-a-date" and reasons[1] == "not a JSON object"
    assert reasons[2:] == [f"missing required fields: {n}" for n in good for _ in range(3)]


def test_baseline_files(spark, tmp_path):
    path = tmp_path / "b.json"
    path.write_text(json.dumps({"Machine-03": THRESHOLDS}))
    table = load_baselines(spark, str(path))
    assert require_machines(table, ["Machine-03"]).count() == 1
    with pytest.raises(ValueError):
        require_machines(table, ["Machine-09"])
    with pytest.raises(ValueError):
        baselines_from(spark, {"m": {"baseline_current_a": 1}})


def test_match_ids(spark):
    base = {"machine_id": "EDI-System", "pattern_name": "EDISequenceViolation", "detected_at": iso(0), "severity": "HIGH",
            "violation_type": "order_unfulfilled"}
    values = [dict(base, source_events=[{"order_id": o}]) for o in ("o1", "o2", "o1")]
    got = M.with_match_id(accepted(parse_matches(records(spark, values))))
    assert M.distinct_matches(got).count() == 2
    assert got.filter(F.length("match_id") == 64).count() == 3
    # Names with a separator in them, and violations without an order id in one millisecond.
    odd = [dict(base, machine_id="a|b", pattern_name="P", source_events=[{}]), dict(base, machine_id="b", pattern_name="P|a", source_events=[{}]),
           dict(base, source_events=[{"event_id": "e1"}]), dict(base, source_events=[{"event_id": "e2"}])]
    assert M.distinct_matches(M.with_match_id(accepted(parse_matches(records(spark, odd))))).count() == 4


def test_odd_source_events_are_no_reason_to_reject(spark):
    base = {"machine_id": "m", "pattern_name": "p", "detected_at": iso(0), "severity": "HIGH"}
    events_ = [{"sensors": {"state": "ok", "temperature_c": 7}, "sequence": "7", "meta": {"sim_seed": 1}, "extra": [1, None]}, {"sensors": "none"}, 5]
    got = accepted(parse_matches(records(spark, [dict(base, source_events=events_)]))).collect()[0]
    first = got.source_events[0]
    assert (first.sensors, first.sequence) == ({"state": None, "temperature_c": 7.0}, 7)
    assert [json.loads(e) for e in got.source_json] == events_


def test_payload_by_the_type_of_its_own_field(spark):
    rows = [{"payload": {"payload": "x"}}, {"payload": '{"payload": 1}'}, {"payload": "[1"}, {"payload": [1]}, {"payload": 5}]
    rows = [dict(r, event_id="e", event_type="order", order_id="o", event_time=iso(i)) for i, r in enumerate(rows)]
    got = [r.payload for r in parse_order_events(records(spark, rows)).orderBy("event_ms").collect()]
    assert got == ["", '{"payload": 1}', "[1", "", "5"]


def test_order_flow_by_arrival(spark):
    """A shipment that arrives before its order is an orphan by arrival only; deadlines stay in event time."""
    values = [
        {"event_id": "s", "event_type": "shipment", "order_id": "o", "event_time": iso(20)},
        {"event_id": "o", "event_type": "order", "order_id": "o", "event_time": iso(10)},
        {"event_id": "p", "event_type": "order", "order_id": "q", "event_time": iso(10)},
        {"event_id": "t", "event_type": "shipment", "order_id": "q", "event_time": iso(500)},
    ]
    source = records(spark, values)
    got = {
        how: sorted(r.violation_type for r in order_violations(source, 100_000, order_by=how).collect())
        for how in ("event_time", "arrival")
    }
    assert got["event_time"] == ["order_unfulfilled"]
    assert got["arrival"] == ["order_unfulfilled", "order_unfulfilled", "shipment_without_order"]
