import random

import pytest
from pyspark.sql import functions as F

from tests.machines import gaps, order_flow
from tracewell.operators.gaps import missing_ranges, missing_slots, signal_gaps
from tracewell.operators.intervals import DAY_MS, grade_interventions, label_intervals
from tracewell.operators.ordered import Look, neighbours
from tracewell.operators.orderflow import flow_violations, step_deadlines

SMALL = [{}, {"max_rows": 7}]


@pytest.mark.parametrize("options", SMALL)
def test_neighbours_equal_plain_scan(spark, options):
    rng = random.Random(11)
    rows = [(rng.choice("aaab"), rng.randrange(300), i, rng.choice("xy")) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, pos long, tie long, v string")
    looks = [
        Look("p", "prev", ["pos", "tie"]),
        Look("px", "prev", ["pos", "tie"], F.col("v") == "x"),
        Look("ny", "next", ["pos", "tie"], F.col("v") == "y"),
    ]
    got = {
        (r.k, r.pos, r.tie): tuple(None if s is None else (s.pos, s.tie) for s in (r.p, r.px, r.ny))
        for r in neighbours(df, ["k"], ["pos", "tie"], looks, **options).collect()
    }
    assert len(got) == 400
    keyless = spark.createDataFrame([(None, 1, 1, "x"), ("a", 2, 2, "x")], df.schema)
    assert neighbours(keyless, ["k"], ["pos", "tie"], looks, **options).count() == 1
    for k, pos, tie, _ in rows:
        before = sorted(r[1:] for r in rows if r[0] == k and r[1:3] < (pos, tie))
        after = sorted(r[1:] for r in rows if r[0] == k and r[1:3] > (pos, tie))
        xs = [r for r in before if r[2] == "x"]
        ys = [r for r in after if r[2] == "y"]
        want = (
            before[-1][:2] if before else None,
            xs[-1][:2] if xs else None,
            ys[0][:2] if ys else None,
        )
        assert got[(k, pos, tie)] == want


GAP_CASES = [
    ([0, 65_000], 1),
    ([0, 63_000], 0),
    ([0, 63_999], 0),
    ([0, 64_000], 1),
    ([0], 0),
    ([0, 60_000, 30_000, 95_000], 1),
]


def test_gap_cases(spark):
    rows = [(f"m{i}", j, ms) for i, (beats, _) in enumerate(GAP_CASES) for j, ms in enumerate(beats)]
    df = spark.createDataFrame(rows, "machine string, seq long, ms long")
    got = {r.machine: r for r in signal_gaps(df, ["machine"], ["seq"], "ms", 63).collect()}
    assert sorted(got) == sorted(f"m{i}" for i, (_, n) in enumerate(GAP_CASES) if n)
    assert got["m0"].previous.seq == 0 and got["m5"].previous.ms == 30_000
    by_time = signal_gaps(df.filter("machine = 'm5'"), ["machine"], ["ms", "seq"], "ms", 63)
    assert by_time.count() == 0


@pytest.mark.parametrize("options", SMALL)
def test_random_gaps(spark, options):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), i, i * 30_000 + rng.randrange(-90_000, 90_000)) for i in range(300)]
    df = spark.createDataFrame(rows, "machine string, seq long, ms long")
    got = signal_gaps(df, ["machine"], ["seq"], "ms", 63, **options)
    want = [(k, *g) for k in "ab" for g in gaps([r[1:] for r in rows if r[0] == k], 63)]
    assert sorted((r.machine, r.previous.seq, r.seq) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("options", SMALL)
def test_missing_slots(spark, options):
    df = spark.createDataFrame([("a", 0), ("a", 61), ("a", 245), ("b", 5)], "m string, t long")
    got = missing_slots(df, ["m"], "t", 60, **options).collect()
    assert sorted((r.m, r.slot_start_ms) for r in got) == [("a", 120), ("a", 180)]


MIN = 60_000
FLOW_CASES = {
    1: ("o0 s20 i60", []),
    2: ("s20", ["shipment_without_order"]),
    3: ("s20 s30", ["shipment_without_order"]),
    4: ("s20 o30 s40", ["shipment_without_order"]),
    5: ("o0 i60", ["invoice_without_shipment", "order_unfulfilled"]),
    6: ("o0 i60 i70", ["invoice_without_shipment", "order_unfulfilled"]),
    7: ("s0 o10 i20", ["invoice_without_shipment", "order_unfulfilled", "shipment_without_order"]),
    8: ("i10", []),
    9: ("o0 s240", []),
    10: ("o0 s241", ["order_unfulfilled"]),
    11: ("o0 o100 s300", []),
    12: ("o0 o300", ["order_unfulfilled", "order_unfulfilled"]),
    13: ("o900", []),
}
KIND = {"o": "order", "s": "shipment", "i": "invoice"}


def test_flow_cases(spark):
    rows, seq = [], 0
    for case, (text, _) in FLOW_CASES.items():
        for e in text.split():
            rows.append((f"c{case}", KIND[e[0]], int(e[1:]) * MIN, seq))
            seq += 1
    df = spark.createDataFrame(rows, "k string, kind string, ms long, seq long")
    got = flow_violations(df, ["k"], ["ms", "seq"], "kind", 240 * MIN, as_of=1000 * MIN).collect()
    for case, (_, want) in FLOW_CASES.items():
        mine = [r for r in got if r.k == f"c{case}"]
        assert sorted(r.violation_type for r in mine) == want, case
    five = [r for r in got if r.k == "c5" and r.violation_type == "invoice_without_shipment"][0]
    assert [e.kind for e in five.evidence] == ["order", "invoice"]
    assert [r.detected for r in got if r.k == "c10"] == [0]


@pytest.mark.parametrize("options", SMALL)
def test_random_flows(spark, options):
    rng = random.Random(21)
    rows = [
        (rng.choice(["", "", "x", "y"]), rng.choice(["order", "shipment", "invoice", "other"]), rng.randrange(4000), i)
        for i in range(500)
    ]
    df = spark.createDataFrame(rows, "k string, kind string, ms long, seq long")
    got = flow_violations(df, ["k"], ["ms", "seq"], "kind", 25, as_of=4100, **options).collect()
    mine = sorted((r.k, r.violation_type, tuple(e.seq for e in r.evidence)) for r in got)
    want = sorted(
        (k, *v)
        for k in ("", "x", "y")
        for v in order_flow([(r[2], r[3], r[1]) for r in rows if r[0] == k], 25, 4100)
    )
    assert mine == want


@pytest.mark.parametrize("options", SMALL)
def test_step_deadlines(spark, options):
    rng = random.Random(4)
    rows = [(rng.choice("pq"), rng.choice("ABC"), rng.randrange(500), i) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, kind string, ms long, seq long")
    pairs = [("A", "B", 9), ("B", "C", 4)]
    got = step_deadlines(df, ["k"], ["ms", "seq"], "kind", pairs, as_of=600, **options).collect()
    want = []
    for step, following, limit in pairs:
        for k in "pq":
            renamed = [(r[2], r[3], {step: "order", following: "shipment"}.get(r[1], "-")) for r in rows if r[0] == k]
            want += [(k, s[0], step) for kind, s in order_flow(renamed, limit, 600) if kind == "order_unfulfilled"]
    assert sorted((r.k, r.seq, r.step) for r in got) == sorted(want)


def test_interval_labels(spark):
    windows = spark.createDataFrame(
        [("m", 100_000, 200_000, 1, "first"), ("m", 150_000, 300_000, 2, "second"), ("m", 400_000, 400_000, 3, "empty")],
        "machine string, start_ms long, end_ms long, registered long, label string",
    )
    events = spark.createDataFrame(
        [("m", i, t) for i, t in enumerate([99_999, 100_000, 199_900, 200_000, 300_000, 160_000])] + [("n", 9, 150_000)],
        "machine string, id long, ms long",
    )
    got = {r.id: (r.label, r.elapsed_seconds) for r in label_intervals(events, windows, ["machine"], "id", "ms").collect()}
    assert got == {
        0: (None, None), 1: ("first", 0.0), 2: ("first", 99.9), 3: ("second", 50.0),
        4: (None, None), 5: ("first", 60.0), 9: (None, None),
    }


@pytest.mark.parametrize("options", [{}, {"max_rows": 60}])
def test_random_interval_labels(spark, options):
    rng = random.Random(12)
    windows = []
    for i in range(150):
        start = rng.randrange(3000)
        windows.append((rng.choice("aab"), start, start + rng.choice((0, 1, 40, 900)), i * 7 % 150, f"w{i}" if i % 9 else None))
    points = [(rng.choice("aabc"), i, rng.randrange(4000)) for i in range(500)] + [("a", 600, None), (None, 601, 5)]
    got = label_intervals(
        spark.createDataFrame(points, "machine string, id long, ms long"),
        spark.createDataFrame(windows, "machine string, start_ms long, end_ms long, registered long, label string").repartition(3),
        ["machine"], "id", "ms", **options,
    )
    want = {}
    for machine, i, ms in points:
        held = sorted((w[3], w[1], w[4]) for w in windows if w[0] == machine and ms is not None and w[1] <= ms < w[2])
        want[i] = (held[0][2], (ms - held[0][1]) / 1000.0) if held else (None, None)
    assert {r.id: (r.label, r.elapsed_seconds) for r in got.collect()} == want


def test_a_clock_at_the_epoch(spark):
    """A gap of half a century is one range, and its periods are made in pieces."""
    df = spark.createDataFrame([("a", 0), ("a", 1_700_000_000_000), ("b", 5)], "m string, t long")
    assert [tuple(r) for r in missing_ranges(df, ["m"], "t", 600_000).collect()] == [("a", 1, 2_833_332)]
    made = missing_slots(df, ["m"], "t", 600_000)
    assert made.count() == 2_833_332
    assert made.agg(F.min("slot_start_ms"), F.max("slot_start_ms"), F.count_distinct("slot_start_ms")).head() == (600_000, 1_699_999_200_000, 2_833_332)


@pytest.mark.parametrize("options", [{}, {"max_rows": 2}])
def test_grading(spark, options):
    acts = spark.createDataFrame(
        [("m", "i1", 0), ("m", "i2", 10 * DAY_MS), ("m", "i3", 40 * DAY_MS), ("n", "i4", 0)],
        "machine string, intervention_id string, performed_ms long",
    )
    seen = spark.createDataFrame([("m", 0), ("m", 3 * DAY_MS + 5), ("m", 17 * DAY_MS)], "machine string, detected_ms long")
    got = {
        r.intervention_id: (r.outcome_status, r.days_until_recurrence, r.observed_ms)
        for r in grade_interventions(acts, seen, ["machine"], 7, **options).collect()
    }
    assert got == {
        "i1": ("recurred", 3, 3 * DAY_MS + 5),
        "i2": ("recurred", 7, 17 * DAY_MS),
        "i3": ("ongoing", None, 40 * DAY_MS),
        "i4": ("resolved", None, 7 * DAY_MS),
    }
