import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_detection import iso, records
from tracewell.functions.text import first_words, fixed, word_count
from tracewell.operators import alerts as A
from tracewell.operators import entities as G
from tracewell.operators import episodes as E
from tracewell.operators import matches as M
from tracewell.operators import retrieval as R
from tracewell.plans import memory
from tracewell.plans.retrieval_queries import remembered
from tracewell.schemas import INTERVENTION
from tracewell.storage import checkpointed

PEAKS = [
    ("2026-01-12T08:15:00", 392.0, 4.8, 471.0), ("2026-02-03T19:40:00", 401.5, 5.1, 478.0),
    ("2026-02-28T03:22:00", 398.0, 4.9, 472.0), ("2026-03-19T11:05:00", 405.0, 5.0, 480.0),
    ("2026-04-15T14:23:00", 422.6, 5.6, 495.0), ("2026-05-09T21:50:00", 431.2, 5.9, 503.0),
]


def cascade(at, temperature, vibration, current, machine="Machine-03"):
    minute = int(at[14:16])
    before = [at[:14] + f"{minute - d:02d}:{s:02d}Z" for d, s in ((5, 0), (3, 30))]
    readings = [(384.0, 4.7, 470.0), (temperature, vibration, current), (temperature, vibration, current)]
    return {
        "schema_version": "1.0", "pattern_name": "ThermalVibrationCascade", "machine_id": machine,
        "detected_at": at + "Z", "severity": "CRITICAL",
        "source_events": [
            {"machine_id": machine, "machine_type": "rolling_mill", "event_time": t,
             "sensors": dict(zip(E.SENSORS, r))}
            for t, r in zip([*before, at + "Z"], readings)
        ],
    }


@pytest.fixture(scope="module")
def history(spark):
    return records(spark, [cascade(*p) for p in PEAKS])


def test_number_format_equals_python(spark):
    values = [422.25, 0.15, 2.675, 0.125, 482.25, -1.05, 0.5, 1.5, 2.5, 1234567.85]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for r in df.select("x", *[fixed(F.col("x"), d).alias(f"d{d}") for d in range(3)]).collect():
        assert (r.d0, r.d1, r.d2) == (f"{r.x:.0f}", f"{r.x:.1f}", f"{r.x:.2f}")


def test_words(spark):
    text = "  a b\tc\n\nd "
    df = spark.createDataFrame([(text,), ("",), ("one  two",)], "t string")
    got = df.select(word_count(F.col("t")).alias("n"), first_words(F.col("t"), 2).alias("f")).collect()
    assert [(r.n, r.f) for r in got] == [(4, "a b"), (0, ""), (2, "one  two")]


def test_cascade_episodes(spark, history):
    episodes, rejects = memory.ingest_matches(history.union(history))
    got = {r.name: r for r in episodes.collect()}
    assert len(got) == 6 and rejects.count() == 0
    first = got["ThermalVibrationCascade on Machine-03 @ 2026-01-12T08:15:00Z"]
    assert first.body == (
        "ThermalVibrationCascade on Machine-03, occurrence occ-machine-03-20260112T081500Z, family bearing_degradation, "
        "severity CRITICAL. The rolling mill took its first step at 2026-01-12T08:10:00Z and the last 300 s later, "
        "noticed at 2026-01-12T08:15:00Z. Maxima: 392.0 °C, 4.80 mm/s, 471.0 A."
    )
    assert first.group_id == "Machine-03" and first.episode_type == "pattern_occurrence"


def test_other_narratives_and_rejects(spark):
    beat = {"pattern_name": "MissingHeartbeat", "machine_id": "Machine-04", "detected_at": iso(65), "severity": "CRITICAL",
            "source_events": [{"event_time": iso(0), "sequence": 7}]}
    flow = {"pattern_name": "EDISequenceViolation", "machine_id": "EDI-System", "detected_at": iso(9), "severity": "HIGH",
            "violation_type": "invoice_without_shipment",
            "source_events": [{"order_id": "o1", "event_type": "order"}, {"order_id": "o1", "event_type": "invoice"}]}
    blind = cascade(*PEAKS[0])
    del blind["source_events"][1]["sensors"]["current_a"]
    long_name = dict(cascade(*PEAKS[1]), machine_id=" ".join(["m"] * 90))
    odd = dict(cascade(*PEAKS[2]), pattern_name="Odd")
    episodes, rejects = memory.ingest_matches(records(spark, [beat, flow, blind, long_name, odd]))
    bodies = {r.name.split(" on ")[0]: r.body for r in episodes.collect()}
    assert bodies["MissingHeartbeat"] == (
        "MissingHeartbeat on Machine-04, occurrence occ-machine-04-20260101T000105Z, family connectivity_failure, severity CRITICAL. "
        f"Silent since heartbeat 7 of {iso(0)}, noticed at {iso(65)}; check its network and power."
    )
    assert bodies["EDISequenceViolation"] == (
        "EDISequenceViolation on EDI-System, occurrence occ-edi-system-20260101T000009Z, family edi_compliance, severity HIGH. "
        f"Order o1 broke rule invoice_without_shipment, noticed at {iso(9)}. Messages: order, invoice."
    )
    assert "family unclassified" in bodies["Odd"]
    reasons = sorted(r.reject_reason.split(",")[0] for r in rejects.collect())
    assert len(reasons) == 2 and reasons[0].startswith("episode of ") and reasons[1] == "source event lacks sensor data"


def test_interventions(spark):
    rows = [
        ("i1", "Machine-03", "bearing_replacement", None, None, None, None),
        ("i2", "Machine-03", "frobnicate", None, None, None, None),
        ("i3", None, "lubrication", None, None, None, None),
        ("i4", "Machine-03", "inspection_no_action", None, "Kim", "all fine", "ThermalVibrationCascade"),
    ]
    df = spark.createDataFrame(rows, INTERVENTION)
    df = df.withColumn("performed_at", F.when(F.col("intervention_id") == "i4", F.to_timestamp(F.lit("2026-01-02 03:04:05.5"))))
    episodes, rejects = memory.ingest_interventions(df)
    assert sorted(r.intervention_id for r in rejects.collect()) == ["i2", "i3"]
    bodies = {r.name: r.body for r in episodes.collect()}
    assert bodies["Intervention i1 on Machine-03"] == (
        "Machine-03 serviced: bearing replacement, record i1, time not recorded, by someone not recorded."
    )
    assert bodies["Intervention i4 on Machine-03"] == (
        "Machine-03 serviced: inspection no action, against ThermalVibrationCascade, record i4, "
        "time 2026-01-02T03:04:05.500000+00:00, by Kim. Remarks: all fine"
    )


def test_graph(spark, history):
    matches = memory.known_matches(history)
    mentions = G.match_mentions(matches)
    assert {r.label: r.n for r in G.census(G.nodes(mentions), "label").collect()} == {"Machine": 1, "Pattern": 1, "PatternOccurrence": 6}
    assert G.co_mentions(mentions, "Machine", "PatternOccurrence", "Machine-03", 20).count() == 6
    episodes, _ = memory.ingest_matches(history)
    assert G.mentioned_in(mentions, episodes, "Machine", "Machine-03", ["pattern_occurrence"], 4).count() == 4
    assert G.mentioned_in(mentions, episodes, "Machine", None, ["agent_alert"]).count() == 0
    occ = G.occurrences(matches).orderBy("detected_at").collect()
    assert [o.peak_temperature_c for o in occ] == [p[1] for p in PEAKS] and occ[0].cascade_duration_seconds == 300.0
    assert G.machines(matches).collect()[0].process_position == "rolling_mill"
    assert G.patterns(matches).collect()[0].pattern_family == "bearing_degradation"
    assert {r.name: r.n for r in G.census(G.match_facts(matches), "name").collect()} == {"DETECTED_ON": 6, "EXPERIENCED_PATTERN": 6}


GATE = [
    (0.85, 0, False, 0.3, ["no_anchors"]), (0.8, 2, False, 0.6, ["insufficient_anchors_for_tier"]),
    (0.95, 4, False, 0.8, ["missing_outcome_for_tier"]), (0.9, 4, True, 0.9, []),
    (0.92, 5, False, 0.8, ["missing_outcome_for_tier"]), (0.95, 0, False, 0.3, ["no_anchors"]),
    (0.95, 2, False, 0.6, ["insufficient_anchors_for_tier"]), (0.2, 0, False, 0.2, ["no_anchors"]), (0.7, 3, False, 0.7, []),
]


def test_gate(spark):
    rows = [(i, raw, ["a"] * n, o) for i, (raw, n, o, _, _) in enumerate(GATE)]
    df = spark.createDataFrame(rows, "i int, confidence_raw double, confidence_anchors array<string>, o boolean")
    got = A.gate_confidence(df, F.col("o")).orderBy("i").collect()
    assert [(r.confidence_final, r.validation_flags) for r in got] == [(g[3], g[4]) for g in GATE]


def test_responses(spark):
    good = {"reasoning": " r ", "confidence_anchors": [" a ", "", "  "], "confidence": 1.7, "alert_text": "t"}
    texts = [json.dumps(good), "```json\n" + json.dumps(dict(good, confidence="0.5")) + "\n```", "```\n{}\n```", "no json", None,
             json.dumps(dict(good, confidence="high")), json.dumps(dict(good, confidence_anchors=None, confidence=-1))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, response string")
    got = A.parse_responses(df, "response").orderBy("i").collect()
    assert (got[0].reasoning, got[0].confidence_anchors, got[0].confidence_raw) == ("r", ["a"], 1.0)
    assert got[1].confidence_raw == 0.5 and got[1].reject_reason is None
    assert got[2].reject_reason == "response lacks reasoning, confidence, alert_text"
    assert got[3].reject_reason == got[4].reject_reason == "response is not JSON"
    assert got[5].reject_reason == "confidence is not a number"
    assert got[6].confidence_anchors == [] and got[6].confidence_raw == 0.0 and got[6].reject_reason is None


def bm25(docs, queries, k):
    import re
    split = lambda t: [w for w in re.split(r"[\W_]+", t.lower()) if w]
    toks = {d: split(t) for d, t, _ in docs}
    n, mean = len(toks), sum(map(len, toks.values())) / len(toks)
    df = {}
    for t in toks.values():
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    out = []
    for q, text, g in queries:
        scores = []
        for d, _, dg in docs:
            if g is not None and g != dg:
                continue
            s = sum(
                math.log(1 + (n - df[w] + .5) / (df[w] + .5)) * c * 2.2 / (c + 1.2 * (.25 + .75 * len(toks[d]) / mean))
                for w in set(split(text)) if (c := toks[d].count(w))
            )
            if s:
                scores.append((-round(s, 6), d))
        out += [(q, d, i + 1) for i, (_, d) in enumerate(sorted(scores)[:k])]
    return sorted(out)


@pytest.mark.parametrize("k", [1, 3, 30])
def test_bm25_equals_brute_force(spark, k):
    rng = random.Random(k)
    word = lambda: "w%d" % min(rng.randrange(60), rng.randrange(60), rng.randrange(60))
    docs = [(f"d{i:03d}", " ".join(word() for _ in range(rng.randrange(1, 30))), rng.choice("xy")) for i in range(120)]
    docs += [(f"e{i}", docs[i][1], docs[i][2]) for i in range(20)]
    queries = [(f"q{i}", " ".join(word() for _ in range(8)), rng.choice(["x", "y", None])) for i in range(12)]
    ddf = spark.createDataFrame(docs, "doc_id string, text string, group_id string")
    qdf = spark.createDataFrame(queries, "query_id string, text string, group_id string")
    got = R.bm25_topk(ddf, qdf, k, by_group=True).collect()
    assert sorted((r.query_id, r.doc_id, r["rank"]) for r in got) == bm25(docs, queries, k)
    free = R.bm25_topk(ddf, qdf, k).collect()
    assert sorted((r.query_id, r.doc_id, r["rank"]) for r in free) == bm25(docs, [(q, t, None) for q, t, _ in queries], k)


def test_cosine_blocks(spark):
    rng = np.random.default_rng(3)
    docs = [(i, rng.normal(size=6).tolist(), "ab"[i % 3 == 0]) for i in range(150)]
    queries = [(i, rng.normal(size=6).tolist(), ["a", "b", None][i % 3]) for i in range(20)]
    ddf = spark.createDataFrame(docs, "doc_id long, embedding array<float>, group_id string")
    qdf = spark.createDataFrame(queries, "query_id long, embedding array<float>, group_id string")
    want = []
    for q, v, g in queries:
        unit = lambda x: np.float32(x).astype(float) / np.linalg.norm(np.float32(x).astype(float))
        scored = sorted((-round(float(unit(v) @ unit(x)), 6), d) for d, x, dg in docs if g in (None, dg))
        want += [(q, d, i + 1) for i, (_, d) in enumerate(scored[:7])]
    for options in ({}, {"broadcast_bytes": 0}, {"broadcast_bytes": 0, "block_rows": 16}):
        got = R.cosine_topk(ddf.repartition(3), qdf, 7, by_group=True, **options).collect()
        assert sorted((r.query_id, r.doc_id, r["rank"]) for r in got) == sorted(want)
    free = R.cosine_topk(ddf, qdf, 7)
    assert free.count() == 140 and free.exceptAll(R.cosine_topk(ddf, qdf, 7, block_rows=16, broadcast_bytes=0)).count() == 0
    assert "Exchange hashpartitioning(doc_id" not in free._jdf.queryExecution().executedPlan().toString()


def test_shared_entities(spark):
    rng = random.Random(8)
    docs = [(f"d{i:02d}", e) for i in range(80) for e in rng.sample("ABCDE", rng.randrange(1, 4))]
    asks = [(f"q{i}", e) for i in range(6) for e in rng.sample("ABCDF", 2)]
    got = R.shared_entity_topk(
        spark.createDataFrame(asks, "query_id string, entity string"), spark.createDataFrame(docs, "doc_id string, entity string"), 4
    ).collect()
    want = []
    for q in {a[0] for a in asks}:
        mine = {e for x, e in asks if x == q}
        counts = {}
        for d, e in docs:
            if e in mine:
                counts[d] = counts.get(d, 0) + 1
        want += [(q, d, i + 1) for i, (d, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:4])]
    assert sorted((r.query_id, r.doc_id, r["rank"]) for r in got) == sorted(want)


def stored(history):
    matches = checkpointed(memory.known_matches(history))
    return matches, checkpointed(G.match_facts(matches)), checkpointed(memory.ingest_matches(history)[0])


def test_search_end_to_end(spark, history):
    _, facts, episodes = stored(history)
    queries = spark.createDataFrame(
        [("q1", "ThermalVibrationCascade recurrence on Machine-03", "Machine-03"), ("q2", "peak temperature 431.2", None)],
        "query_id string, text string, group_id string",
    )
    got = R.search_history(queries, facts, episodes).orderBy("query_id", "rank").collect()
    assert [r.query_id for r in got] == ["q1"] * 5 + ["q2"] * 5
    scores = [r.reranker_score for r in got if r.query_id == "q2"]
    assert scores == sorted(scores, reverse=True)
    assert R.search_history(queries, facts, episodes, episode_types=["intervention"]).count() == 0
    with pytest.raises(ValueError):
        R.search_history(queries, facts, episodes, episode_types=["nonsense"])


def test_type_filter_keeps_unfiltered_ranks(spark):
    rows = [("q", "same words", f"f{i:02d}", "same words", i, "outcome" if i in (4, 27) else "intervention") for i in range(30)]
    df = spark.createDataFrame(rows, "query_id string, query_text string, fact_id string, content string, retrieval_rank int, episode_type string")
    got = R.in_tiers(df, [(["outcome"], 4), (["intervention"], 1)]).collect()
    assert sorted((r.tier, r.retrieval_rank) for r in got) == [(1, 4), (1, 27), (2, 0)]


def test_rerank_moves_relevant_first(spark):
    rows = [("q", "bearing failure on mill", c, i) for i, c in enumerate(["weather today", "lunch menu", "the mill bearing failure"])]
    df = spark.createDataFrame(rows, "query_id string, query_text string, content string, retrieval_rank int")
    got = R.rerank(df).orderBy("rank").collect()
    assert [r.retrieval_rank for r in got] == [2, 0, 1]


def test_alert_chain(spark, history):
    matches, facts, episodes = stored(history)
    alerts = checkpointed(memory.raise_alerts(memory.retrieve(matches, facts, episodes)))
    rows = alerts.collect()
    assert len(rows) == 6 and all(len(r.retrieved_episodes) == 4 for r in rows)
    assert all(r.confidence_final == 0.5 and r.validation_flags == [] for r in rows)
    again = memory.raise_alerts(memory.retrieve(matches, facts, episodes)).select("alert_id")
    assert {r.alert_id for r in again.collect()} == {r.alert_id for r in rows} and len({r.alert_id for r in rows}) == 6
    summary = [r.summary for r in rows if r.detected_at.startswith("2026-01-12")][0]
    assert summary.startswith(
        "Machine-03: ThermalVibrationCascade alert for 2026-01-12T08:15:00+00:00, confidence 0.50. "
    )
    records_ = A.training_records(alerts, F.col("source_events"), "offline-rubric", F.current_timestamp())
    row = records_.collect()[0]
    assert row.outcome_id is None and row.record_id.startswith("train-machine-03-") and len(row.pattern_match.source_events) == 3
    assert A.alert_records(alerts).collect()[0].retrieved_episode_count == 4
    report = A.alert_report(alerts).collect()[0]
    assert (report.alerts, report.downgraded, report.min_anchors) == (6, 0, 4)
    payload = json.loads(alerts.select(A.evidence_payload(F.col("source_events")).alias("p")).collect()[0].p)
    assert set(payload) == {"pattern_match", "retrieved_history"} and len(payload["retrieved_history"]) == 4
    links = spark.createDataFrame([(row.record_id, "out-1")], "record_id string, outcome_id string")
    filled = A.fill_outcomes(records_, links)
    assert filled.filter("outcome_id = 'out-1'").count() == 1 and filled.count() == 6


def test_query_text(spark, history):
    matches = memory.known_matches(history)
    texts = {r.text for r in memory.match_queries(matches).collect()}
    assert "ThermalVibrationCascade on Machine-03 with peak temperature 422.6 C" in texts
    plain = memory.known_matches(records(spark, [{"pattern_name": "P", "machine_id": "m", "detected_at": iso(0), "severity": "CRITICAL",
                                                  "source_events": [{"order_id": "x"}]}]))
    assert memory.match_queries(plain).collect()[0].text == "P on m with severity CRITICAL"


def test_occurrence_id(spark):
    df = spark.createDataFrame([("Machine-03", "2026-01-12T08:15:00.123+02:00"), ("M", "2026-01-12T08:15Z")], "m string, t string")
    got = [r.o for r in df.select(E.occurrence_id(F.col("m"), F.col("t"), "x").alias("o")).collect()]
    assert got == ["x-machine-03-20260112T081500Z", "x-m-20260112T081500Z"]


def test_later_facts_take_no_place(spark):
    """Forty later facts that match better do not push the earlier one out of any ranking."""
    facts = [("old", "one pump leak", "g", 1)] + [(f"new{i}", "pump leak pump leak", "g", 100 + i) for i in range(40)]
    facts = spark.createDataFrame(facts, "fact_id string, fact string, group_id string, t long").select(
        "fact_id", "fact", "group_id", F.timestamp_seconds("t").alias("valid_at"), F.lit("").alias("name"),
        F.array("fact_id").alias("episodes"), F.when(F.col("fact_id") == "old", F.array(F.lit(1.0), F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(0.0))).alias("embedding"),
    )
    asked = spark.createDataFrame([("q1", "pump leak", "g", 50), ("q2", "pump leak", None, 50), ("q3", "pump leak", "g", None)],
                                  "query_id string, text string, group_id string, t long")
    asked = asked.select("query_id", "text", "group_id", F.timestamp_seconds("t").alias("as_of"), F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"))
    mine = asked.select("query_id", F.lit("e").alias("entity"))
    theirs = facts.select("fact_id", F.lit("e").alias("entity"))
    got = R.hybrid_candidates(asked, facts, mine, theirs).collect()
    assert {r.query_id: sum(s.query_id == r.query_id for s in got) for r in got} == {"q1": 1, "q2": 1, "q3": 30}
    assert all(r.fact_id == "old" for r in got if r.query_id != "q3")


def test_facts_of_interventions_and_outcomes(spark):
    rows = [("i1", "m", "lubrication", None, "Kim", None, "P"), ("i2", "m", "lubrication", None, None, None, None), ("i1", "m", "lubrication", None, "Kim", None, "P")]
    told = E.narrate_interventions(spark.createDataFrame(rows, INTERVENTION))
    facts = G.intervention_facts(told).distinct()
    assert sorted((r.name, r.source, r.target) for r in facts.collect()) == [
        ("PERFORMED_ON", "i1", "m"), ("PERFORMED_ON", "i2", "m"), ("TARGETED", "i1", "P")]
    episodes = {r.episode_id for r in E.intervention_episodes(told).collect()}
    assert {r.episodes[0] for r in facts.collect()} == episodes
    assert sorted(r.intervention_id for r in G.intervention_entities(told).collect()) == ["i1", "i2"]
    graded = spark.createDataFrame([("i1", "m", "recurred", 4, 30, 1_000)],
                                   "intervention_id string, machine_id string, outcome_status string, days_until_recurrence int, evaluation_window_days int, observed_ms long")
    outcomes = G.outcomes(graded)
    fact, episode = G.outcome_facts(outcomes).head(), E.outcome_episodes(outcomes).head()
    assert (fact.name, fact.source, fact.target, fact.episodes) == ("RESULTED_IN", "i1", "outcome-i1", [episode.episode_id])
    assert episode.body == "m after i1: recurred, seen again after 4 days, judged over 30 days."


def test_the_chain_reaches_the_top_tier(spark, history):
    """With interventions and outcomes in memory, tier 1 returns them and the gate lets 0.9 pass."""
    matches, facts, episodes = stored(history)
    actions = spark.createDataFrame([("i1", "Machine-03", "bearing_replacement", None, None, None, "ThermalVibrationCascade")], INTERVENTION)
    told = E.narrate_interventions(actions.withColumn("performed_at", F.to_timestamp(F.lit("2026-05-10"))))
    outcomes = G.outcomes(spark.createDataFrame(
        [("ThermalVibrationCascade on Machine-03 with peak temperature", "Machine-03", "resolved", None, 30, 1_000)],
        "intervention_id string, machine_id string, outcome_status string, days_until_recurrence int, evaluation_window_days int, observed_ms long"))
    facts = facts.unionByName(G.intervention_facts(told).filter("name = 'TARGETED'")).unionByName(G.outcome_facts(outcomes))
    episodes = episodes.unionByName(E.intervention_episodes(told)).unionByName(E.outcome_episodes(outcomes))
    tiers = [(["intervention"], 1), (["outcome"], 1), (["pattern_occurrence"], 3)]
    found = R.two_tier_history(memory.match_queries(matches), facts, episodes, tiers=tiers)
    kinds = {r.episode_type for r in found.collect()}
    assert kinds == {"pattern_occurrence", "intervention", "outcome"}
    raised = memory.raise_alerts(R.attach_history(matches, found)).collect()
    assert all(r.confidence_raw == 0.9 and r.confidence_final == 0.9 for r in raised)


def test_remembered_tables_are_read_by_column(spark):
    """Matches and facts are read many times for few columns, so they are written in columns."""
    matches, facts, _ = remembered(spark, "/root/testdata/sf0.001")
    assert matches.inputFiles() and facts.inputFiles()
    assert facts.select("fact_id").distinct().count() == facts.count()
