"""The funnel and the spending stream: interruptions, resumption, late and broken answers."""

import json
import random
import shutil

import pytest
from helpers import assert_same
from pyspark.sql import functions as F

from terrashift import plans
from terrashift.operators import funnel, verdicts
from terrashift.plans import funnel_queries
from terrashift.streaming import spending

MODEL = "claude-haiku-4-5"
GOOD = {"vlm_verdict": "real_change", "change_type": "flooding", "visual_evidence": ["water"], "artifact_risk": dict.fromkeys(verdicts.RISKS, "low"), "confidence": 0.9, "requires_human_review": False}


def message(body, stop="end_turn", **usage):
    text = body if isinstance(body, str) else json.dumps(body)
    return json.dumps({"stop_reason": stop, "content": [{"type": "text", "text": text}], "usage": {"input_tokens": 1000, "output_tokens": 100} | usage})


def judge(spark, n=20):
    rows = [(f"t{k:03d}", f"city{k % 3}", "candidate_change" if k % 2 else ("no_change" if k % 4 else "low_quality"), k % 2) for k in range(n)]
    return spark.createDataFrame(rows, "tile_id string, city string, gate string, label int")


def put(spark, folder, name, rows):
    spark.createDataFrame(rows, funnel.RESULT).coalesce(1).write.json(f"{folder}/{name}")


def stream(spark, folder):
    return spark.readStream.schema(funnel.RESULT).option("maxFilesPerTrigger", 1).json(f"{folder}/*/*.json")


def ledger(spark, path):
    return sorted(tuple(r) for r in funnel.rows(spark, path).select("tile_id", "gate", "vlm_called", "vlm_verdict", "error", "cost_usd", "batch").collect())


def test_interrupted_between_batches_and_resumed(spark, tmp_path, monkeypatch):
    def prepared(name):
        path, folder = str(tmp_path / name), str(tmp_path / f"{name}-answers")
        calls = funnel.open_round(judge(spark), path, MODEL, 6)
        ids = sorted(r.custom_id for r in calls.collect())
        assert len(ids) == 6
        for k in range(3):
            put(spark, folder, f"f{k}", [(i, "succeeded", None, message(GOOD)) for i in ids[2 * k : 2 * k + 2]])
        return path, folder

    whole, folder = prepared("whole")
    funnel.collect(stream(spark, folder), whole)

    broken, folder = prepared("broken")
    real, seen = funnel.answered, []

    def dies(part, planned, number):
        seen.append(number)
        if len(seen) == 2:
            raise RuntimeError("killed")
        return real(part, planned, number)

    monkeypatch.setattr(funnel, "answered", dies)
    with pytest.raises(Exception, match="killed"):
        funnel.collect(stream(spark, folder), broken)
    monkeypatch.setattr(funnel, "answered", real)
    assert funnel.rows(spark, broken).where("vlm_called").count() == 2
    assert funnel.open_round(judge(spark), broken, MODEL, 6).count() == 4  # in flight: no new round
    funnel.collect(stream(spark, folder), broken)
    assert ledger(spark, broken) == ledger(spark, whole) and len(ledger(spark, whole)) == 20
    funnel.collect(stream(spark, folder), broken)
    assert ledger(spark, broken) == ledger(spark, whole)
    report = funnel.report(spark, whole).first()
    assert (report.n_pairs, report.n_vlm_calls, report.n_batch_calls) == (20, 6, 6) and report.total_usd == pytest.approx(6 * (1000 * 1.0 + 100 * 5.0) * 0.5 / 1e6, abs=1e-4)


def test_a_cap_holds_over_rounds_and_lost_answers_stay_in_flight(spark, tmp_path):
    path, folder = str(tmp_path / "run"), str(tmp_path / "answers")
    first = judge(spark).where("tile_id < 't010'")
    ids = sorted(r.custom_id for r in funnel.open_round(first, path, MODEL, 3, "sequential").collect())
    put(spark, folder, "a", [(ids[0], "succeeded", None, message(GOOD)), (ids[1], "errored", "overloaded", None), ("nobody", "succeeded", None, message(GOOD))])
    funnel.collect(stream(spark, folder), path)
    assert [r.custom_id for r in funnel.open_round(judge(spark), path, MODEL, 9).collect()] == ids[2:]
    put(spark, folder, "b", [(ids[2], "expired", None, None), (ids[2], "succeeded", None, message("no json"))])
    funnel.collect(stream(spark, folder), path)
    held = {r.tile_id: r for r in funnel.rows(spark, path).collect()}
    assert "nobody" not in held and held[ids[1]].error == "batch result errored: overloaded" and held[ids[1]].cost_usd == 0
    assert (held[ids[2]].vlm_verdict, held[ids[2]].error) == ("uncertain", None) and held[ids[2]].cost_usd > 0
    second = funnel.open_round(judge(spark), path, MODEL, 5).collect()
    assert len(second) == 2 and all(r.custom_id >= "t010" for r in second)
    put(spark, folder, "c", [(r.custom_id, "succeeded", None, message(GOOD)) for r in second])
    funnel.collect(stream(spark, folder), path)
    assert funnel.open_round(judge(spark), path, MODEL, 5).count() == 0
    assert len(ledger(spark, path)) == 20 and sum(r[2] for r in ledger(spark, path)) == 5


def test_a_half_written_plan_is_no_plan(spark, tmp_path):
    path = str(tmp_path / "run")
    funnel.open_round(judge(spark), path, MODEL, 4)
    (tmp_path / "run" / "plans" / "round-000000" / "_SUCCESS").unlink()
    assert funnel.rows(spark, path).count() == 0
    assert funnel.open_round(judge(spark), path, MODEL, 4).count() == 4 and funnel.rows(spark, path).count() == 16


@pytest.mark.parametrize("change, cause", [
    ({}, None),
    ({"confidence": "0.25"}, None),
    ({"confidence": 1}, None),
    ({"requires_human_review": "YES"}, None),
    ({"requires_human_review": 0}, None),
    ({"confidence": True}, "confidence is not between 0 and 1"),
    ({"confidence": None}, "confidence is not between 0 and 1"),
    ({"confidence": "high"}, "confidence is not between 0 and 1"),
    ({"confidence": -0.1}, "confidence is not between 0 and 1"),
    ({"vlm_verdict": 3}, "vlm_verdict is not allowed"),
    ({"change_type": "Flooding"}, "change_type is not allowed"),
    ({"visual_evidence": "water"}, "visual_evidence is not 1 to 8 texts"),
    ({"visual_evidence": []}, "visual_evidence is not 1 to 8 texts"),
    ({"visual_evidence": ["a"] * 9}, "visual_evidence is not 1 to 8 texts"),
    ({"visual_evidence": ["a", None]}, "visual_evidence is not 1 to 8 texts"),
    ({"artifact_risk": {"snow": "low"}}, "artifact_risk is not allowed"),
    ({"artifact_risk": dict.fromkeys(verdicts.RISKS, "low") | {"smoke": "low"}}, "artifact_risk is not allowed"),
    ({"artifact_risk": ["low"]}, "artifact_risk is not allowed"),
    ({"requires_human_review": 2}, "requires_human_review is no flag"),
    ({"extra": 1}, "unknown field"),
])
def test_answers_are_checked_field_by_field(spark, change, cause):
    rows = spark.createDataFrame([(message(GOOD | change),)], "message string")
    got = verdicts.parsed(rows).first()
    assert got.cause == (cause and f"schema validation failed: {cause}")
    if cause:
        assert (got.vlm_verdict, got.vlm_confidence, got.human_review, got.vlm_evidence) == ("uncertain", 0.0, True, [f"No usable model response: schema validation failed: {cause}"])
    else:
        assert got.vlm_verdict == "real_change" and got.vlm_confidence == float(({"confidence": 0.9} | change)["confidence"]) and got.human_review == (got.vlm_confidence < 0.5 or change.get("requires_human_review") == "YES")


def test_broken_messages_are_uncertain(spark):
    cases = [(None, verdicts.EMPTY), ("", verdicts.EMPTY), ("{", verdicts.EMPTY), ("[]", verdicts.EMPTY), ('{"content": "text"}', verdicts.EMPTY), (message(" \n"), verdicts.EMPTY), (message(GOOD, "refusal"), verdicts.REFUSED), (message(GOOD, "max_tokens"), verdicts.TRUNCATED), (message("3"), "schema validation failed: not a JSON object"), (message("{}"), "schema validation failed: vlm_verdict is missing")]
    got = verdicts.with_usage(verdicts.parsed(spark.createDataFrame([(k, m) for k, (m, _) in enumerate(cases)], "k int, message string"))).orderBy("k").collect()
    assert [r.cause for r in got] == [c for _, c in cases]
    assert all(r.vlm_verdict == "uncertain" and r.human_review for r in got) and got[0].input_tokens == 0 and got[6].output_tokens == 100


def test_metadata_holds_only_what_is_listed(spark):
    rows = spark.createDataFrame([("t", 0.5, "candidate_change", 3)], "tile_id string, cloud_fraction_max double, gate string, season_delta_days int")
    assert json.loads(verdicts.redacted(rows).first().metadata) == {"tile_id": "t", "observation_quality": {"cloud_fraction_max": 0.5, "season_delta_days": 3}}


def test_every_way_to_be_broken_is_in_the_query(spark):
    rows = spark.range(40).select("id", funnel_queries.message(F.col("id")).alias("message"))
    causes = {r.id % 20: r.cause for r in verdicts.parsed(rows).collect()}
    assert {k: c for k, c in causes.items() if c} == funnel_queries._CAUSES


# --- spending


def brute(rows, cap, ttl):
    out, quotes, holds, settled, used = [], {}, {}, {}, set()
    for session, ident, ts, kind, ref, fingerprint, micro in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        held = holds.setdefault(session, {})
        settled.setdefault(session, 0)
        if kind == "quote":
            quotes[session, ident] = (fingerprint, micro, ts + ttl)
            said = "quoted"
        elif kind == "reserve":
            quote = quotes.get((session, ref))
            if quote is None or ts > quote[2]:
                said = "refused: no live quote"
            elif (session, ref) in used:
                said = "refused: already used"
            elif quote[0] != fingerprint:
                said = "refused: another request"
            elif settled[session] + sum(held.values()) + quote[1] > cap:
                said = "refused: over the cap"
            else:
                said, held[ident] = "reserved", quote[1]
                used.add((session, ref))
        elif ref not in held:
            said = "refused: no such hold"
        elif kind == "uncertain":
            said = "uncertain"
        else:
            del held[ref]
            settled[session] += micro if kind == "settle" else 0
            said = "settled" if kind == "settle" else "released"
        out.append((session, ident, said, settled[session], sum(held.values())))
    return sorted(out)


def spending_log(n=400):
    rng = random.Random(3)
    rows, t = [], 0
    for ident in range(n):
        t += rng.randrange(60)
        kind = rng.choice(["quote", "quote", "reserve", "reserve", "settle", "uncertain", "release"])
        ref = None if kind == "quote" else rng.randrange(max(0, ident - 25), ident + 2)
        rows.append((rng.randrange(3), ident, t, kind, ref, rng.choice("aab"), rng.randrange(1, 40)))
    # refs to quotes and reservations of the session itself, most of the time
    last = {}
    fixed = []
    for r in rows:
        key = {"reserve": "quote"}.get(r[3], "reserve")
        ref = last.get((r[0], key), r[4]) if r[3] != "quote" and rng.random() < 0.8 else r[4]
        last[r[0], r[3]] = r[1]
        fixed.append((*r[:4], ref, *r[5:]))
    return fixed


def test_spending_survives_a_restart(spark, tmp_path):
    rows, cap, ttl = spending_log(), 60, 300
    want = brute(rows, cap, ttl)
    assert len({d for _, _, d, _, _ in want}) == 10
    log, state = tmp_path / "log", str(tmp_path / "state")
    schema = spending.LOG.replace("ts timestamp", "at bigint")
    parts = [rows[:150], rows[150:290], rows[290:]]

    def put_part(k):
        df = spark.createDataFrame(parts[k], schema).withColumn("ts", F.timestamp_seconds(F.col("at") + 1_700_000_000)).select(*(c.split()[0] for c in spending.LOG.split(", ")))
        df.coalesce(1).write.parquet(str(log / f"slice={k}"))

    got = []
    for k in range(3):  # a new query each time, from the checkpoint of the one before
        put_part(k)
        got += [(r.session, r.event_id, r.decision, r.settled_micro, r.held_micro) for r in spending.decided(spark, str(log), cap, ttl, checkpoint=state).collect()]
    assert sorted(got) == want
    shutil.rmtree(state)
    whole = spending.decided(spark, str(log), cap, ttl, max_files=3).collect()
    assert sorted((r.session, r.event_id, r.decision, r.settled_micro, r.held_micro) for r in whole) == want


def test_spending_keeps_large_ids_and_missing_amounts(spark, tmp_path):
    """A missing ref or amount makes no other one a double; an event of nobody decides nothing."""
    big = 2**60
    rows = [
        (7, big + 1, 0, "quote", None, "a", 5), (7, big + 3, 1, "reserve", big + 1, "a", None), (7, big + 5, 2, "settle", big + 3, "a", None),
        (7, big + 7, 3, "release", big + 4, "a", 1), (None, 9, 4, "quote", None, "a", 1),
    ]
    log = spark.createDataFrame(rows, spending.LOG.replace("ts timestamp", "at bigint")).withColumn("ts", F.timestamp_seconds(F.col("at") + 1_700_000_000))
    log.select(*(c.split()[0] for c in spending.LOG.split(", "))).coalesce(1).write.parquet(str(tmp_path / "log"))
    got = sorted((r.event_id - big, r.decision, r.settled_micro, r.held_micro) for r in spending.decided(spark, str(tmp_path / "log"), 60, 300).collect())
    assert got == [(1, "quoted", 0, 0), (3, "reserved", 0, 5), (5, "settled", 0, 0), (7, "refused: no such hold", 0, 0)]


def test_spending_loses_no_event_of_a_slice_in_many_files(spark, data, duck):
    """Files of a slice overlap in time: none is late because another was read before."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert_same(plans.QUERIES["spend_decisions"](spark, data), duck, plans.ORACLES["spend_decisions"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
