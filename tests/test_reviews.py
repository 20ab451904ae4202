"""Shared states, portraits, payloads and advice on small inputs: nulls, empty tables, ties, every rule."""

import itertools
import random

import pytest

from chatloom.functions import times
from chatloom.operators import guidance, payloads, portraits, shared

STATE = "part string, id string, value string"
REGISTRY = "person string, ord long, claim_id string, kind string, text string, quote string, source_ids array<string>, eligible boolean, score long, first_ts timestamp_ntz, last_ts timestamp_ntz"


def model(base, local, remote):
    """The merged state of dicts by (part, id), rule by rule."""
    out = {}
    for key in base.keys() | local.keys() | remote.keys():
        part = key[0]
        b, l, r = key in base, key in local, key in remote
        changed = b != l or base.get(key) != local.get(key)
        if part == "setting":
            side = local if changed else remote
        elif part == "dismissed":
            side = {key: None} if (r and not (b and not l)) or (l and not b) else {}
        elif b and not l or (part != "positions" and b and not r):
            side = {}
        else:
            side = local if l and changed else remote
        if key in side:
            out[key] = side[key]
    return out


def test_merged_state_is_the_models(spark):
    rng = random.Random(7)
    keys = list(itertools.product(("tasks", "people", "dismissed", "positions", "setting"), map(str, range(12))))
    states = [{k: None if k[0] == "dismissed" else rng.choice(["a", "b", None]) for k in keys if rng.random() < 0.6} for _ in range(3)]
    frames = [spark.createDataFrame([(*k, v) for k, v in s.items()], STATE) for s in states]
    got = {(r["part"], r["id"]): r["value"] for r in shared.merged(*frames).collect()}
    assert got == model(*states)
    assert {r["part"] for r in shared.differences(frames[0], frames[1]).collect()} == {k[0] for k in keys if (k in states[0]) != (k in states[1]) or states[0].get(k) != states[1].get(k)}


def test_states_may_be_empty(spark):
    empty = spark.createDataFrame([], STATE)
    assert shared.merged(empty, empty, empty).count() == 0
    state, back = shared.hydrated(empty, empty, empty, "5", "2")
    assert [tuple(r) for r in state.collect()] == [("setting", "people_model_version", "5")] and back is not None


@pytest.mark.parametrize("version, people, written", [("5", 1, False), ("4", 0, True)])
def test_people_of_another_model_version_go(spark, version, people, written):
    remote = spark.createDataFrame([("people", "p", "x"), ("setting", "people_model_version", version)], STATE)
    current = remote.unionByName(spark.createDataFrame([("messages", "m", "kept")], STATE))
    state, back = shared.hydrated(current, remote, remote, "5", "2")
    assert state.where("part = 'people'").count() == people and state.where("part = 'messages'").count() == 1
    assert (back is not None) == written


def test_a_strong_word_needs_two_messages(spark):
    claims = "claim_id string, name string, key string, expected string, kind string, text string, quote string, source_ids array<string>"
    rows = [("one", "Ann", "k", None, "fact", "Ann 喜欢 tea", "tea", ["1"]), ("two", "Ann", "k", None, "fact", "Ann 喜欢 tea", "tea", ["2", "1", "2"]), ("nobody", "Bob", "k", "Bob", "fact", "tea", "tea", ["1"]), ("null", None, "k", None, "fact", None, None, None)]
    said = spark.createDataFrame([("k", "1", "ann", "other", "Tea, please", None), ("k", "2", "Ann", "other", "more t e a", None), ("k", "3", "me", "self", "tea", None)], "key string, id string, speaker string, speaker_role string, content string, captured_ts timestamp_ntz")
    got = portraits.borne_out(spark.createDataFrame(rows, claims), said).collect()
    assert [(r["claim_id"], r["source_ids"], r["category"]) for r in got] == [("two", ["2", "1"], "preference")]


def test_each_rule_of_a_block(spark):
    registry = spark.createDataFrame([("p", 1, "a", "fact", "drinks green tea", "green tea daily", ["1"], True, 1, None, None), ("p", 2, "b", "fact", "was ill", "was ill", ["2"], False, 1, None, None)], REGISTRY)
    notes = spark.createDataFrame([("p", "walks by the river"), ("q", None)], "person string, notes string")
    said = [("", ["a"]), ("green tea daily", None), ("green tea 信息不足", ["a"]), ("was ill", ["b"]), ("xyz", ["user-profile-notes"]), ("by the river", ["user-profile-notes"]), ("xyz", ["a"]), ("green tea in 1999", ["a"]), ("green tea daily", ["a"])]
    blocks = spark.createDataFrame([("p", i + 1, t, c, None) for i, (t, c) in enumerate(said)], "person string, pos long, text string, claim_ids array<string>, reason string")
    got = portraits.checked_blocks(blocks, registry, notes, "2024-01-20 00:00:00").orderBy("pos").collect()
    # the ninth block is past the most that are read
    assert [r["issue"] for r in got] == ["missing-text-or-claims", "missing-text-or-claims", "disclaimer", "claim-not-for-portraits", "no-anchor-in-notes", None, "no-anchor-in-claims", "unsupported-number"]
    assert {r["scope"] for r in got} == {"undated"} and {r["reason"] for r in got} == {"other"}
    empty = portraits.checked_blocks(blocks.limit(0), registry.limit(0), notes.limit(0), "2024-01-20 00:00:00")
    assert empty.count() == 0


def test_signatures_change_with_claims_and_notes(spark):
    registry = spark.createDataFrame([("p", 1, "a", "fact", "tea", "tea", ["2", "1"], True, 1, None, None), ("q", 1, "a", "fact", "tea", None, None, True, None, None, None)], REGISTRY)
    notes = spark.createDataFrame([("r", " n "), ("s", " ")], "person string, notes string")

    def of(claims, version="1"):
        return {r["person"]: r["signature"] for r in portraits.signatures(claims, notes, version).collect()}

    first = of(registry)
    assert set(first) == {"p", "q", "r"} and of(registry) == first
    assert {p for p, s in of(registry.replace("tea", "milk", "text")).items() if s != first[p]} == {"p", "q"}
    assert all(s != first[p] for p, s in of(registry, "2").items())


def test_a_payload_without_rows_and_with_nulls(spark):
    asked = spark.createDataFrame([("a", None, None, None, None, None), ("b", None, None, 1, None, None), ("c", None, None, None, None, [1, None])], "payload string, total long, declared long, segment int, segments int, core array<long>")
    records = spark.createDataFrame([("b", "1", "x", None), ("c", "1", None, "s")], "payload string, id string, content string, summary string")
    got = payloads.checked(asked, records, spark.createDataFrame([], "payload string, mime string, size long")).collect()
    assert {r["payload"]: r["issue"] for r in got} == {"a": "no-records", "b": "segment-number", "c": "core-places"}


def test_events_tell_no_place(spark):
    schema = "payload string, ord long, id string, kind string, title string, summary string, start_ts string, end_ts string, values map<string,string>"
    rows = [("a", 1, "1", "location", "Home", "at home", "2024-01-01", "2023-01-01", {"home_lat": "1", "steps": " 5 ", "latency": "2", "b c": "3", "blank": " ", "none": None}), ("a", 2, "2", None, "t", None, "2024-01-01", None, None), ("a", 3, "3", "x", "t", None, None, None, {})]
    got = payloads.coarse_events(spark.createDataFrame(rows, schema)).orderBy("ord").collect()
    assert [(r["id"], r["kind"], r["title"], r["summary"], r["end_ts"], r["values"]) for r in got] == [("1", "location", "Location capture", None, None, {"steps": "5", "latency": "2"}), ("2", "custom", "t", None, None, None)]


def test_risks_of_advice(spark):
    rows = spark.createDataFrame([(None,), ("  ",), ("Use PUA",), ("ask her",), ("她一定爱你",)], "advice string")
    assert [r[0] for r in rows.select(guidance.risk(rows["advice"])).collect()] == ["empty", "empty", "manipulative-or-overconfident", None, "manipulative-or-overconfident"]


def test_times_that_are_none(spark):
    rows = spark.createDataFrame([(None, None, None), ("", "", ""), ("2024-02-30", None, None), ("2024-02-29T08:05:00", "2024-02-29T08:05:00", None)], "start_at string, due_at string, source_at string")
    got = [tuple(r)[3:] for r in times.labelled_tasks(rows).collect()]
    none = (times.NO_TARGET_TIME, times.NO_SOURCE_TIME, times.PENDING, times.NO_SOURCE_TIME)
    assert got[:2] == [none, none] and got[2] == ("开始/发生：2024-02-30", "开始/发生：2024-02-30", times.PENDING, times.NO_SOURCE_TIME)
    assert got[3] == ("发生：2024年2月29日 08:05", "发生：2024年2月29日 08:05", "08:05", "2024-02-29")
