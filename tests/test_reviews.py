from __future__ import annotations

import json

import pytest

from meridia.operators import reviews
from meridia.plans import review_queries

GOOD = {"label": "Red  door", "sam_prompts": ["Door", "red  door", "door"]}
SIGN = {"label": "sign", "anchor_kind": "compact_structure", "sam_prompts": ["sign", "road sign", "left sign"]}
LAMP = {"label": "lamp", "sam_prompts": ["lamp", "street lamp"]}


def answer(hazards=(), **given):
    whole = {"schema_version": "v1", "scene_hazards": {h: h in hazards for h in reviews.HAZARDS}, "pair_usable": not hazards, "pair_reason": "clear", "candidates": [GOOD, SIGN, LAMP]}
    return json.dumps(whole | given)


def read(spark, answers):
    df = spark.createDataFrame(list(enumerate(answers)), "k int, a string")
    return {r.k: r for r in reviews.parsed(df, "a", ["k"], "v1").collect()}


def test_a_whole_answer_is_read(spark):
    got = read(spark, ["```json\n" + answer() + "\n```"])[0]
    assert (got.problem, got.usable, got.reason, got.failure_mode, got.reject_reasons) == (None, True, "clear", "none", [])
    assert [tuple(c) for c in got.candidates] == [("Red door", "instance", ["door", "red door"]), ("sign", "compact_structure", ["sign", "road sign"]), ("lamp", "instance", ["lamp", "street lamp"])]


def test_hazards_reject_in_their_order_and_drop_candidates(spark):
    got = read(spark, [answer(("severe_anchor_occlusion", "persistent_text_overlay", "low_light_or_blur"))])[0]
    assert (got.problem, got.usable, got.failure_mode, got.candidates) == (None, False, "low_light_or_blur", [])
    assert got.reject_reasons == ["unreliable_visual_evidence", "severe_occlusion"]


@pytest.fixture(scope="module")
def broken(spark):
    some = {h: False for h in reviews.HAZARDS}
    cases = [
        ("object", None), ("object", ""), ("object", "} no {"), ("json", "{a}"), ("json", answer() + " }"), ("json", answer() + "," + answer()), ("json", answer() + "] [" + answer()), ("json", answer() + "} {\"v\":" + answer()), ("version", "{}"), ("version", answer(schema_version="v2")), ("version", answer(schema_version=None)),
        ("hazards", answer(scene_hazards=[])), ("hazards", answer(scene_hazards={**some, "fog": False})), ("hazards", answer(scene_hazards=dict(list(some.items())[1:]))), ("hazards", answer(scene_hazards={**some, "shot_boundary": "true"})),
        ("hazards", answer(scene_hazards={**some, "shot_boundary": None})), ("usable", answer(pair_usable="true")), ("usable", answer(pair_usable=None)), ("contradiction", answer(pair_usable=False)), ("reason", answer(pair_reason=" ")),
        ("candidates", answer(candidates={})), ("candidates", answer(candidates=None)), ("candidates", answer(candidates=[GOOD, SIGN])), ("candidates", answer(candidates=[GOOD] * 9)), ("candidates", answer(("shot_boundary",), candidates="none")),
        ("prompts", answer(candidates=[GOOD, SIGN, LAMP, {"label": "arch"}])), ("prompts", answer(candidates=[GOOD, SIGN, LAMP, {"label": "arch", "sam_prompts": "arch"}])), ("few", answer(candidates=[GOOD, SIGN, 1])),
        ("few", answer(candidates=[GOOD, SIGN, LAMP | {"label": "open sky"}])), ("few", answer(candidates=[GOOD, SIGN, LAMP | {"anchor_kind": None}])), ("few", answer(candidates=[GOOD, SIGN, LAMP | {"sam_prompts": ["a", "b", "c", "d", "e"]}])),
    ]
    return cases, read(spark, [a for _, a in cases])


def test_the_first_broken_rule_is_named(broken):
    cases, got = broken
    assert [got[i].problem for i in range(len(cases))] == [p for p, _ in cases]
    assert all(got[i].usable is None and got[i].candidates is None for i in got)


def test_items_beside_three_good_ones_may_break_their_rules(spark):
    odd = [answer(candidates=[GOOD, 1, SIGN, None, LAMP, {"label": "", "sam_prompts": ["x", "y"]}]), answer(candidates=[GOOD, GOOD, GOOD]), answer(pair_reason=7, extra={"deep": [1]})]
    got = read(spark, odd)
    assert [len(got[i].candidates) for i in range(3)] == [3, 3, 3] and got[2].reason == "7"


def test_the_query_meets_every_rule(spark, sf_dir):
    seen = {r.problem for r in review_queries.review_answers(spark, sf_dir).select("problem").distinct().collect()}
    assert seen == {None, "object", "json", "version", "hazards", "usable", "contradiction", "reason", "candidates", "prompts", "few"}


def test_no_answers(spark):
    assert reviews.parsed(spark.createDataFrame([], "k int, a string"), "a", ["k"], "v1").count() == 0
