"""Answers of a reviewing model, read by contract.

An answer holds one JSON object, from its first { to its last }: schema_version,
scene_hazards (each known hazard true or false), pair_usable (true if and only if no hazard is),
pair_reason and candidates (label, anchor_kind, sam_prompts). What breaks the contract
gets the name of the first broken rule instead of an error; candidates that break
theirs are left out, and a usable pair must keep three.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridia.functions import text
from meridia.functions.tables import settled
from meridia.functions.vectors import let

# The hazards in order with the reason to reject that each gives, the kinds of an anchor.
HAZARDS = {
    "shot_boundary": "multi_shot",
    "endpoint_no_coview": "no_coview",
    "low_light_or_blur": "unreliable_visual_evidence",
    "severe_weather_or_visibility_loss": "severe_weather",
    "salient_person_or_crowd": "dynamic_dominant",
    "moving_traffic_dominant": "dynamic_dominant",
    "persistent_text_overlay": "unreliable_visual_evidence",
    "open_or_generic_scene": "no_distinctive_anchor",
    "no_distinctive_shared_anchor": "no_distinctive_anchor",
    "severe_anchor_occlusion": "severe_occlusion",
}
KINDS = ("instance", "compact_structure")
LEAST, MOST = 3, 8


def _kind(value: Column) -> Column:
    """OBJECT<..>, ARRAY<..>, BOOLEAN, STRING, .. of a variant; empty for a missing one."""
    return F.coalesce(F.schema_of_variant(value), F.lit(""))


def _text(value: Column, missing: str) -> Column:
    """A variant as text with single spaces: null as None, true and false capitalised, lists and objects as JSON."""

    def as_text(value: Column) -> Column:
        plain = F.try_variant_get(value, "$", "string")
        shown = lambda kind: F.when(kind == "VOID", F.lit("None")).when(kind == "BOOLEAN", F.initcap(plain)).otherwise(F.coalesce(plain, F.to_json(value)))
        return F.when(value.isNull(), F.lit(missing)).otherwise(let(_kind(value), shown))

    return text.squeezed(let(value, as_text))


def _at(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "variant")


def _whole(body: Column) -> Column:
    """The variant of a text that is one JSON value and nothing behind it, or null.

    The parser stops behind the first value. In a list, only ] may follow it there, and in
    an object only }, so a text that is whole in both has nothing left over.
    """
    listed = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), body, F.lit("]"))), "$", "array<variant>")
    nested = F.try_parse_json(F.concat(F.lit('{"v":'), body, F.lit("}")))
    return F.when((F.size(listed) == 1) & nested.isNotNull(), F.get(listed, F.lit(0)))


def _candidate(raw: Column) -> Column:
    """(label, kind, prompts) of an item; null where it breaks a rule. Broken prompts are left out, 2 to 4 different ones must remain."""
    listed = F.try_variant_get(raw, "$.sam_prompts", "array<variant>")
    kept = F.array_compact(F.array_distinct(F.transform(listed, lambda p: text.prompt(_text(p, "")))))
    read = F.struct(_text(_at(raw, "label"), "").alias("label"), _text(_at(raw, "anchor_kind"), "instance").alias("kind"), kept.alias("prompts"))
    fine = lambda c: (c["label"] != "") & text.bounded_anchor(c["label"]) & c["kind"].isin(*KINDS) & F.size(c["prompts"]).between(2, 4)
    return let(read, lambda c: F.when(fine(c), c))


def parsed(answers: DataFrame, answer: str, carry: list[str], version: str) -> DataFrame:
    """(carried, problem, usable, reason, failure_mode, reject_reasons, candidates), a row an answer.

    problem names the first broken rule and leaves the rest null: `object` (none in the
    text, or no text), `json` (invalid, a name twice, or beyond what a variant holds),
    `version`, `hazards` (not just the known ones, each true or false), `usable` (not
    true or false), `contradiction`, `reason` (empty), `candidates` (no list, over 8, or
    under 3 for a usable pair), `prompts` (no list), `few` (under 3 hold the contract).
    A pair that isn't usable has no candidates, whatever its answer lists.
    """
    # Answers are little data and much work, so they are dealt to as many tasks as the session has; each step is settled, so that the next ones read it.
    body = F.regexp_extract(F.coalesce(F.col(answer), F.lit("")), r"(?s)\{.*\}", 0)
    dealt = answers.repartition(int(answers.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    e = settled(settled(dealt.select(*carry, body.alias("_body"))).select(*carry, "_body", _whole(F.nullif(F.col("_body"), F.lit(""))).alias("_v")))
    v = F.col("_v")
    hazards, usable, items = _at(v, "scene_hazards"), _at(v, "pair_usable"), _at(v, "candidates")
    e = e.select(
        *carry,
        "_body",
        "_v",
        F.when(_kind(hazards).startswith("OBJECT"), F.try_variant_get(v, "$.scene_hazards", "map<string,variant>")).alias("_hazards"),
        F.when(_kind(usable) == "BOOLEAN", F.try_variant_get(v, "$.pair_usable", "boolean")).alias("_usable"),
        F.when(_kind(items).startswith("ARRAY"), F.try_variant_get(v, "$.candidates", "array<variant>")).alias("_items"),
        _text(_at(v, "pair_reason"), "").alias("_reason"),
    )
    e = settled(e)
    known = F.array(*[F.lit(h) for h in HAZARDS])
    exact = (F.size(F.map_keys("_hazards")) == len(HAZARDS)) & (F.size(F.array_except(F.map_keys("_hazards"), known)) == 0) & F.forall(F.map_values("_hazards"), lambda b: _kind(b) == "BOOLEAN")
    flags = F.filter(known, lambda h: F.coalesce(F.try_variant_get(F.try_element_at(F.col("_hazards"), h), "$", "boolean"), F.lit(False)))
    e = e.withColumns({"_exact": F.coalesce(exact, F.lit(False)), "_active": F.when(F.coalesce(exact, F.lit(False)), flags)})
    e = settled(e)
    objects = F.filter("_items", lambda c: _kind(c).startswith("OBJECT"))
    e = settled(e.withColumn("_objects", F.when(F.col("_usable"), objects)))
    e = e.withColumns({"_unlisted": F.exists("_objects", lambda c: ~_kind(_at(c, "sam_prompts")).startswith("ARRAY")), "_kept": F.array_compact(F.transform("_objects", _candidate))})
    e = settled(e)
    problem = (
        F.when(F.col("_body") == "", "object")
        .when(v.isNull(), "json")
        .when(~F.coalesce((_kind(_at(v, "schema_version")) == "STRING") & (F.try_variant_get(v, "$.schema_version", "string") == version), F.lit(False)), "version")
        .when(~F.col("_exact"), "hazards")
        .when(F.col("_usable").isNull(), "usable")
        .when(F.col("_usable") != (F.size("_active") == 0), "contradiction")
        .when(F.col("_reason") == "", "reason")
        .when(F.col("_items").isNull() | (F.size("_items") > MOST) | (F.col("_usable") & (F.size("_items") < LEAST)), "candidates")
        .when(F.col("_unlisted"), "prompts")
        .when(F.col("_usable") & (F.size("_kept") < LEAST), "few")
    )
    e = settled(e.withColumn("problem", problem))
    fine = F.col("problem").isNull()
    reasons = F.create_map(*[F.lit(x) for pair in HAZARDS.items() for x in pair])
    return e.select(
        *carry,
        "problem",
        F.when(fine, F.col("_usable")).alias("usable"),
        F.when(fine, F.col("_reason")).alias("reason"),
        F.when(fine, F.coalesce(F.get("_active", F.lit(0)), F.lit("none"))).alias("failure_mode"),
        F.when(fine, F.array_distinct(F.transform("_active", lambda h: F.element_at(reasons, h)))).alias("reject_reasons"),
        F.when(fine, F.coalesce("_kept", F.array().cast("array<struct<label:string,kind:string,prompts:array<string>>>"))).alias("candidates"),
    )
