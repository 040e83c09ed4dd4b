"""Queries of reviewing answers: each part carries one of eighteen whole or broken answers."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.functions import text
from meridia.operators import reviews
from meridia.plans.fixtures import table
from meridia.plans.registry import query

VERSION = "review.v1"
THINGS = ("door", "street sign", "wall", "red lamp", "left window", "stone arch")


def _answer(hazards: dict | None = None, drop: str = "", **given) -> str:
    items = [
        {"label": "@", "anchor_kind": "instance", "sam_prompts": ["@", "  The  @", "@"]},
        {"label": "far bridge", "sam_prompts": ["Bridge", "stone bridge", "bridge or path"]},
        {"label": "bench", "anchor_kind": "compact_structure", "sam_prompts": ["bench", "wooden bench", "old bench", "seat"]},
        {"label": "clock", "sam_prompts": ["clock", "tower clock"]},
    ]
    whole = {"schema_version": VERSION, "scene_hazards": {h: False for h in reviews.HAZARDS} | (hazards or {}), "pair_usable": not hazards, "pair_reason": " a  clear pair ", "candidates": items[:3]}
    whole |= {k: [items[i] for i in v] if k == "candidates" and all(isinstance(i, int) for i in v) else v for k, v in given.items()}
    return json.dumps({k: v for k, v in whole.items() if k != drop})


ANSWERS = (
    _answer(),
    "Here it is: " + _answer(candidates=[0, 1, 2, 3]) + " Done.",
    "I can't tell.",
    "{" + _answer(),
    _answer() + " }",
    _answer() + ", " + _answer(),
    _answer(schema_version="review.v0"),
    _answer(hazards={"fog": True}),
    _answer(hazards={"shot_boundary": 1}),
    _answer(drop="pair_usable"),
    _answer(hazards={"low_light_or_blur": True}, pair_usable=True),
    _answer(pair_reason="  "),
    _answer(candidates=[0, 1]),
    _answer(candidates=[0, 1, 2, 3, 0, 1, 2, 3, 0]),
    _answer(hazards={"persistent_text_overlay": True, "moving_traffic_dominant": True, "low_light_or_blur": True, "salient_person_or_crowd": True}),
    _answer(candidates=[{"label": "@", "sam_prompts": "door"}, {"label": "b", "sam_prompts": []}, "c"]),
    _answer(candidates=[{"label": "@", "anchor_kind": "crowd", "sam_prompts": ["door", "gate"]}, {"label": "open sky", "sam_prompts": ["kite", "bird"]}, {"label": "lamp", "sam_prompts": ["lamp", "light", "lantern", "old lamp", "tall lamp"]}]),
    _answer(hazards={"severe_anchor_occlusion": True}, candidates=[]),
)


def _listed(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


_HAZARDS = ", ".join(f"('{h}', '{r}', {i})" for i, (h, r) in enumerate(reviews.HAZARDS.items()))
_WORDS = "regexp_extract_all({}, '[a-z0-9]+(?:-[a-z0-9]+)?')"


def _bounded(words: str) -> str:
    return f"len({words}) > 0 AND (NOT list_has_any({words}, {_listed(text.UNBOUNDED)}) OR list_has_any({words}, {_listed(text.BOUNDED)}))"


REVIEW_SQL = rf"""WITH a AS (SELECT p_partkey AS k, replace({_listed(ANSWERS)}[p_partkey % {len(ANSWERS)} + 1], '@', {_listed(THINGS)}[(p_partkey // {len(ANSWERS)}) % {len(THINGS)} + 1]) AS answer FROM part),
  b AS (SELECT k, regexp_extract(answer, '(?s)\{{.*\}}') AS body FROM a), c AS (SELECT k, body, CASE WHEN body <> '' AND json_valid(body) THEN CAST(body AS JSON) END AS j FROM b),
  hazard(name, because, i) AS (VALUES {_HAZARDS}),
  d AS (SELECT k, body, j, json_extract(j, '$.scene_hazards') AS h, json_extract(j, '$.candidates') AS c, CASE WHEN json_type(j, '$.pair_usable') = 'BOOLEAN' THEN CAST(json_extract(j, '$.pair_usable') AS BOOLEAN) END AS usable,
          trim(regexp_replace(coalesce(json_extract_string(j, '$.pair_reason'), ''), '\s+', ' ', 'g')) AS reason FROM c),
  active AS (SELECT k, list(name ORDER BY i) AS names, list(because ORDER BY i) AS because FROM d, hazard WHERE json_type(h, '$.' || name) = 'BOOLEAN' AND CAST(json_extract(h, '$.' || name) AS BOOLEAN) GROUP BY k),
  shaped AS (SELECT k, bool_and(json_type(h, '$.' || name) = 'BOOLEAN') IS TRUE AND any_value(len(json_keys(h))) = 10 AS exact FROM d, hazard GROUP BY k),
  item AS (SELECT k, i, json_extract(c, '$[' || i || ']') AS o FROM d, LATERAL (SELECT unnest(range(CAST(json_array_length(c) AS BIGINT))) AS i) WHERE usable AND json_type(c) = 'ARRAY'),
  phrase AS (SELECT k, i, n, lower(trim(regexp_replace(json_extract_string(o, '$.sam_prompts[' || n || ']'), '\s+', ' ', 'g'))) AS p FROM item, LATERAL (SELECT unnest(range(CAST(json_array_length(o, '$.sam_prompts') AS BIGINT))) AS n) WHERE json_type(o, '$.sam_prompts') = 'ARRAY'),
  good AS (SELECT k, i, p, min(n) AS n FROM (SELECT *, {_WORDS.format("p")} AS w FROM phrase) WHERE len(w) BETWEEN 1 AND 4 AND NOT list_has_any(w, {_listed(("and", "or", *text.POSITION))}) AND {_bounded("w")} GROUP BY ALL),
  prompts AS (SELECT k, i, list(p ORDER BY n) AS ps FROM good GROUP BY ALL),
  named AS (SELECT k, i, trim(regexp_replace(coalesce(json_extract_string(o, '$.label'), ''), '\s+', ' ', 'g')) AS label, coalesce(json_extract_string(o, '$.anchor_kind'), 'instance') AS kind FROM item WHERE json_type(o) = 'OBJECT'),
  kept AS (SELECT k, count(*) AS n, string_agg(label || '|' || kind || '|' || array_to_string(ps, ','), ';' ORDER BY i) AS told FROM (SELECT *, {_WORDS.format("lower(label)")} AS w FROM named) JOIN prompts USING (k, i)
           WHERE len(ps) BETWEEN 2 AND 4 AND kind IN ('instance', 'compact_structure') AND {_bounded("w")} GROUP BY k),
  unlisted AS (SELECT DISTINCT k FROM item WHERE json_type(o) = 'OBJECT' AND json_type(o, '$.sam_prompts') IS DISTINCT FROM 'ARRAY'),
  judged AS (SELECT d.k, d.usable, d.reason, names, because, told,
      CASE WHEN body = '' THEN 'object' WHEN j IS NULL THEN 'json' WHEN json_extract_string(j, '$.schema_version') IS DISTINCT FROM '{VERSION}' THEN 'version' WHEN NOT exact THEN 'hazards' WHEN usable IS NULL THEN 'usable'
           WHEN usable <> (names IS NULL) THEN 'contradiction' WHEN reason = '' THEN 'reason' WHEN json_type(c) IS DISTINCT FROM 'ARRAY' OR json_array_length(c) > 8 OR (usable AND json_array_length(c) < 3) THEN 'candidates'
           WHEN u.k IS NOT NULL THEN 'prompts' WHEN usable AND coalesce(kept.n, 0) < 3 THEN 'few' END AS problem
    FROM d JOIN shaped s ON s.k = d.k LEFT JOIN active a ON a.k = d.k LEFT JOIN kept ON kept.k = d.k LEFT JOIN unlisted u ON u.k = d.k)
  SELECT k AS p_partkey, problem, CASE WHEN problem IS NULL THEN usable END AS usable, CASE WHEN problem IS NULL THEN coalesce(names[1], 'none') END AS failure_mode,
         CASE WHEN problem IS NULL THEN array_to_string(list_transform(list_filter(coalesce(because, []), lambda x, i: list_position(because, x) = i), lambda x: x), ',') END AS reject_reasons,
         CASE WHEN problem IS NULL THEN coalesce(CASE WHEN usable THEN told END, '') END AS candidates FROM judged"""


@query("review_answers", REVIEW_SQL)
def review_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every answer says, or the first rule that it breaks."""
    k = F.col("p_partkey")
    pick = lambda values, i: F.get(F.array(*[F.lit(v) for v in values]), (i % len(values)).cast("int"))
    answers = table(spark, sf_dir, "part").select("p_partkey", F.replace(pick(ANSWERS, k), F.lit("@"), pick(THINGS, F.floor(k / len(ANSWERS)))).alias("answer"))
    told = F.array_join(F.transform("candidates", lambda c: F.concat_ws("|", c["label"], c["kind"], F.array_join(c["prompts"], ","))), ";")
    return reviews.parsed(answers, "answer", ["p_partkey"], VERSION).select("p_partkey", "problem", "usable", "failure_mode", F.array_join("reject_reasons", ",").alias("reject_reasons"), told.alias("candidates"))
