"""Held keys over time that follow a camera track: votes for moves, and angle debts for looks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.operators.sequences import vote_keys

# The keys of moves along and across the view, and of looks.
MOVES = {"z": ("W", "S"), "x": ("D", "A")}
#: Keys of a positive and a negative turn: yaw to the right, pitch up.
LOOKS = (("L", "J"), ("I", "K"))


def _axis(debt: Column, last: Column, increment: Column, rate: float, span: Column, least_pulse: float) -> Column:
    """struct(debt, last, sign, hold, saturated) of one angle after a window.

    A turn against the last one drops the debt. The key is held as long as debt and
    increment ask for at its rate, within the window; shorter pulses than the least are saved up.
    """
    sign = F.when(increment > 0.05, 1).when(increment < -0.05, -1).otherwise(0)
    carried = F.when((sign != 0) & (last != 0) & (sign != last), F.lit(0.0)).otherwise(debt)
    error = carried + increment
    asked = F.when(sign != 0, F.least(F.abs(error) / rate, span)).otherwise(0.0)
    hold = F.when(asked < least_pulse, 0.0).otherwise(asked)
    saturated = (sign != 0) & (F.abs(error) > rate * span + 0.01)
    return F.struct((error - sign * hold * rate).alias("debt"), F.when(sign != 0, sign).otherwise(last).alias("last"), sign.alias("sign"), hold.alias("hold"), saturated.alias("saturated"))


def action_windows(moves: DataFrame, keys: list[str], index: str, coordinates: tuple[str, ...], yaw: str, pitch: str, seconds: str, rates: tuple[float, float], frames: int = 12, least_pulse: float = 0.1) -> DataFrame:
    """(keys, window, start, span, pressed, yaw, pitch) of every window of so many moves; yaw and pitch are structs of debt, last, sign, hold, saturated.

    A row of moves is the step from frame `index` (0, 1, 2 ..) to the next in the camera's own axes, with the turn in
    degrees; `seconds` is what the whole track is to last. Each window's debts depend on those
    before, so a track's windows, some 80, are folded as one array; moves are summed before that.
    """
    cut = moves.withColumn("window", F.floor(F.col(index) / frames))
    sums = cut.groupBy(*keys, "window").agg(F.sum(yaw).alias("_yaw"), F.sum(pitch).alias("_pitch"), F.count("*").alias("_n"), F.max(seconds).alias("_s"))
    every = sums.groupBy(*keys).agg(F.sum("_n").alias("_all"), F.max("_s").cast("double").alias("_s"), F.sort_array(F.collect_list(F.struct("window", "_yaw", "_pitch", "_n"))).alias("_w"))
    second = F.col("_s") / F.col("_all")
    blank = F.struct(F.lit(0.0).alias("debt"), F.lit(0).alias("last"), F.lit(0).alias("sign"), F.lit(0.0).alias("hold"), F.lit(False).alias("saturated"))
    entry = "array<struct<window: bigint, start: double, span: double, yaw: struct<debt: double, last: int, sign: int, hold: double, saturated: boolean>, pitch: struct<debt: double, last: int, sign: int, hold: double, saturated: boolean>>>"

    def step(acc: Column, w: Column) -> Column:
        start = w["window"] * frames * second
        span = w["_n"] * second
        turned = F.struct(w["window"].alias("window"), start.alias("start"), span.alias("span"), _axis(acc["yaw"]["debt"], acc["yaw"]["last"], w["_yaw"], rates[0], span, least_pulse).alias("yaw"), _axis(acc["pitch"]["debt"], acc["pitch"]["last"], w["_pitch"], rates[1], span, least_pulse).alias("pitch"))
        return F.transform(F.array(turned), lambda t: F.struct(t["yaw"].alias("yaw"), t["pitch"].alias("pitch"), F.array_append(acc["out"], t).alias("out")))[0]

    start = F.struct(blank.alias("yaw"), blank.alias("pitch"), F.array().cast(entry).alias("out"))
    folded = every.select(*keys, F.inline(F.aggregate("_w", start, step)["out"]))
    pressed = vote_keys(cut, [*keys, "window"], MOVES, coordinates)
    return folded.join(pressed, [*keys, "window"])


def timed_actions(windows: DataFrame, keys: list[str], tail: float = 2.0) -> DataFrame:
    """(keys, start_s, end_s, pressed): stretches of constant held keys of action_windows(), in touch with each other, and a last one without keys.

    Within a window the move keys are held throughout and a look key for its hold from the start on; equal neighbours are one.
    """
    holds = F.array("yaw.hold", "pitch.hold")
    cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.col("span")), F.filter(holds, lambda h: (h > 0) & (h < F.col("span"))))))
    parts = windows.select(*keys, "window", "start", "pressed", "yaw", "pitch", cuts.alias("cuts"))
    parts = parts.select("*", F.posexplode(F.slice("cuts", 1, F.size("cuts") - 1)).alias("_i", "_from"))
    look = [F.when(F.col(f"{a}.hold") > F.col("_from") + 1e-9, F.when(F.col(f"{a}.sign") > 0, p).otherwise(n)) for a, (p, n) in zip(("yaw", "pitch"), LOOKS, strict=True)]
    rows = parts.select(*keys, (F.col("start") + F.col("_from")).alias("start_s"), (F.col("start") + F.get("cuts", F.col("_i") + 1)).alias("end_s"), F.concat("pressed", F.array_compact(F.array(*look))).alias("pressed"))
    w = Window.partitionBy(*keys).orderBy("start_s")
    fresh = F.when(F.col("pressed") == F.lag("pressed").over(w), 0).otherwise(1)
    numbered = rows.withColumn("_fresh", fresh).withColumn("_run", F.sum("_fresh").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    held = numbered.groupBy(*keys, "_run").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.first("pressed").alias("pressed")).drop("_run")
    if tail <= 0:
        return held
    ends = windows.groupBy(*keys).agg(F.max(F.col("start") + F.col("span")).alias("start_s"))
    return held.unionByName(ends.select(*keys, "start_s", (F.col("start_s") + tail).alias("end_s"), F.array().cast("array<string>").alias("pressed")))
