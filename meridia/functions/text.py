"""Text contracts: captions, prompts, identifiers and reviews."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meridia.functions.vectors import let

# Patterns of the caption contract.
WORD = r"[A-Za-z0-9]+(?:[-'][A-Za-z0-9]+)*"
META = r"(?i)^(?:this\s+(?:image|video|frame|scene)|the\s+(?:image|video|frame)|in\s+this\s+(?:image|video|frame))\b"
IMAGE_PLANE = r"(?i)\b(?:on|to)\s+the\s+(?:left|right)\b|\b(?:foreground|background)\b"
PLANE_PHRASES = (r"(?i)\b(?:on|to)\s+the\s+(?:left|right)\s*,?\s*", r"(?i)\b(?:in\s+the\s+)?(?:foreground|background)\s*,?\s*")
PROMPT_WORD = r"[a-z0-9]+(?:-[a-z0-9]+)?"
POSITION = ("left", "right", "upper", "lower", "overhead", "distant", "foreground", "background")
UNBOUNDED = (
    "road", "roads", "pavement", "pavements", "sidewalk", "asphalt", "driveway", "path", "walkway", "alley", "ground", "floor", "floors", "wall", "walls",
    "railway", "railways", "rail", "track", "tracks", "water", "river", "lake", "sea", "ocean", "sky", "background", "backgrounds", "backdrop", "terrain",
    "mountain", "mountains", "hillside", "hillsides", "slope", "slopes", "ridge", "ridges", "cliff", "cliffs", "shore", "riverbed",
)
BOUNDED = (
    "facade", "façade", "door", "doorway", "sign", "signage", "building", "house", "storefront", "window", "arch", "archway", "bridge", "overpass", "station",
    "platform", "bench", "lamp", "lantern", "cabinet", "painting", "artwork", "sculpture", "statue", "fountain", "awning", "balcony", "pillar", "column",
    "railing", "fence", "umbrella", "planter", "staircase", "stairs",
)


def squeezed(text: Column) -> Column:
    """text with runs of white space as one space, and none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def unfenced(text: Column) -> Column:
    """What a ``` fence holds, or the trimmed text."""
    t = F.trim(text)
    return F.when(t.rlike(r"(?s)^```[^\n]*\n.*```$"), F.trim(F.regexp_replace(F.regexp_replace(t, r"^```[^\n]*\n", ""), r"```$", ""))).otherwise(t)


def caption_problems(caption: Column, least: int = 80, most: int = 150) -> Column:
    """What is wrong with a caption: length, meta framing, directions in the picture plane."""
    c = squeezed(caption)
    n = word_count(c)
    return F.array_compact(F.array(F.when((n < least) | (n > most), F.lit("length")), F.when(c.rlike(META), F.lit("meta")), F.when(c.rlike(IMAGE_PLANE), F.lit("image_plane"))))


def caption_of(response: Column) -> Column:
    """The caption of a response that is exactly one JSON object with the key dense_caption, or null."""
    body = unfenced(response)
    only = F.json_object_keys(body)
    return F.when((F.size(only) == 1) & (F.element_at(only, 1) == "dense_caption"), squeezed(F.get_json_object(body, "$.dense_caption")))


def without_plane_phrases(caption: Column) -> Column:
    """caption without phrases that only place things in the picture, its first letter upper case."""
    t = caption
    for phrase in PLANE_PHRASES:
        t = F.regexp_replace(t, phrase, "")
    t = squeezed(t)
    return F.concat(F.upper(F.substring(t, 1, 1)), F.substr(t, F.lit(2)))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(PROMPT_WORD), F.lit(0))


def _any_of(words: Column, listed: tuple[str, ...]) -> Column:
    return F.arrays_overlap(words, F.array(*[F.lit(w) for w in listed]))


def bounded_anchor(text: Column) -> Column:
    """Whether a label names a bounded thing: it has a word, and none of an unbounded surface unless one of a bounded thing is there too."""
    return let(_words(text), _bounded)


def _bounded(words: Column) -> Column:
    return (F.size(words) > 0) & (~_any_of(words, UNBOUNDED) | _any_of(words, BOUNDED))


def prompt(text: Column) -> Column:
    """A prompt in lower case with single spaces, or null if it breaks the contract: 1 to 4 words, no and/or, no place words, a bounded anchor."""
    held = lambda words: F.size(words).between(1, 4) & ~_any_of(words, ("and", "or", *POSITION)) & _bounded(words)
    return let(squeezed(F.lower(text)), lambda p: F.when(let(_words(p), held), p))


def prompts(texts: Column) -> Column:
    """The distinct prompts of a list in their order, or null unless all hold the contract and 2 to 4 are left."""
    each = F.array_distinct(F.transform(texts, prompt))
    return F.when(F.forall(each, lambda p: p.isNotNull()) & F.size(each).between(2, 4), each)


def slug(text: Column) -> Column:
    """text with every run of other characters than letters, digits, _ and - as one _, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"[^a-zA-Z0-9_-]+", "_"), r"^_+|_+$", "")


def last_number(text: Column) -> Column:
    """The last run of digits as a number, or null."""
    return F.try_to_number(F.nullif(F.regexp_extract(text, r"(\d+)\D*$", 1), F.lit("")), F.lit("999999999999999999")).cast("long")


def safe_name(text: Column) -> Column:
    """Whether text is one plain path component."""
    return F.coalesce(text.rlike(r"^[^/\\\x00]+$") & ~text.isin(".", ".."), F.lit(False))
