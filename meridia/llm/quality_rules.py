"""Quality rules: text statistics and a learned decision list, in Spark expressions only.

Sequential covering learns from labelled statistics: a rule starts empty and grows by
the threshold condition with the best gain on the growing rows, is pruned on held-back
rows, and is kept while it rejects precisely; the rows it covers are set aside and the
next rule begins. The list is an ordered chain of conditional expressions.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridia.llm._shared import sampled, written

SYMBOLS = "#*$%&|<>"
ENDS = ".!?"
WINDOW = 8
#: Labelled rows that the fit uses at most; cut points of a feature for each label.
SAMPLE, CUTS = 20_000, 24
FEATURES = ("n_words", "mean_word", "symbols_per_word", "ends_per_word", "dup_line_share", "repeat_share", "distinct_share")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(hashes: Column) -> Column:
    """Words in windows whose hash occurs more than once among the text's windows."""

    def repeated(ordered: Column) -> Column:
        last = F.size(ordered) - 1
        same = lambda s, j: ((j > 0) & (F.get(ordered, j - 1)["h"] == s["h"])) | ((j < last) & (F.get(ordered, j + 1)["h"] == s["h"]))
        return F.sort_array(F.array_compact(F.transform(ordered, lambda s, j: F.when(same(s, j), s["i"]))))

    def length(at: Column) -> Column:
        gaps = F.transform(at, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(at, j + 1) - p, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(_let(_let(ordered, repeated), length))


def _of_words(words: Column) -> Column:
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(WINDOW)]))
    return F.struct(
        n.cast("long").alias("n_words"),
        F.size(F.array_distinct(words)).cast("long").alias("n_distinct_words"),
        F.when(n >= WINDOW, _let(hashes, _covered)).otherwise(0).cast("long").alias("n_repeat_words"),
        F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
    )


def _of_marks(marks: Column) -> Column:
    count = lambda chars: (F.char_length(marks) - F.char_length(F.translate(marks, chars, ""))).cast("long")
    return F.struct(count(SYMBOLS).alias("n_symbols"), count(ENDS).alias("n_ends"))


def _of_lines(lines: Column) -> Column:
    full = F.filter(lines, lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return _let(full, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))


def text_statistics(docs: DataFrame, carry: dict[str, Column], text_col: str = "text") -> DataFrame:
    """The carried columns and the statistics of each row's whole text.

    n_words, n_distinct_words, word_chars, n_symbols, n_ends, n_lines, n_dup_lines and
    n_repeat_words (words in windows of WINDOW words that occur twice or more in the
    text, the first one included; windows are compared by 64-bit hashes). A null text
    counts as empty, and all statistics of an empty one are 0.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), "")
    marks = F.regexp_replace(text, r"[^#*$%&|<>.!?]+", "")
    rows = docs.select(
        *[c.alias(n) for n, c in carry.items()],
        _let(words, _of_words).alias("of_words"),
        _let(F.split(text, "\n", -1), _of_lines).alias("of_lines"),
        _let(marks, _of_marks).alias("of_marks"),
    )
    return rows.select(*carry, "of_words.*", "of_lines.*", "of_marks.*")


def features() -> dict[str, Column]:
    """The features of the rules from the columns of text_statistics."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    values = ("n_words", F.col("word_chars") / n, F.col("n_symbols") / n, F.col("n_ends") / n, F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)), F.col("n_repeat_words") / n, F.col("n_distinct_words") / n)
    return {name: (F.col(v) if isinstance(v, str) else v).cast("double") for name, v in zip(FEATURES, values, strict=True)}


@dataclass(frozen=True)
class Condition:
    """feature > cut, or feature <= cut."""

    feature: str
    above: bool
    cut: float

    def column(self, of: dict[str, Column]) -> Column:
        return of[self.feature] > self.cut if self.above else of[self.feature] <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:g}"


@dataclass
class DecisionList:
    """Ordered rules; the first whose conditions all hold rejects the text, otherwise it is kept."""

    rules: list[tuple[Condition, ...]] = field(default_factory=list)

    def matched(self, of: dict[str, Column]) -> Column:
        """The number of the first rule that holds, from 1, or null."""
        chain = F.lit(None).cast("int")
        for i in range(len(self.rules), 0, -1):
            chain = F.when(_all(self.rules[i - 1], of), F.lit(i)).otherwise(chain)
        return chain

    def __str__(self) -> str:
        return "\n".join("reject if " + " and ".join(map(str, r)) for r in self.rules) + "\nelse keep"


def _all(rule: tuple[Condition, ...], of: dict[str, Column]) -> Column:
    found = F.lit(True)
    for c in rule:
        found = found & c.column(of)
    return found


def fit(stats: DataFrame, label: str = "bad", seed_col: str = "doc_id", rules: int = 6, conditions: int = 3, precision: float = 0.95, least: int = 5) -> DecisionList:
    """A decision list from labelled statistics: `label` is 1 for texts to reject, 0 for others.

    stats has the columns of text_statistics; the caller bounds its rows. A third of the rows,
    chosen by a hash of seed_col, prunes. A rule is kept if it has at least `precision` on
    growing and pruning rows and rejects at least `least` growing rows; the first that does
    not ends the list. Rows with a null label are left out; no rows give an empty list.
    """
    table = stats.select(F.col(label).cast("int").alias("bad"), (F.pmod(F.xxhash64(seed_col), F.lit(3)) == 0).alias("prunes"), *[c.alias(n) for n, c in features().items()]).where("bad IS NOT NULL")
    table = written(table.repartition(4), "labelled-statistics")
    steps = [i / CUTS for i in range(CUTS + 1)]
    by_label = table.groupBy("bad").agg(*[F.percentile_approx(f, steps, 10_000).alias(f) for f in FEATURES]).collect()
    cuts = {f: sorted({float(x) for r in by_label for x in r[f] or []}) for f in FEATURES}
    of = {f: F.col(f) for f in FEATURES}
    found = DecisionList()
    for _ in range(rules):
        left = table.where(F.coalesce(found.matched(of), F.lit(0)) == 0)
        rule = _grow(left.where(~F.col("prunes")), cuts, of, conditions, precision, least)
        rule = _prune(left, rule, of, precision, least)
        if not rule:
            break
        found.rules.append(rule)
    return found


def _grow(rows: DataFrame, cuts: dict[str, list[float]], of: dict[str, Column], conditions: int, precision: float, least: int) -> tuple[Condition, ...]:
    """The rule that greedy growth by information gain gives."""
    rule: tuple[Condition, ...] = ()
    for _ in range(conditions):
        best, whole = _best_condition(rows.where(_all(rule, of)), cuts, least)
        if best is None:
            break
        rule += (best[1],)
        if best[2] >= 0.999 or whole == 0:
            break
    return rule


def _bin(value: Column, cuts: list[float]) -> Column:
    """How many of the cuts the value is above."""
    return F.size(F.filter(F.array(*[F.lit(x) for x in cuts]), lambda cut: value > cut))


def _best_condition(rows: DataFrame, cuts: dict[str, list[float]], least: int) -> tuple[tuple[float, Condition, float] | None, int]:
    """(gain, condition, precision) of the best condition, and how many rows are to be rejected.

    One aggregation counts both labels by feature and bin; sums over the bins give every cut.
    """
    bins = [F.struct(F.lit(f).alias("feature"), _bin(F.col(f), cuts[f]).alias("bin")) for f in FEATURES if cuts[f]]
    if not bins:
        return None, 0
    counted = rows.select("bad", F.explode(F.array(*bins)).alias("at")).groupBy("at.feature", "at.bin").agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")).collect()
    best = None
    for f in FEATURES:
        mine = {r["bin"]: (r["p"], r["n"]) for r in counted if r["feature"] == f}
        P, N = (sum(v[i] for v in mine.values()) for i in (0, 1))
        if not P or not N:
            continue
        p = n = 0
        for i, cut in enumerate(cuts[f]):  # bin i: above the first i cuts only
            p, n = p + mine.get(i, (0, 0))[0], n + mine.get(i, (0, 0))[1]
            for above, (a, b) in ((False, (p, n)), (True, (P - p, N - n))):
                if a >= least:
                    gain = a * (math.log2(a / (a + b)) - math.log2(P / (P + N)))
                    if gain > 0 and (best is None or gain > best[0]):
                        best = (gain, Condition(f, above, cut), a / (a + b))
    return best, sum(r["n"] for r in counted)


def _prune(rows: DataFrame, rule: tuple[Condition, ...], of: dict[str, Column], precision: float, least: int) -> tuple[Condition, ...]:
    """The prefix of the rule that is best on the pruning rows, if it is precise on both parts."""
    if not rule:
        return ()
    held = [_all(rule[: i + 1], of) for i in range(len(rule))]
    count = lambda where: F.coalesce(F.sum(F.when(where, 1)), F.lit(0))
    cells = [count(h & (F.col("prunes") == part) & (F.col("bad") == bad)).alias(f"c{i}_{int(part)}_{bad}") for i, h in enumerate(held) for part in (False, True) for bad in (0, 1)]
    c = rows.agg(*cells).first()
    best = ()
    top = -2.0
    for i in range(len(rule)):
        grow_p, grow_n, prune_p, prune_n = (c[f"c{i}_{part}_{bad}"] for part in (0, 1) for bad in (1, 0))
        worth = (prune_p - prune_n) / max(1, prune_p + prune_n)
        precise = grow_p >= precision * (grow_p + grow_n) and prune_p >= precision * (prune_p + prune_n)
        if precise and grow_p >= least and worth > top:
            best, top = rule[: i + 1], worth
    return best


def labelled_statistics(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """Statistics of about `sample` labelled documents at most, chosen by a hash of the id, with bad = 1 where the label is 0."""
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("labelled_id")).agg(F.min(label_col).alias("label"))
    rows = sampled(rows.withColumn("seed", F.xxhash64("labelled_id")), rows.count(), sample).drop("seed")
    joined = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(rows), F.col("id") == F.col("labelled_id"))
    return text_statistics(joined, {"doc_id": F.col("id"), "bad": (F.col("label") == 0).cast("int")})


def judge(docs: DataFrame, rules: DecisionList, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, statistics, base_failed, rule, kept) of each row.

    base_failed: fewer than 20 words, or more than 30 of 100 words in repeated windows;
    such rows are not kept, nor are those that a rule matches (its number is in `rule`).
    Null and empty texts fail. Repeated rows give repeated rows; an empty table gives none.
    """
    stats = text_statistics(docs, {id_col: F.col(id_col)}, text_col)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    judged = stats.withColumns({"base_failed": failed, "rule": rules.matched(features())})
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
