"""URL filters: hand-kept rules by host and path, and a learned verdict where no rule fits.

The learned part is a logistic regression on hashed character n-grams of host and path,
trained from a small table of labelled URLs with Spark's own hashing and classifier. Rules and verdicts
are column expressions, so URLs are judged in the JVM, a row at a time and without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Defaults: n-gram sizes, slots of the hash, rows that the fit takes at most.
SIZES, SLOTS, SAMPLE = (3, 4, 5), 1 << 16, 20_000


@dataclass(frozen=True)
class Rule:
    """allow or block for a host, its subdomains, and the paths that start with `path`."""

    verdict: str
    host: str
    path: str = "/"


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z lower-cased; empty without :// and for null."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end, letters as they are; empty without :// and for null."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _longest_first(rules: list[Rule]) -> list[Rule]:
    return sorted(rules, key=lambda r: (-len(r.host + r.path), -len(r.host), r.verdict != "block"))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct(rule, verdict) of the longest fitting rule, null if none fits; of equally long ones the longer host, then block, wins."""
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for r in reversed(_longest_first(rules)):
        fits = ((host == r.host) | F.endswith(host, F.lit(f".{r.host}"))) & F.startswith(path, F.lit(r.path))
        found = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def url_grams(host: Column, path: Column, sizes: tuple[int, ...] = SIZES) -> Column:
    """The character n-grams of both parts, marked by part and with the part's ends; digits count as one character. An empty part has none."""

    def grams(part: Column, mark: str, n: int) -> Column:
        inner = lambda s: F.transform(F.sequence(F.lit(1), F.char_length(s) - (n - 1)), lambda i: F.concat(F.lit(mark), F.substring(s, i, F.lit(n))))
        whole = F.concat(F.lit("^"), F.regexp_replace(part, "[0-9]", "0"), F.lit("$"))
        return F.when(F.char_length(part) >= n - 2, F.flatten(F.transform(F.array(whole), inner))).otherwise(F.array().cast("array<string>"))

    return F.concat(*[grams(part, mark, n) for part, mark in ((host, "h"), (path, "p")) for n in sizes])


def _parts(urls: DataFrame, url_col: str) -> DataFrame:
    """urls with __host, __path and the n-grams of both."""
    split = urls.withColumns({"__host": host_of(F.col(url_col)), "__path": path_of(F.col(url_col))})
    return split.withColumn("__grams", url_grams(F.col("__host"), F.col("__path")))


def _hashed(slots: int) -> HashingTF:
    return HashingTF(inputCol="__grams", outputCol="__features", numFeatures=slots, binary=True)


def fit(labelled: DataFrame, url_col: str = "url", label_col: str = "block", slots: int = SLOTS, sample: int = SAMPLE, strength: float = 0.003) -> LogisticRegressionModel | None:
    """A classifier from rows of a URL and a label, 1 or true for block and 0 or false for allow.

    Of larger tables the `sample` rows with the smallest hashes are taken, the same on
    every run. Rows without URL or label are left out. Without both labels there is
    nothing to learn, and None is returned.
    """
    rows = labelled.select(F.col(url_col).alias("__url"), F.col(label_col).cast("double").alias("__label")).where("__url IS NOT NULL AND __label IS NOT NULL")
    rows = rows.orderBy(F.xxhash64("__url"), "__url", "__label").limit(sample)
    labels = {r["__label"] for r in rows.select("__label").distinct().limit(3).collect()}
    if labels - {0.0, 1.0}:
        raise ValueError("labels are 0 and 1, or false and true")
    if len(labels) < 2:
        return None
    features = _hashed(slots).transform(_parts(rows, "__url")).select("__features", "__label").coalesce(1)
    return LogisticRegression(featuresCol="__features", labelCol="__label", regParam=strength, maxIter=60).fit(features)


def judge(pages: DataFrame, rules: list[Rule], model: LogisticRegressionModel | None, url_col: str = "url", carry: dict[str, Column] | None = None, threshold: float = 0.5) -> DataFrame:
    """(carried columns, host, path, rule, verdict, block_score) of each row.

    verdict is that of the longest rule that fits, or, where none does, block if the
    model gives it a probability over `threshold` and allow otherwise; block_score is that
    probability for every row. Null URLs, and those without ://, have empty host and path,
    fit no rule, and get the score of the model's intercept, as do empty hosts and paths. Without a
    model the score is null and what no rule decides is allowed. Only the URL and the
    carried columns are read, so other columns cannot clash. Repeated rows give repeated
    rows; an empty table gives none.
    """
    carry = carry or {}
    source = pages.select(F.col(url_col).alias("__url"), *[c.alias(n) for n, c in carry.items()])
    parts = _parts(source, "__url")
    if model is None:
        scored = parts.withColumn("__score", F.lit(None).cast("double"))
    else:
        model = model.copy().setProbabilityCol("__probability").setRawPredictionCol("").setPredictionCol("")
        scored = model.transform(_hashed(model.numFeatures).transform(parts)).withColumn("__score", vector_to_array("__probability")[1])
    found = scored.withColumn("__rule", rule_of(F.col("__host"), F.col("__path"), rules))
    learned = F.when(F.col("__score") > threshold, "block").otherwise("allow")
    return found.select(*carry, F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule.rule").alias("rule"), F.coalesce("__rule.verdict", learned).alias("verdict"), F.col("__score").alias("block_score"))
