"""URL filters: rules by host and path, and a logistic regression for what no rule covers."""

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epistrand.sources import materialize

ALLOW, BLOCK = "allow", "block"
GRAM = 3
FEATURES = 1 << 15
MAX_LABELLED = 20_000
BLOCK_SHARE = 0.2  # weight of all blocked examples: what is like none of them is allowed

# The small table of labelled URLs: what hosts are about, in the shapes below.
BLOCKED_TOPICS = (
    "ads adult adserver banner bets betting bingo bonus casino cheap clicks cracked dating escort "
    "free gambling hotgirls jackpot keygen lottery loans nude payday pharmacy pills poker popups porn prizes "
    "replica sex slots spam track tracker viagra warez win winner xxx"
).split()
ALLOWED_TOPICS = (
    "archive articles arts blog books bank chemistry cinema city club college court culture docs events "
    "film forum garden geography health history journal kitchen library magazine market maths museum music "
    "nature news open paper parents photos physics poetry radio recipes research schools science shop "
    "sports stories theatre things town trains travel university village weather wiki world"
).split()
SHAPES = (
    "https://{0}.org/en/1", "http://www.{0}-site.net/de/22.html", "https://m.the-{0}.com/fr/333/",
    "https://blog.{0}.net/es/44?page=2", "http://{0}-x.org/en/5", "https://my{0}.com/en/6#top",
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    """Holds for a host and all its subdomains, if the path starts with ``path``."""

    host: str
    path: str
    verdict: str


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, and then up to ``?`` or ``#``.

    ASCII letters of the host become lower case. Both are empty for NULL and without ``://``.
    """
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    place = F.regexp_extract(rest, r"\A[^?#]*", 0)
    host = F.substring_index(place, "/", 1)
    return F.translate(host, UPPER, LOWER), F.substring(place, F.length(host) + 1, F.greatest(F.length(place), F.lit(1)))


def _longest_first(rules: Sequence[Rule]) -> list[Rule]:
    return sorted(rules, key=lambda r: (-len(r.host + r.path), -len(r.host), r))


def decide(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits (of equally long ones, that with the longer host), and its verdict; NULL without one."""
    rule = verdict = F.lit(None).cast("string")
    for r in reversed(_longest_first(rules)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        rule = F.when(fits, F.lit(r.host + r.path)).otherwise(rule)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return rule, verdict


def features(rows: DataFrame) -> DataFrame:
    """Add the hashed character n-grams of ``host`` and ``path``; those of the two differ."""

    def grams(text, mark):
        framed = F.concat(F.lit(mark), text, F.lit(mark))
        starts = F.sequence(F.lit(1), F.greatest(F.length(framed) - (GRAM - 1), F.lit(1)))
        return F.transform(starts, lambda i: F.concat(F.lit(mark), F.substring(framed, i, F.lit(GRAM))))

    counted = rows.withColumn("_grams", F.concat(grams(F.col("host"), "<"), grams(F.col("path"), ">")))
    hashed = HashingTF(numFeatures=FEATURES, binary=True, inputCol="_grams", outputCol="_features")
    return hashed.transform(counted).drop("_grams")


class UrlModel:
    """A logistic regression, or one verdict for all where labels of only one kind were given."""

    def __init__(self, regression: LogisticRegressionModel | None, constant: float):
        self.regression, self.constant = regression, constant

    def add_probability(self, rows: DataFrame) -> DataFrame:
        """Add ``block_probability`` to rows with host and path."""
        if self.regression is None:
            return rows.withColumn("block_probability", F.lit(self.constant))
        columns = [f"`{c}`" for c in rows.columns]
        scored = self.regression.transform(features(rows))
        return scored.select(*columns, vector_to_array("_probability")[1].alias("block_probability"))


def fit(labelled: DataFrame, max_labelled: int = MAX_LABELLED) -> UrlModel:
    """Learn from a small table of ``url`` and ``verdict`` (allow or block; others do not count).

    Of a larger table, the ``max_labelled`` rows with the smallest md5 of the url are used.
    The blocked examples weigh ``BLOCK_SHARE`` in sum. Without labels of both kinds, all URLs get the
    probability 1 or 0 of the only one, and 0 without any.
    """
    host, path = host_and_path(F.col("url"))
    known = labelled.filter(F.col("verdict").isin(ALLOW, BLOCK) & F.col("url").isNotNull())
    sample = known.select("url", "verdict").distinct().orderBy(F.md5("url"), "url", "verdict").limit(max_labelled)
    sample = materialize(sample.select(host.alias("host"), path.alias("path"), (F.col("verdict") == BLOCK).cast("double").alias("_label")))
    n = sample.agg(F.count("*").alias("all"), F.coalesce(F.sum("_label"), F.lit(0.0)).alias("block")).first()
    if not 0 < n["block"] < n["all"]:
        return UrlModel(None, 1.0 if n["block"] else 0.0)
    share = n["block"] / n["all"]
    weight = F.when(F.col("_label") == 1, F.lit(BLOCK_SHARE / share)).otherwise(F.lit((1 - BLOCK_SHARE) / (1 - share)))
    regression = LogisticRegression(
        featuresCol="_features", labelCol="_label", weightCol="_weight", probabilityCol="_probability",
        rawPredictionCol="_raw", predictionCol="_prediction", regParam=0.001, maxIter=40,
    )
    return UrlModel(regression.fit(features(sample).withColumn("_weight", weight)), 0.0)


def judge(pages: DataFrame, rules: Sequence[Rule], model: UrlModel) -> DataFrame:
    """One row per row of ``pages``: its columns in ``page``, host, path, rule, block_probability and verdict.

    The verdict is that of the longest rule that fits, else what the model finds likelier.
    ``pages`` needs a column url.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.struct("*").alias("page"), host.alias("host"), path.alias("path"))
    rule, verdict = decide(F.col("host"), F.col("path"), rules)
    guess = F.when(F.col("block_probability") >= 0.5, F.lit(BLOCK)).otherwise(F.lit(ALLOW))
    scored = model.add_probability(rows.select("page", "host", "path", rule.alias("rule"), verdict.alias("_said")))
    return scored.withColumn("verdict", F.coalesce("_said", guess)).drop("_said")


def examples(spark: SparkSession) -> DataFrame:
    """The small labelled table: url, verdict."""
    labelled = [(t, BLOCK) for t in BLOCKED_TOPICS] + [(t, ALLOW) for t in ALLOWED_TOPICS]
    return spark.createDataFrame([(x.format(t), v) for t, v in labelled for x in SHAPES], "url string, verdict string")
