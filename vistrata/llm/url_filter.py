"""URL verdicts: rules by host and path, else logistic regression on hashed character n-grams. DataFrame functions and
Spark ML only.

Features are the character trigrams and 4-grams of the host and of the path, marked by where they come from and with
both ends marked, hashed to FEATURES binary columns. The model is trained from a small labelled table of URLs (url,
label 1 to block) that the caller passes; LABELLED is the default. The rules are few and become one expression, the
longest first.

Defined cases: a null url, or one without ://, has an empty host and path and is judged by the model on those; repeated
rows and null page_ids are judged row by row; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import string

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES = 1 << 14
SIZES = (3, 4)

# The rules of the stated policy, verdict and rule.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]

# The default labelled table. Words of unwanted hosts, each with four partners in turn, before or after.
UNWANTED_WORDS = [
    "casino", "poker", "slots", "jackpot", "bets", "betting", "lottery", "pills", "pharma", "viagra", "adult", "xxx", "porn",
    "sex", "escort", "spam", "ads", "clicks", "tracker", "popup", "loans", "payday", "crypto", "prizes", "warez", "torrents",
    "phish", "malware", "replica",
]
PARTNERS = ["win", "online", "free", "cheap", "farm", "track", "bonus", "club", "top", "x", "tube", "hot", "cash"]
UNWANTED = [f"{w}-{p}" if k % 2 == 0 else f"{p}-{w}" for i, w in enumerate(UNWANTED_WORDS)
            for k in range(4) for p in [PARTNERS[(4 * i + k) % len(PARTNERS)]]]
# Words of wanted hosts: alone, two in one word, and with a neutral partner.
WANTED_WORDS = [
    "weather", "station", "nation", "mother", "thing", "another", "learning", "reading", "history", "garden", "science",
    "northern", "theatre", "thunder", "therapy", "breath", "athlete", "author", "health", "library", "museum", "gazette",
    "journal", "kitchen", "recipes", "travel", "tourism", "school", "college", "research", "archive", "wiki", "docs",
    "manual", "forum", "music", "nature", "ocean", "railway", "architect", "together", "ethan", "anthem", "southern",
    "translation", "education", "stable", "table", "handle", "render", "shared", "washing", "listing", "orient",
]
NEUTRAL = ["news", "library", "school", "town", "river", "center", "guide", "lab", "home", "daily"]
WANTED = (WANTED_WORDS + [a + b for a, b in zip(WANTED_WORDS, WANTED_WORDS[7:] + WANTED_WORDS[:7])]
          + [f"{w}-{NEUTRAL[i % len(NEUTRAL)]}" if i % 2 else f"{NEUTRAL[i % len(NEUTRAL)]}-{w}" for i, w in enumerate(WANTED_WORDS)])
PREFIXES = ["", "www.", "m.", "blog."]
PATHS = ["/en/1024", "/de/77.html", "/fr/310", "/es/5", "/", ""]


def labelled(spark: SparkSession) -> DataFrame:
    """The default labelled table: url, label. Each host with two prefixes; paths and endings in turn."""
    rows = [(f"https://{PREFIXES[(i + k) % len(PREFIXES)]}{w}.example.{('com', 'org', 'net')[(i + k) % 3]}{PATHS[(i + k) % len(PATHS)]}", label)
            for label, words in ((1.0, UNWANTED), (0.0, WANTED)) for i, w in enumerate(words) for k in (0, 1)]
    return spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(u).alias("url"), F.lit(y).alias("label")) for u, y in rows))))


def _lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return _lower(host), path


def _grams(where: str, name: str) -> Column:
    text = F.concat(F.lit("^"), F.col(name), F.lit("$"))
    lists = [F.when(F.length(text) >= n, F.transform(
        F.sequence(F.lit(1), F.length(text) - n + 1), lambda i, n=n: F.concat(F.lit(f"{where}:"), F.substring(text, i, n))))
        .otherwise(F.array(text)) for n in SIZES]
    return F.concat(*lists)


def features(pages: DataFrame) -> DataFrame:
    """The rows with host, path and features."""
    host, path = parts(F.col("url"))
    rows = pages.withColumns({"host": host, "path": path}).withColumn("grams", F.concat(_grams("h", "host"), _grams("p", "path")))
    return HashingTF(numFeatures=FEATURES, binary=True, inputCol="grams", outputCol="features").transform(rows).drop("grams")


def train(table: DataFrame) -> LogisticRegressionModel:
    """A model of the labelled table (url, label)."""
    rows = features(table.select("url", "label")).cache()
    model = LogisticRegression(maxIter=40, regParam=0.002).fit(rows)
    rows.unpersist()
    return model


def rule_of(rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for word, text in sorted(rules, key=lambda r: len(r[1])):
        at = text.index("/")
        host, path = _lower(F.lit(text[:at])), F.lit(text[at:])
        fits = ((F.col("host") == host) | F.endswith("host", F.concat(F.lit("."), host))) & F.startswith("path", path)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, word).otherwise(verdict)
    return rule, verdict


def judged(pages: DataFrame, model: LogisticRegressionModel, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's probability of block."""
    made = model.transform(features(pages.select("page_id", "url")))
    rule, verdict = rule_of(rules)
    chance = vector_to_array("probability")[1]
    return made.select("page_id", "host", "path", rule.alias("rule"),
                       F.coalesce(verdict, F.when(chance >= 0.5, "block").otherwise("allow")).alias("verdict"),
                       chance.alias("block_probability"))
