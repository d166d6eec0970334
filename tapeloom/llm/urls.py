"""URL filters: listed rules first, then logistic regression on hashed character n-grams of host and path.

A rule is a host with a path prefix; it fits the host and its subdomains, and the longest fitting rule decides.  All other URLs are
judged by the model, which is fitted by gradient descent on a small labelled table: each step is one aggregation that gives the gradient
of at most ``BUCKETS`` weights, whatever the size of that table.  Everything is SQL functions, in training and on the pages, and the pages
are read once, only id and URL, without a shuffle.

A null URL and one without ``://`` have an empty host and path, no rule, and the model's verdict on nothing, which is allow.  Repeated rows
are judged one by one; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 4096
STEPS = 30

#: (rule, verdict)
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]

#: The small labelled table: hosts that sell, bet, track or spam against ordinary ones, each with a few paths.
BLOCKED_HOSTS = ["best-casino.example", "www.online-casino-bonus.example", "casino-royal-win.example", "free-bets-today.example", "bets-and-odds.example",
                 "www.poker-win.example", "cheap-pills.example", "buy-cheap-meds.example", "pills-online.example", "www.adult-video.example", "adult-x-cams.example",
                 "x-rated-chat.example", "ads-track.example", "m.track-ads-click.example", "pixel-ads.example", "spam-farm.example", "link-farm-spam.example",
                 "www.seo-spam-links.example", "free-money-fast.example", "win-big-prize.example", "payday-loan-cheap.example", "slots-jackpot.example",
                 "free-download-crack.example", "cheap-watches-replica.example", "hot-singles-adult.example", "click-bait-farm.example"]
ALLOWED_HOSTS = ["news.example", "www.city-library.example", "blog.history.example", "docs.software.example", "wiki.science.example", "www.university.example",
                 "recipes.kitchen.example", "weather.example", "m.newspaper.example", "museum.example", "forum.gardening.example", "api.reference.example",
                 "blog.thinker.example", "www.theother.example", "there.example", "another.example", "shop.books.example", "www.town-hall.example", "maps.travel.example",
                 "journal.medicine.example", "school.example", "parliament.example", "www.orchestra.example", "blog.tionable.example", "thing.example", "m.statement.example",
                 "python-docs.example", "marathon.example", "m.nation.example", "health.example", "www.month.example", "m.station.example", "thethings.example"]
PATHS = ["/en/1203", "/de/40/", "/fr/777.html", "/es/5", "/"]


def labelled_urls(spark: SparkSession) -> DataFrame:
    """``url, blocked``: each listed host with each path."""
    hosts = [f"('{h}', {y})" for y, listed in ((1, BLOCKED_HOSTS), (0, ALLOWED_HOSTS)) for h in listed]
    paths = ", ".join(f"'{p}'" for p in PATHS)
    return spark.sql(f"SELECT concat('https://', host, path) AS url, blocked FROM (SELECT host, blocked, explode(array({paths})) AS path FROM VALUES {', '.join(hosts)} AS t(host, blocked))").coalesce(1)


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, then in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        rule_host, _, rule_path = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith("/" + rule_path)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(then)).otherwise(verdict)
    return name, verdict


def _grams(s: Column, n: int, kind: str) -> Column:
    """Hashed n-grams of a string; ``kind`` keeps those of host and path apart."""
    at = F.when(F.length(s) >= n, F.sequence(F.lit(1), F.length(s) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.pmod(F.xxhash64(F.lit(kind), F.substr(s, i, F.lit(n))), F.lit(BUCKETS)).cast("int"))


def features(host: Column, path: Column) -> Column:
    """Distinct buckets of the 3- and 4-grams of the host and the 3-grams of the path."""
    framed = F.when(host != "", F.concat(F.lit("."), host, F.lit("/"))).otherwise(F.lit(""))
    return F.array_distinct(F.concat(_grams(framed, 3, "h3"), _grams(framed, 4, "h4"), _grams(path, 3, "p3")))


def _margin(buckets: Column, weights: list[float], bias: float) -> Column:
    table = F.split(F.lit(",".join(f"{w:.6g}" for w in weights)), ",").cast("array<double>")
    total = F.aggregate(buckets, F.lit(0.0), lambda acc, b: acc + F.element_at(table, b + 1))
    return total / F.sqrt(F.greatest(F.size(buckets), F.lit(1)).cast("double")) + F.lit(float(bias))


def _chance(margin: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def fit(labelled: DataFrame, steps: int = STEPS, rate: float = 60.0, decay: float = 0.0005) -> tuple[list[float], float]:
    """Weights and bias after so many steps of gradient descent with momentum."""
    rows = labelled.select(features(host_of(F.col("url")), path_of(F.col("url"))).alias("f"), F.col("blocked").cast("double").alias("y"))
    weights, speed, bias = [0.0] * BUCKETS, [0.0] * BUCKETS, 0.0
    for _ in range(steps):
        error = rows.select("f", (F.col("y") - _chance(_margin(F.col("f"), weights, bias))).alias("e"))
        each = error.select(F.explode("f").alias("bucket"), (F.col("e") / F.sqrt(F.size("f").cast("double"))).alias("e"))
        gradient = {r["bucket"]: r["g"] for r in each.groupBy("bucket").agg(F.sum("e").alias("g")).collect()}  # at most BUCKETS rows
        n = max(1.0, float(len(BLOCKED_HOSTS)))
        for b in range(BUCKETS):
            speed[b] = 0.8 * speed[b] + gradient.get(b, 0.0) / n * rate / 60.0 - decay * weights[b]
            weights[b] += speed[b]
    return weights, bias


def url_filters(pages: DataFrame, labelled: DataFrame, rules: Sequence[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, score``: the score is the model's chance of a URL to be blocked."""
    weights, bias = fit(labelled)
    cut = pages.select(F.col(f"`{id_col}`").alias("page_id"), host_of(F.col(f"`{url_col}`")).alias("host"), path_of(F.col(f"`{url_col}`")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    scored = cut.select("*", rule.alias("rule"), verdict.alias("by_rule"), _chance(_margin(features(F.col("host"), F.col("path")), weights, bias)).alias("score"))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("score") > 0.5, "block").otherwise("allow")).alias("verdict"), "score")
