"""URL filters: allow / block rules first, then a logistic regression on hashed
character n-grams of host and path.

Everything is DataFrame expressions.  The labelled URL table is small and of
checked size, so the whole fit is one aggregate expression over one row; what
reaches the driver is the weight vector, whose length is a parameter.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 1024
EPOCHS = 30
RATE = 0.5
DECAY = 1e-4
MOST_LABELLED = 5_000

# A small labelled table (1: block). Hosts are invented.
LABELLED_URLS = [
    ("http://cheap-meds.example.com/buy/now", 1), ("https://www.cheap-pills-shop.example.org/order?id=4", 1),
    ("http://pills-online.example.net/sale", 1), ("https://blog.discount-pills.example.com/en/10", 1),
    ("http://casino-royal.example.net/en/spin", 1), ("https://m.win-casino.example.org/de/220", 1),
    ("http://online-casino.example.com/fr/bonus", 1), ("https://casino-winner.example.net/en/31.html", 1),
    ("http://free-bet.example.org/odds", 1), ("https://www.best-bets.example.com/en/311", 1),
    ("http://sport-bets-free.example.net/es/9", 1), ("https://free-betting.example.net/en/71", 1),
    ("http://adult-video.example.com/en/1", 1), ("https://m.adult-xx.example.org/de/15", 1),
    ("http://www.x-adult.example.net/fr/99?page=2", 1), ("https://adult-chat-x.example.com/en/64", 1),
    ("http://spam-site.example.org/en/12", 1), ("https://link-farm.example.com/de/8", 1),
    ("http://spamfarm-links.example.net/es/77", 1), ("https://www.farm-of-spam.example.org/en/5", 1),
    ("http://ads-server.example.com/track/1", 1), ("https://m.ad-tracker.example.net/en/41", 1),
    ("http://track-ads.example.org/en/48?ref=x", 1), ("https://ads-tracking.example.com/de/2", 1),
    ("http://www.thering.example.org/de/39547.html", 0), ("https://blog.weather.example.com/en/20117", 0),
    ("https://news.example.org/en/16941/", 0), ("http://library.example.com/en/16756#top", 0),
    ("https://www.gardening.example.net/fr/25930", 0), ("http://museum.example.org/en/18815.html", 0),
    ("https://m.recipes.example.com/fr/1066.html", 0), ("http://blog.history.example.net/es/24149", 0),
    ("https://thother.example.org/en/3665", 0), ("http://university.example.com/en/33237?page=2&ref=x", 0),
    ("https://www.theatre.example.org/de/29942?utm_source=feed", 0), ("http://blog.other.example.com/en/18320.html", 0),
    ("https://there.example.net/en/28048.html", 0), ("https://m.station.example.org/de/50884", 0),
    ("http://nations.example.com/en/476/", 0), ("https://traction.example.net/en/21003?utm_source=feed", 0),
    ("http://www.thread.example.org/en/5082/", 0), ("https://blog.ththem.example.com/es/44508/", 0),
    ("http://hither.example.org/de/495/", 0), ("https://m.therein.example.net/en/21410/", 0),
    ("http://thorn.example.com/en/47964", 0), ("https://blog.thesis.example.org/de/12044", 0),
    ("http://www.thistle.example.net/en/50775?utm_source=feed", 0), ("https://bletion.example.com/en/28919", 0),
]


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url: host after the first ``://`` up to ``/``, ``?``, ``#`` or the end
    with A-Z lower-cased, path from there up to ``?``, ``#`` or the end; both empty for a null
    url or one without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(url, "://", 1))
    rest = F.coalesce(F.when(rest.isNotNull(), url.substr(F.length(rest) + 4, F.length(url))), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits (``host/path`` text), else null.  A rule fits its host and all
    its subdomains where the path starts with the rule's path."""
    def fits(rule: str) -> Column:
        rule_host, _, rest = rule.partition("/")
        return ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(f"/{rest}")
    ordered = sorted({r for r, _ in rules}, key=lambda r: (-len(r), r))
    return F.coalesce(*[F.when(fits(r), F.lit(r)) for r in ordered], F.lit(None).cast("string"))


def buckets(host: Column, path: Column, width: int = WIDTH) -> Column:
    """Hash buckets (0-based) of the distinct character 3- and 4-grams of ``^host$`` and ``^path$``."""
    def grams(mark: str, text: Column, n: int) -> Column:
        marked = F.concat(F.lit("^"), text, F.lit("$"))
        last = F.greatest(F.length(marked) - (n - 1), F.lit(1))
        return F.transform(F.sequence(F.lit(1), last), lambda i: F.concat(F.lit(mark), F.substring(marked, i, F.lit(n))))
    every = F.concat(*[grams(m, t, n) for m, t in (("h", host), ("p", path)) for n in (3, 4)])
    return F.array_distinct(F.transform(every, lambda g: F.pmod(F.xxhash64(g), F.lit(width)).cast("int")))


def fit(labelled: DataFrame, width: int = WIDTH, epochs: int = EPOCHS, rate: float = RATE, decay: float = DECAY,
        most: int = MOST_LABELLED) -> list[float]:
    """Weights (last one: the constant) by stochastic gradient steps over ``labelled``
    (``url``, ``label`` 0/1; rows with a null in either are left out).

    One fold over one row: the examples in hash order, ``epochs`` times.  The table may hold at
    most ``most`` rows, which is checked; an empty table gives zero weights (probability 0.5)."""
    use = labelled.where(F.col("url").isNotNull() & F.col("label").isNotNull())
    n = use.count()
    if n > most:
        raise ValueError(f"{n} labelled urls; the bound is {most}")
    if n == 0:
        return [0.0] * (width + 1)
    b = buckets(*parts(F.col("url")), width)
    dense = F.transform(F.sequence(F.lit(0), F.lit(width - 1)),
                        lambda i: F.when(F.array_contains(F.col("b"), i), F.col("scale")).otherwise(F.lit(0.0)))
    one = F.struct(F.xxhash64("url").alias("h"), F.col("url"), F.col("label").cast("double").alias("y"),
                   F.concat(dense, F.array(F.lit(1.0))).alias("x"))
    ex = (use.select("url", "label", b.alias("b")).withColumn("scale", F.pow(F.size("b").cast("double"), -0.5) * 3)
          .agg(F.sort_array(F.collect_list(one)).alias("ex")))

    def step(w: Column, e: Column) -> Column:
        dot = F.aggregate(F.zip_with(w, e["x"], lambda a, x: a * x), F.lit(0.0), lambda s, v: s + v)
        miss = F.array(e["y"] - 1 / (1 + F.exp(-dot)))  # an array of one, so that it is worked out once a step
        return F.transform(miss, lambda r: F.zip_with(w, e["x"], lambda a, x: a * (1 - rate * decay) + r * x * rate))[0]
    start = F.array_repeat(F.lit(0.0), width + 1)
    w = F.aggregate(F.flatten(F.array_repeat(F.col("ex"), epochs)), start, step)
    return [float(v) for v in ex.select(w.alias("w")).first()["w"]]


def probability(host: Column, path: Column, weights: list[float]) -> Column:
    """Probability of label 1 under ``fit``'s weights."""
    width = len(weights) - 1
    b, w = buckets(host, path, width), F.array(*[F.lit(float(x)) for x in weights])
    total = F.aggregate(b, F.lit(0.0), lambda s, i: s + F.element_at(w, i + 1))
    return 1 / (1 + F.exp(-(total * 3 / F.sqrt(F.size(b).cast("double")) + F.lit(float(weights[-1])))))


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The fixed small table as a DataFrame."""
    one = [F.struct(F.lit(u).alias("url"), F.lit(y).alias("label")) for u, y in LABELLED_URLS]
    return spark.range(1).select(F.inline(F.array(*one)))


def url_filter(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str]], url: str = "url",
               threshold: float = 0.5) -> DataFrame:
    """Every row of ``pages`` with ``host``, ``path``, ``rule`` (null if none fits), ``p_block``
    and ``verdict`` (``allow`` or ``block``: the rule's, else by ``p_block >= threshold``).

    One map over the pages, no shuffle.  A null or broken url has empty host and path and is
    judged by the regression like any other; repeated rows are each judged; of rules that fit with equal
    length the first in alphabetical order wins; urls of any length are read whole; an empty table gives an empty
    result; columns of the input with one of the five names are replaced."""
    weights = fit(labelled)
    host, path = parts(F.col(url))
    out = pages.withColumns({"host": host, "path": path})
    out = out.withColumns({"rule": rule_of(F.col("host"), F.col("path"), rules),
                           "p_block": probability(F.col("host"), F.col("path"), weights)})
    by_rule = F.lit(None).cast("string")
    for r, v in rules:
        by_rule = F.when(F.col("rule") == r, F.lit(v)).otherwise(by_rule)
    by_model = F.when(F.col("p_block") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return out.withColumn("verdict", F.coalesce(by_rule, by_model))
