"""URL filter: logistic regression on hashed character n-grams of host and path, under rules for hosts and paths.

Everything that touches the pages is a column expression; the training table is small and its fit Spark's own.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, Normalizer
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BUCKETS = 4096
SIZES = (3, 4, 5)
#: Rules (host, path, verdict) of the query.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The labelled table of the query: 1 is to be blocked.
BLOCKED = (
    "http://casino-bonus.example/win/slots http://free-poker.example/casino/bonus http://best-bets.example/betting/odds "
    "http://online-slots.example/jackpot http://xxx-videos.example/porn/free http://hot-adult.example/sex/video "
    "http://adult-cams.example/live/xxx http://cheap-pills.example/viagra/buy http://pharmacy-pills.example/cialis/cheap "
    "http://warez-crack.example/keygen/download http://torrent-crack.example/serial/free http://free-keygen.example/crack "
    "http://click-ads.example/banner/track http://adserver.example/popup/click http://track-ads.example/pixel/banner "
    "http://free-money.example/prize/winner http://win-prize.example/claim/free http://cheap-loans.example/payday/loan "
    "http://payday-cash.example/loan/fast http://login-verify.example/account/secure/update http://secure-update.example/verify/login "
    "http://xn--bank-login.example/verify http://bitcoin-double.example/free/coin http://miracle-diet.example/buy/pills"
).split()
ALLOWED = (
    "http://docs.example/guide/intro http://wiki.example/article/history http://news.example/world/article "
    "http://library.example/books/catalog http://university.example/research/papers http://school.example/courses/math "
    "http://museum.example/visit/collection http://science.example/journal/issue http://blog.example/post/notes "
    "http://forum.example/thread/question http://help.example/faq/answers http://weather.example/forecast/city "
    "http://recipes.example/soup/vegetable http://garden.example/plants/roses http://travel.example/guide/city "
    "http://health.example/topics/sleep http://gov.example/services/forms http://maps.example/route/train "
    "http://music.example/artists/album http://history.example/timeline/century http://www.example.org/en/about "
    "http://www.example.org/de/artikel.html http://blog.example.org/fr/page http://m.example.org/es/texto?page=2"
).split()


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for a null url or one without."""
    return F.translate(F.regexp_extract(_after(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def rule(host_: Column, path_: Column, rules=RULES) -> Column:
    """The longest fitting rule as struct(rule, verdict), null if none fits; of equally long ones the first by name.

    A rule fits its host and all its subdomains where the path starts with the rule's. ``rules`` is a short list, part of
    the plan.
    """
    if not rules:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    best = None
    for name, start, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host_ == name) | host_.endswith("." + name)) & path_.startswith(start)
        found = F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))
        best = F.when(fits, found) if best is None else best.when(fits, found)
    return best


def grams(host_: Column, path_: Column, sizes=SIZES, buckets: int = BUCKETS) -> Column:
    """Buckets of the character n-grams of ``^host`` and of ``/path$``, each part on its own, repeats included."""
    def hashed(part: int, text: Column, n: int) -> Column:
        last = F.length(text) - n + 1
        starts = F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.lit(part), F.substring(text, i, F.lit(n))), F.lit(buckets)).cast("int"))

    parts = enumerate((F.concat(F.lit("^"), host_), F.concat(path_, F.lit("$"))))
    return F.concat(*(hashed(k, text, n) for k, text in parts for n in sizes))


def train(labelled: DataFrame, sizes=SIZES, buckets: int = BUCKETS, ridge: float = 1e-6) -> tuple[list[float], float]:
    """Weights by bucket and the intercept, from a small table ``url, label``: a url is its n-grams' shares."""
    found = grams(host(F.col("url")), path(F.col("url")), sizes, buckets)
    rows = labelled.select(F.col("label").cast("double").alias("label"), F.transform(found, lambda b: b.cast("string")).alias("grams")).coalesce(1)
    counts = CountVectorizerModel.from_vocabulary([str(b) for b in range(buckets)], inputCol="grams", outputCol="counts").transform(rows)
    shares = Normalizer(p=1.0, inputCol="counts", outputCol="features").transform(counts)
    model = LogisticRegression(regParam=ridge, maxIter=25, standardization=False).fit(shares)
    return [float(w) for w in model.coefficients.toArray()], float(model.intercept)


def probability(host_: Column, path_: Column, weights: list[float], intercept: float, sizes=SIZES) -> Column:
    """Probability of label 1; of an empty host and path that of the intercept."""
    table = F.from_json(F.lit(str([round(w, 9) for w in weights])), "array<double>")  # folded to one constant
    total = F.aggregate(grams(host_, path_, sizes, len(weights)), F.lit(0.0), lambda acc, b: acc + F.get(table, b))
    number = sum((F.greatest(F.length(text) + 2 - n, F.lit(0)) for text in (host_, path_) for n in sizes), F.lit(0))
    return 1 / (1 + F.exp(-(F.lit(intercept) + total / F.greatest(number, F.lit(1)))))


def judge(df: DataFrame, labelled: DataFrame, rules=RULES, threshold: float = 0.5, url_column: str = "url") -> DataFrame:
    """``df`` with host, path, rule, verdict, score: a rule's verdict, else ``block`` from ``threshold`` on.

    No row moves: the work is one projection, so no host can be hot. Columns of these names are replaced. A url that is null
    or empty or has no ``://`` has an empty host and path, which no rule fits.
    """
    weights, intercept = train(labelled)
    names = [c for c in df.columns if c not in ("host", "path", "rule", "verdict", "score")]
    url = F.coalesce(F.col(url_column), F.lit(""))
    parsed = df.select(*names, host(url).alias("host"), path(url).alias("path"))
    scored = parsed.select("*", rule(F.col("host"), F.col("path"), rules).alias("_rule"), probability(F.col("host"), F.col("path"), weights, intercept).alias("score"))
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return scored.select(*names, "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "score")


def own_labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(u, 1) for u in BLOCKED] + [(u, 0) for u in ALLOWED], "url string, label int")
