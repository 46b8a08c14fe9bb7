"""URL filter: rules on host and path, and a logistic regression on hashed character
n-grams of host and path where no rule fits."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (verdict, host, path)
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
BUCKETS = 4096
GRAM_SIZES = (3, 4)
#: The labelled hosts of the table that the model is trained from, by default: 1 is
#: block. Each stands in the table with every prefix and path, which tell nothing.
PREFIXES = ("", "www.", "m.", "blog.")
PATHS = ("/en/3021", "/de/8080.html", "/fr/14/", "/es/411")
LABELLED = """
1 casino-bonus.example.com
1 win-big-casino.example.org
1 casino-night.example.net
1 casino-club.example.com
1 freeslots.example.com
1 poker-bets.example.org
1 bets-online.example.com
1 sport-bets.example.net
1 win-prize.example.com
1 adult-cams.example.com
1 adult-videos.example.org
1 adult-chat.example.net
1 xxx-tube.example.com
1 cheap-viagra.example.com
1 cheap-watches.example.org
1 buy-pills.example.net
1 diet-pills.example.com
1 pills-store.example.org
1 torrent-warez.example.com
1 cracked-software.example.net
1 secure-login-verify.example.com
1 bank-update-login.example.org
1 spam-links.example.com
1 spam-blog.example.org
1 track-ads.example.com
1 spam-mails.example.net
1 bonus-slots.example.org
1 pharmacy-pills.example.com
1 now-betting.example.net
1 club-xxx.example.com
1 link-farm.example.org
1 content-farm.example.com
1 click-farm.example.net
1 ads-server.example.com
1 ads-popup.example.org
1 click-track.example.com
1 pixel-track.example.net
1 payday-loans.example.com
1 crypto-doubler.example.org
1 free-bitcoin.example.com
1 weight-loss-miracle.example.com
0 university.example.org
0 library.university.example.org
0 docs.python.example.org
0 en.encyclopedia.example.org
0 de.encyclopedia.example.org
0 fr.encyclopedia.example.org
0 news.daily.example.com
0 writer.example.com
0 cooking.example.net
0 magazine.example.com
0 museum.example.org
0 city.example.net
0 research.institute.example.org
0 forum.linux.example.org
0 wiki.software.example.com
0 weather.example.com
0 school.example.net
0 journal.medicine.example.org
0 government.example.org
0 garden.example.com
0 travel.example.net
0 books.reader.example.org
0 other.example.com
0 theory.example.net
0 therein.example.com
0 station.example.net
0 nation.example.com
0 mention.example.org
0 table.example.net
0 thousand.example.com
0 through.example.org
0 thesis.example.com
0 north.example.org
0 thistle.example.com
0 bother.example.net
0 height.example.com
0 anthem.example.org
0 thank.example.com
0 thousands.example.org
0 then.example.com
0 that.example.org
0 what.example.com
0 these.example.org
0 wander.example.com
0 wednesday.example.org
0 threnody.example.com
0 thorn.example.net
0 tiger.example.com
0 stone.example.org
0 gathering.example.com
0 action.example.net
0 bakery.example.org
"""


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, letters, letters.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _buckets(host: Column, path: Column, sizes: tuple[int, ...], buckets: int) -> Column:
    """The bucket of every character n-gram; host and path stand in one line with
    marks at the ends, and a number counts as one character."""
    line = F.regexp_replace(
        F.concat(F.lit("^"), host, F.lit(" "), path, F.lit("$")), "[0-9]+", "0"
    )
    grams = [
        F.when(
            F.length(line) >= k,
            F.transform(
                F.sequence(F.lit(1), F.length(line) - k + 1),
                lambda i, k=k: F.pmod(F.xxhash64(line.substr(i, F.lit(k))), F.lit(buckets)).cast("int"),
            ),
        ).otherwise(F.array().cast("array<int>"))
        for k in sizes
    ]
    return F.concat(*grams)


def labelled_urls(spark: SparkSession, lines: str = LABELLED) -> DataFrame:
    rows = []
    for line in lines.split("\n"):
        if line:
            label, host = line.split(" ")
            rows += [(int(label), f"http://{x}{host}{y}") for x in PREFIXES for y in PATHS]
    return spark.createDataFrame(rows, "label int, url string")


def train(
    labelled: DataFrame, sizes: tuple[int, ...] = GRAM_SIZES, buckets: int = BUCKETS
) -> tuple[list[float], float]:
    """Weights of the buckets and the intercept, from `labelled` (url, label 1 for
    block). A feature is the number of a URL's n-grams that fall in the bucket. Rows
    without url or label are left out."""
    known = labelled.where(F.col("url").isNotNull() & F.col("label").isNotNull())
    terms = _buckets(host_of(F.col("url")), path_of(F.col("url")), sizes, buckets)
    counted = HashingTF(numFeatures=1 << 18, inputCol="terms", outputCol="features")
    rows = counted.transform(
        known.select(
            F.col("label").cast("double").alias("label"), terms.cast("array<string>").alias("terms")
        ).coalesce(1)
    )
    model = LogisticRegression(
        maxIter=60, regParam=0.001, elasticNetParam=0.0, standardization=False
    ).fit(rows)
    weights = model.coefficients.toArray()
    each = labelled.sparkSession.range(buckets).select(
        "id", F.array(F.col("id").cast("string")).alias("terms")
    )
    place = {r["id"]: int(r["features"].indices[0]) for r in counted.transform(each).collect()}
    return [float(weights[place[b]]) for b in range(buckets)], float(model.intercept)


def judge(
    pages: DataFrame,
    rules: tuple[tuple[str, str, str], ...] = RULES,
    labelled: DataFrame | None = None,
    threshold: float = 0.5,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every row of `pages`.

    A rule fits its host and all its subdomains where the path starts with the rule's;
    the longest wins, and its verdict stands. Else the model's: `block` where the
    probability reaches `threshold`. A null url, or one without `://`, has an empty host
    and path and gets the model's verdict on those. Repeated rows are judged each.
    """
    weights, intercept = train(labelled if labelled is not None else labelled_urls(pages.sparkSession))
    # One literal; the optimizer turns it into an array once.
    w = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")
    split = pages.select(
        F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"),
        path_of(F.col(url_col)).alias("path"),
    )
    by_length = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [
        ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        for _, h, p in by_length
    ]
    rule, ruled = F.lit(None).cast("string"), F.lit(None).cast("string")
    for fit, (verdict, host, path) in zip(reversed(fits), reversed(by_length), strict=True):
        rule = F.when(fit, F.lit(host + path)).otherwise(rule)
        ruled = F.when(fit, F.lit(verdict)).otherwise(ruled)
    scored = split.withColumn("b", _buckets(F.col("host"), F.col("path"), GRAM_SIZES, BUCKETS))
    total = F.aggregate("b", F.lit(0.0), lambda acc, i: acc + F.get(w, i))
    logit = F.lit(intercept) + total
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))
    learned = F.when(score >= threshold, "block").otherwise("allow")
    return scored.select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(ruled, learned).alias("verdict"), score.alias("score"),
    )
