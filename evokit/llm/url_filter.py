"""Operator 2: URL filters, DataFrame operations only.

A logistic regression on hashed character n-grams of host and path, fitted once to a small labelled
URL table, judges the URLs that no rule fits. The table is made of families of words (``BLOCK_FAMILIES``, ``ALLOW_FAMILIES``), so
what the model makes of a family it has not seen can be measured. Rules (host suffix, path prefix) come before the model,
the longest one first. Everything per row is a built-in expression or a JVM model; nothing is shuffled.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no rule and is
judged by the model's intercept; empty and very long URLs are judged whole; repeated rows give equal
rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (verdict, host, path): a rule fits its host and all subdomains when the path starts with its own.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
BUCKETS = 1 << 14
#: The share of sites to block among all: the labelled table has as many of either kind, so rows are weighted to it.
BLOCK_SHARE = 0.1

#: The labelled table: words that hosts of sites to block and to allow are made of, by family; each host is one or two words of a family.
BLOCK_FAMILIES: dict[str, str] = {
    "gambling": "casino poker roulette blackjack slots betting bets bookmaker jackpot lottery bingo gambling wager spins odds stakes",
    "medicine": "pills viagra cialis pharmacy meds tablets tramadol steroids slimming diet botox doses generics erectile",
    "adult": "porn xxx sexy escort cams nude erotic hookup fetish milf strip adult lust naughty",
    "loans": "payday loans cash credit debt quickloan lender mortgage refinance bitcoin crypto forex profit earn invest",
    "copies": "replica fake knockoff counterfeit cheap discount outlet watches handbags sneakers bargain wholesale",
    "piracy": "warez crack keygen torrent nulled serial pirated rips leaked streamfree freedownload cracked patch",
    "prizes": "free prize winner giveaway gift voucher reward claim lucky iphone win freebies bonus",
    "adverts": "adserver banner popup clicks tracker tracking pixel affiliate doorway traffic backlinks linkfarm spam seo redirect",
}
ALLOW_FAMILIES: dict[str, str] = {
    "news": "herald times gazette chronicle tribune courier journal observer daily post reporter bulletin review weekly tagblatt zeitung journal lemonde noticias diario",
    "learning": "university college school academy faculty institute campus library archive lectures thesis students schule ecole escuela biblioteca universidad",
    "public": "council city county parliament ministry police court museum embassy customs census heritage mairie rathaus gobierno ayuntamiento",
    "health": "hospital clinic nursing dental surgery childrens hospice medicine cardiology doctors",
    "nature": "garden forest river mountain weather climate birds ocean orchard meadow wildlife geology farm harbour",
    "culture": "theatre orchestra gallery cinema poetry literature history dance opera folklore choir cathedral",
    "science": "physics chemistry biology astronomy mathematics statistics engineering robotics telescope laboratory theory",
    "living": "kitchen recipes bakery knitting cycling hiking sailing football railway airport travel camping carpentry bookshop",
}
ENDINGS = ("", "-online", "-world", "24", "-site")


def hosts(families: dict[str, str], only: str | None = None, without: str | None = None) -> list[str]:
    """Hosts of all families, or of one, or of all but one: every word with an ending, and neighbouring words of a family joined."""
    out = []
    for name, words in families.items():
        if (only is None or name == only) and name != without:
            w = words.split()
            out += [f"{x}{ENDINGS[i % len(ENDINGS)]}.test" for i, x in enumerate(w)]
            out += [f"{x}{'-' if i % 2 else ''}{w[(i + 3) % len(w)]}.test" for i, x in enumerate(w)]
    return out


HOST_PREFIXES = ("", "www.", "m.", "blog.")
PATHS = ("/en/{}", "/de/{}/", "/fr/{}.html", "/es/{}")


def labelled_rows(only: str | None = None, without: tuple[str | None, str | None] = (None, None)) -> list[tuple[str, float]]:
    """(url, label) of the small training table, or of one family, or of all but one to block and one to allow; label 1 is to be blocked."""
    rows = []
    for label, families, left_out in ((1.0, BLOCK_FAMILIES, without[0]), (0.0, ALLOW_FAMILIES, without[1])):
        for i, host in enumerate(hosts(families, only, left_out)):
            for k, (prefix, path) in enumerate(zip(HOST_PREFIXES, PATHS, strict=True)):
                rows.append((f"https://{prefix}{host}{path.format((i * 37 + k * 411) % 999)}", label))
    return rows


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, label) of the small training table."""
    return spark.createDataFrame(labelled_rows(), "url string, label double").coalesce(1)


def with_parts(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds ``host`` (A-Z lower-cased) and ``path``; columns of these names are replaced."""
    at = F.instr(F.col(url_col), "://")
    rest = F.when(at > 0, F.substr(F.col(url_col), at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return urls.withColumns({"host": F.translate(host, upper, lower), "path": path})


def _grams(chars: str, mark: str, n: int) -> Column:
    """N-grams of an array of characters, which must be a column: each is put together from its characters, in time linear in the text."""
    c, size = F.col(chars), F.size(chars)
    gram = lambda i: F.concat(F.lit(mark), *(F.get(c, i + j) for j in range(n)))
    return F.when(size >= n, F.transform(F.sequence(F.lit(0), size - n), gram)).otherwise(F.array().cast("array<string>"))


def with_features(parts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Adds ``features``: hashed character n-grams, of 3 to 5 in the host and of 3 in the path, marked by where they are; an empty part has none."""
    chars = lambda name: F.when(F.length(name) > 0, F.regexp_extract_all(F.concat(F.lit("^"), F.col(name), F.lit("$")), F.lit("(?s)."), F.lit(0)))
    split = parts.withColumns({"chars_h": chars("host"), "chars_p": chars("path")})
    grams = F.concat(*(_grams("chars_h", "h", n) for n in (3, 4, 5)), _grams("chars_p", "p", 3))
    return HashingTF(inputCol="grams", outputCol="features", numFeatures=buckets, binary=True).transform(split.withColumn("grams", grams).drop("chars_h", "chars_p"))


def fit(labelled: DataFrame, buckets: int = BUCKETS) -> LogisticRegressionModel:
    """The model of a labelled (url, label) table; rows without a URL or label are left out."""
    rows = with_features(with_parts(labelled.where("url is not null and label is not null")), buckets)
    rows = rows.select("features", "label", F.when(F.col("label") == 1, BLOCK_SHARE).otherwise(1 - BLOCK_SHARE).alias("weight")).persist()
    model = LogisticRegression(maxIter=40, regParam=0.001, standardization=False, weightCol="weight").fit(rows)
    rows.unpersist()
    return model


def judge(urls: DataFrame, model: LogisticRegressionModel, rules: list[tuple[str, str, str]] = RULES, threshold: float = 0.5, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, score): the longest rule that fits, else the model, decides."""
    rows = with_parts(urls.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")))
    rule = verdict = None
    for what, host, path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule = rule.when(fits, host + path) if rule is not None else F.when(fits, host + path)
        verdict = verdict.when(fits, what) if verdict is not None else F.when(fits, what)
    if rule is None:
        rule = verdict = F.lit(None).cast("string")
    scored = model.transform(with_features(rows, model.numFeatures)).withColumn("score", vector_to_array("probability")[1])
    own = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return scored.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "score")
