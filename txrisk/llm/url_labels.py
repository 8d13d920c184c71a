"""A small labelled url table to train the url filter on.

Made-up sites whose names say what they are about, under every top-level domain with both verdicts. No label comes from
a filter rule, and none of the sites is one of the pages to be judged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What a site's name is made of.
BLOCKED = ["casino", "poker", "betting", "pills", "loans", "xxx", "warez", "torrent", "ads", "track", "spam", "click", "popup", "phish", "malware", "replica"]
ALLOWED = ["news", "blog", "docs", "wiki", "library", "school", "museum", "journal", "research", "weather", "science", "recipes", "travel", "books", "forum", "support"]
#: Names that say nothing; such sites are allowed.
PLAIN = ["theatre", "northern", "leather", "winter", "thing", "station", "garden", "river", "together", "whisper", "another", "tender", "inland", "eating", "thorn", "wheat"]
DOMAINS = ["com", "net", "org", "info", "io", "edu"]
SITES = ["site", "harbor", "maple", "quartz"]
LANGUAGES = ["en", "fr", "de", "es"]


def labelled_urls(spark: SparkSession) -> DataFrame:
    """url, verdict: each word with each domain, site and manner of writing, in all languages in turn."""
    named = [(w, "block") for w in BLOCKED] + [(w, "allow") for w in ALLOWED + PLAIN]
    words = spark.createDataFrame(named, "word string, verdict string")
    spread = words.withColumn("domain", F.explode(F.lit(DOMAINS))).withColumn("site", F.explode(F.lit(SITES)))
    number = F.crc32(F.concat("word", "domain", "site").cast("binary"))
    spread = spread.withColumn("n", number % 1000)
    language = F.element_at(F.lit(LANGUAGES), (F.col("n") % len(LANGUAGES) + 1).cast("int"))
    blocked = [
        F.concat(F.lit("http://"), "word", F.lit("-"), "site", F.lit("."), "domain", F.lit("/"), language, F.lit("/"), "n"),
        F.concat(F.lit("https://"), "word", F.lit("."), "site", F.lit("."), "domain", F.lit("/"), language, F.lit("/"), "n", F.lit(".html")),
        F.concat(F.lit("http://www."), "site", "word", F.lit("."), "domain", F.lit("/"), "word", F.lit("/"), "n", F.lit("?ref="), "site"),
    ]
    allowed = [
        F.concat(F.lit("https://www."), "site", "word", F.lit("."), "domain", F.lit("/"), language, F.lit("/"), "n", F.lit("/")),
        F.concat(F.lit("https://"), "word", F.lit("."), "site", F.lit("."), "domain", F.lit("/"), language, F.lit("/"), "n", F.lit(".html")),
        F.concat(F.lit("http://m."), "site", F.lit("."), "domain", F.lit("/"), language, F.lit("/"), "n", F.lit("?page=2")),
    ]
    urls = F.when(F.col("verdict") == "block", F.array(*blocked)).otherwise(F.array(*allowed))
    return spread.select(F.explode(urls).alias("url"), "verdict").distinct()
