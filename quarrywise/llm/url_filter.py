"""URL filters: given host and path rules, and association rules that Spark's FP-growth mines from labels.

DataFrame functions only. Mined rules say which combinations of URL tokens go with a label to
block; they are pruned by support and confidence and matched through an inverted index.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Share and least number of the pages to block that a combination needs, and share of the pages that have it that must be to block.
SUPPORT, LEAST, CONFIDENCE = 0.01, 5, 0.8
#: Up to so many mined rules the index is broadcast; beyond it, it is joined by a shuffle.
BROADCAST_RULES = 20_000

@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, query); the host is what follows the first :// up to / ? # or the end, with A-Z lower-cased. No :// : all empty."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    tail = F.substr(rest, F.length(host) + 1)
    path = F.regexp_extract(tail, r"^[^?#]*", 0)
    query = F.regexp_extract(tail, r"^[^?#]*\?([^#]*)", 1)
    return F.translate(host, UPPER, LOWER), path, query


def longest_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """struct<rule,verdict> of the longest rule that fits host or a domain above it and begins the path; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.name)):  # the longest is asked first
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(host: Column, path: Column, query: Column) -> Column:
    """Distinct tokens of a URL: the domain (the last two labels of the host), each label before it, each part of the path, each name in the query. No token implies another, so that itemsets are few."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    domain = F.array(F.concat(F.lit("domain="), F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2)), ".")))
    before = F.transform(F.slice(labels, F.lit(1), F.greatest(F.size(labels) - 2, F.lit(0))), lambda x: F.concat(F.lit("sub="), x))
    segments = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("path="), x))
    names = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("query="), F.substring_index(x, "=", 1)))
    return F.array_distinct(F.concat(domain, before, segments, names))


def holding(pages: DataFrame, itemsets: DataFrame) -> DataFrame:
    """(page_id, rule_id): the itemsets (rule_id, need) whose tokens a page has, by an inverted index from tokens to the itemsets that need them."""
    index = itemsets.select(F.explode("need").alias("token"), "rule_id", F.size("need").alias("n"))
    if itemsets.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        index = F.broadcast(index)
    hits = pages.select("page_id", F.explode("tokens").alias("token")).join(index, "token")
    return hits.groupBy("page_id", "rule_id", "n").agg(F.count("*").alias("got")).where("got = n").select("page_id", "rule_id")


def mined_rules(pages: DataFrame, labels: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, least: int = LEAST) -> DataFrame:
    """(rule_id, need array<string>, hits, confidence): combinations of tokens after which a page is to block. labels: page_id, block boolean.

    FP-growth reads the pages to block alone: a combination needs the share `support` of them, and `least`
    of them, so that what is sure but rare among all pages isn't lost. Its confidence, counted over all
    labelled pages, must reach `confidence` and exceed the share of pages to block.
    """
    known = materialize(pages.join(labels.where("page_id IS NOT NULL AND block IS NOT NULL").groupBy("page_id").agg(F.max("block").alias("block")), "page_id").select("page_id", "tokens", "block"))
    n, bad = known.agg(F.count("*"), F.coalesce(F.sum(F.col("block").cast("long")), F.lit(0))).first()
    enough = max(least, support * bad)
    frequent = FPGrowth(itemsCol="tokens", minSupport=min(1.0, enough / max(1, bad))).fit(known.where("block").select("tokens")).freqItemsets
    sets = materialize(frequent.where(F.col("freq") >= enough).select(F.xxhash64(F.array_sort("items")).alias("rule_id"), F.col("items").alias("need"), F.col("freq").alias("hits")))
    seen = holding(known, sets).groupBy("rule_id").agg(F.count("*").alias("seen"))
    sure = F.col("hits") / F.col("seen")
    return sets.join(seen, "rule_id").select("rule_id", "need", "hits", sure.alias("confidence")).where((F.col("confidence") >= confidence) & (F.col("confidence") > bad / max(1, n)))


def matched(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, confidence) of the surest mined rule that holds for a page."""
    return holding(pages, rules).join(rules.select("rule_id", "confidence"), "rule_id").groupBy("page_id").agg(F.max("confidence").alias("confidence"))


def rule_labels(pages: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(page_id, block): the verdicts of given rules on the pages that they fit, as labels to mine from."""
    host, path, _ = url_parts(F.col("url"))
    given = longest_rule(host, path, rules)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), (given["verdict"] == "block").alias("block")).where("block IS NOT NULL")


def judge_urls(pages: DataFrame, labels: DataFrame, rules: tuple[Rule, ...] = RULES, support: float = SUPPORT, confidence: float = CONFIDENCE, least: int = LEAST) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, confidence.

    The longest given rule that fits decides; else a mined rule that holds blocks; else allow. A null
    url, or one without ://, has an empty host and path and no token but the empty domain. Pages that
    repeat an id share what is mined for it. Labels without a page, null labels, and no labels at all
    mine nothing. Other columns of pages are left out.
    """
    host, path, query = url_parts(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"), tokens(host, path, query).alias("tokens"))
    own = rows.select("page_id", "tokens").dropDuplicates(["page_id"])
    found = matched(own, materialize(mined_rules(own, labels, support, confidence, least)))
    given = longest_rule(F.col("host"), F.col("path"), rules)
    out = rows.join(found, "page_id", "left").withColumn("given", given)
    return out.select("page_id", "host", "path", F.col("given.rule").alias("rule"), F.coalesce("given.verdict", F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")).alias("verdict"), "confidence")
