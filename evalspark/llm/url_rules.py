"""URL filtering: fixed rules first, mined association rules for the rest.

Host and path are cut from the url; a fixed rule fits its host and all subdomains when the path starts with the rule's,
and the longest wins. Urls that a fixed rule decides are the labels from which Spark's FP-growth mines combinations of url tokens
(host labels, path words, query keys) that go with a block. Rules are kept when confident and frequent enough and not
implied by a shorter kept rule; they match by an inverted index on their rarest token, and a match blocks the url.

Defined cases: a null url or one without ``://`` has empty host and path, fits no rule and is allowed; no labels or no
mined rule allow every other url; repeated rows are judged each. Driver memory: one count, one list of fixed rules.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import LOWER, UPPER, stored

# Rules as (verdict, host, path).
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"))
SUPPORT = 0.005
LEAST_PAGES = 10
CONFIDENCE = 0.8
_BLOCK = "verdict=block"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.locate("://", url) > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1)
    return host, path


def fixed_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest fitting rule, else null."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in ordered]
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for ok, (v, h, p) in reversed(list(zip(fits, ordered))):
        name, verdict = F.when(ok, F.lit(h + p)).otherwise(name), F.when(ok, F.lit(v)).otherwise(verdict)
    return name, verdict


def tokens(host: Column, path: Column) -> Column:
    """Distinct tokens of a url: labels of the host, the words of hyphenated labels, non-numeric words of the path."""
    labels = F.transform(F.filter(F.split(host, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("host="), x))
    inner = F.transform(F.filter(F.flatten(F.transform(F.filter(F.split(host, r"\."), lambda x: x.contains("-")), lambda x: F.split(x, "-"))), lambda x: x != ""), lambda x: F.concat(F.lit("word="), x))
    steps = F.transform(F.filter(F.split(F.lower(path), r"[/.\-_]"), lambda x: (x != "") & ~x.rlike(r"^\d+$")), lambda x: F.concat(F.lit("path="), x))
    return F.array_distinct(F.concat(labels, inner, steps))


def mined_rules(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(rule, items, key, confidence): token combinations that go with a block; key is the rarest token.

    ``labelled`` has items and verdict. A combination needs ``support`` of the labelled pages and ``LEAST_PAGES`` of
    them, below which its confidence says nothing. A rule goes when a subset of its tokens is a rule of the same or more confidence.
    """
    baskets = labelled.select(F.when(F.col("verdict") == "block", F.array_append("items", F.lit(_BLOCK))).otherwise(F.col("items")).alias("items"))
    least = min(1.0, max(support, LEAST_PAGES / max(1, labelled.count())))
    model = FPGrowth(itemsCol="items", minSupport=least, minConfidence=confidence).fit(baskets)
    found = model.associationRules.filter(F.array_contains("consequent", _BLOCK)).select(F.array_sort("antecedent").alias("tokens"), "confidence")
    found = stored(found, "url-rules-all").withColumn("rule", F.concat_ws(" ", "tokens"))
    # Shorter rules inside a rule share its tokens: join on each token, count, compare.
    one = found.select("rule", "confidence", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    inside = (one.alias("s").join(one.alias("l"), (F.col("s.token") == F.col("l.token")) & (F.col("s.n") < F.col("l.n")) & (F.col("s.confidence") >= F.col("l.confidence")))
              .groupBy(F.col("l.rule").alias("rule"), F.col("s.rule").alias("short"), F.col("s.n").alias("n")).agg(F.count(F.lit(1)).alias("shared"))
              .filter("shared = n").select("rule").distinct())
    kept = found.join(inside, "rule", "left_anti")
    frequency = labelled.select(F.explode("items").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("f"))
    rarest = (kept.select("rule", F.explode("tokens").alias("token")).join(frequency, "token")
              .groupBy("rule").agg(F.min(F.struct("f", "token")).alias("m")))
    return kept.join(rarest, "rule").select("rule", F.col("tokens").alias("items"), F.col("m.token").alias("key"), "confidence")


def judge(pages: DataFrame, rules=RULES, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, mined (the deciding mined rule, else null)."""
    host, path = host_and_path(F.col("url"))
    parsed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url").select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    parsed = stored(parsed.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("fixed"), tokens(F.col("host"), F.col("path")).alias("items")), "url-parsed")
    decided, open_urls = parsed.filter("rule is not null"), parsed.filter("rule is null")
    labelled = decided.select("items", F.col("fixed").alias("verdict"))
    if labelled.filter("verdict = 'block'").limit(1).count() == 0:
        hits = None
    else:
        index = stored(mined_rules(labelled, support, confidence), "url-rules")
        # Equal token sets (same host and path words) are looked up once.
        baskets = open_urls.select("items").distinct()
        hits = (baskets.select("items", F.explode("items").alias("key")).join(index.select("key", "rule", F.col("items").alias("need")), "key")
                .filter(F.size(F.array_except("need", "items")) == 0)
                .groupBy("items").agg(F.min("rule").alias("mined")))
    out = ["page_id", "host", "path", "rule"]
    first = decided.select(*out, F.col("fixed").alias("verdict"), F.lit(None).cast("string").alias("mined"))
    if hits is None:
        rest = open_urls.select(*out, F.lit("allow").alias("verdict"), F.lit(None).cast("string").alias("mined"))
    else:
        rest = open_urls.join(hits, "items", "left").select(*out, F.when(F.col("mined").isNotNull(), "block").otherwise("allow").alias("verdict"), "mined")
    return first.unionByName(rest)
