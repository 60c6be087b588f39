"""URL filter by association rules, in DataFrame operations and Spark's own FP-growth only.

A short list of (host, path, verdict) rules comes first: a rule fits its host and all subdomains where the url's path
starts with the rule's path, and the longest fitting rule wins. Their verdicts are the labels: over urls that a rule fits, FP-growth mines
combinations of URL tokens (parts of the host, top-level domain, parts of the path, names of query arguments) that imply
a verdict; combinations under min_support or min_confidence go, and so do those that a shorter one with as much
confidence implies. The rest are matched by an inverted index: each rule is posted under its rarest token, the tokens of
the urls without a listed rule look the postings up, and a rule fires where the url has all its tokens. The firing rule
of the highest confidence, then support, decides; where none fires, `otherwise`.

Mining learns from about sample_urls distinct labelled urls (by hash) and all their tokens: tokens under the support go first, and of tokens that stand in
just the same urls the first stands for all, so that a long part that many urls share is one item. A url has what one of its tokens stands under, so a rule
fits whichever of the tokens that its own stand for a url has, in any number of places at once. Matching covers all urls and all tokens.

Defined results: a null url, or one without ://, has an empty host and path, fits no rule and gets `otherwise`;
repeated rows each get a row; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .common import ascii_lower, bounded_sample, table

RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def listed_rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest fitting rule as host + path, and its verdict; null where none fits."""
    rule = verdict = None
    for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return rule, verdict


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a url."""
    labels = F.array_remove(F.split(host, r"\."), "")
    names = F.regexp_extract_all(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\?([^#]*)", 1), F.lit(r"([^&=]+)=?[^&]*"), 1)
    tagged = lambda tag, words: F.transform(words, lambda w: F.concat(F.lit(tag), w))
    return F.array_distinct(
        F.concat(
            tagged("top:", F.slice(F.reverse(labels), 1, 1)),
            tagged("host:", labels),
            tagged("path:", F.array_remove(F.split(path, "/"), "")),
            tagged("arg:", names),
        )
    )


def posted(rules: DataFrame, often: DataFrame) -> DataFrame:
    """rules with `token`: of their tokens the one that is least often by often (token, count)."""
    rows = rules.withColumn("token", F.explode("tokens")).join(often, "token")
    return rows.groupBy(*rules.columns).agg(F.min(F.struct("count", "token")).alias("rarest")).select(*rules.columns, "rarest.token")


def mine(labelled: DataFrame, min_support: float, min_confidence: float, sample_urls: int) -> tuple[DataFrame, DataFrame]:
    """Rules (tokens, verdict, confidence, support) from labelled (url, tokens, verdict), and (token, stand) of all tokens that a rule's tokens stand for, themselves included."""
    marks = F.concat(F.lit("verdict:"), "verdict")
    sampled = written(bounded_sample(labelled, sample_urls), "sampled")
    least = min_support * sampled.count()
    tokens = sampled.select("url", F.explode("tokens").alias("token"))
    # Tokens of the same urls: as many, and with equal sums of two hashes of these.
    seen = tokens.groupBy("token").agg(F.count("*").alias("n"), *(F.sum(F.shiftright(F.xxhash64("url", F.lit(k)), 24)).alias(f"of{k}") for k in (1, 2))).where(F.col("n") >= least)
    stands = written(seen.join(seen.groupBy("n", "of1", "of2").agg(F.min("token").alias("stand")), ["n", "of1", "of2"]).select("token", "stand"), "stands")
    items = tokens.join(stands.where("token = stand"), "token").groupBy("url").agg(F.collect_set("token").alias("items"))
    sample = sampled.join(items, "url", "left").select(F.array_append(F.coalesce("items", F.array().cast("array<string>")), marks).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(sample)
    found = model.associationRules.where(F.startswith(F.col("consequent")[0], F.lit("verdict:")) & ~F.exists("antecedent", lambda t: F.startswith(t, F.lit("verdict:"))))
    rules = written(
        found.select(F.array_sort("antecedent").alias("tokens"), F.expr("substring(consequent[0], 9)").alias("verdict"), F.round("confidence", 9).alias("confidence"), F.round("support", 9).alias("support")), "rules"
    )
    # Implied by a rule of fewer tokens: that is posted under the one of its tokens that the fewest rules have, and looked up through each rule's own.
    often = rules.select(F.explode("tokens").alias("token")).groupBy("token").count()
    shorter = posted(rules.drop("support"), often).select("token", F.col("tokens").alias("less"), F.col("verdict").alias("same"), F.col("confidence").alias("sure"))
    implied = (
        rules.select("tokens", "verdict", "confidence", F.explode("tokens").alias("token"))
        .join(shorter, "token")
        .where((F.size("less") < F.size("tokens")) & (F.col("same") == F.col("verdict")) & (F.col("sure") >= F.col("confidence")) & (F.size(F.array_except("less", "tokens")) == 0))
        .select("tokens", "verdict")
        .distinct()
    )
    left = written(rules.join(implied, ["tokens", "verdict"], "left_anti").select("tokens", "verdict", "confidence", "support"), "mined")
    return left, stands.join(left.select(F.explode("tokens").alias("stand")).distinct(), "stand", "left_semi").select("token", "stand")


def judge(
    pages: DataFrame,
    rules=RULES,
    min_support: float = 0.002,
    min_confidence: float = 0.8,
    sample_urls: int = 100_000,
    otherwise: str = "allow",
) -> DataFrame:
    """page_id, url, host, path, rule, verdict, mined (the tokens of the url that the mined rule that decided fits by, one a class) for each row of pages."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    parsed = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = listed_rule(F.col("host"), F.col("path"), rules)
    parsed = parsed.withColumn("rule", rule).withColumn("listed", verdict)
    # One row a distinct url: how many pages have it changes nothing below.
    urls = written(parsed.where("url is not null").groupBy("url").agg(*(F.first(c).alias(c) for c in ("host", "path", "listed"))).withColumn("tokens", tokens_of(F.col("url"), F.col("host"), F.col("path"))), "urls")
    labelled = urls.where("listed is not null").select("url", "tokens", F.col("listed").alias("verdict"))
    if labelled.isEmpty():
        return parsed.select("page_id", "url", "host", "path", "rule", F.coalesce("listed", F.lit(otherwise)).alias("verdict"), F.lit(None).cast("string").alias("mined"))
    mined, stands = mine(labelled, min_support, min_confidence, sample_urls)
    # What a url's tokens stand under: it fits a rule that has one of the tokens of each of the rule's.
    held = urls.select("url", "listed", F.explode("tokens").alias("token")).join(stands, "token").groupBy("url", "listed").agg(F.collect_set(F.struct("stand", "token")).alias("has"))
    held = held.withColumn("stands", F.array_distinct("has.stand"))
    held = written(held, "held")
    seen = held.where("listed is not null").select(F.explode("stands").alias("token")).groupBy("token").count()
    index = posted(mined, seen).select("token", F.col("tokens").alias("needs"), F.array_join("tokens", " ").alias("rule_text"), F.col("verdict").alias("says"), "confidence", "support")
    fired = (
        held.where("listed is null").select("url", "has", "stands", F.explode("stands").alias("token"))
        .join(index, "token")
        .where(F.size(F.array_except("needs", "stands")) == 0)
        .groupBy("url")
        .agg(F.max(F.struct("confidence", "support", "rule_text", "says", "needs", "has")).alias("best"))
    )
    own = lambda n: F.array_min(F.transform(F.filter("best.has", lambda h: h["stand"] == n), lambda h: h["token"]))
    return parsed.join(fired, "url", "left").select(
        "page_id", "url", "host", "path", "rule",
        F.coalesce("listed", "best.says", F.lit(otherwise)).alias("verdict"),
        F.when(F.col("listed").isNull(), F.array_join(F.array_sort(F.transform("best.needs", own)), " ")).alias("mined"),
    )


def op1_url_filter(spark, sf_dir) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "mined")
