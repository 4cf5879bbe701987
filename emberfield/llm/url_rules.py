"""URL filters: fixed host rules first, then association rules mined with FP-growth.

Method. A URL becomes a set of tokens (scheme, host labels, path words, ending, query keys, fragment).
Spark's FP-growth mines the tokens of labelled URLs together with a mark for
bad ones; rules that lead to the mark and pass support and confidence are kept. An inverted index
from token to rule finds the rules whose tokens a URL has in full. Equal token sets
are judged once. Only DataFrame functions and Spark ML are used.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

#: Least share of labelled URLs that have all tokens of a rule and are bad, and their least number.
MIN_SUPPORT = 0.005
MIN_COUNT = 20
#: Least share of bad ones among the labelled URLs with the tokens.
MIN_CONFIDENCE = 0.6
BAD = "=bad"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for text without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def fixed_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest of ``(verdict, "host/path")`` rules that fits, and its verdict; nulls if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        at, below = rule.split("/", 1)
        fits = ((host == at) | F.endswith(host, F.lit(f".{at}"))) & F.startswith(path, F.lit(f"/{below}"))
        name = F.when(fits, F.lit(rule)).otherwise(name)
        verdict = F.when(fits, F.lit(action)).otherwise(verdict)
    return name, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a URL in order; numbers in paths are no tokens. Empty if there is no host."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    made = F.concat(
        F.array(F.concat(F.lit("scheme "), F.lower(F.substring_index(url, "://", 1)))),
        F.transform(F.filter(F.split(host, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("host "), x)),
        F.transform(
            F.filter(F.split(path, r"[/._-]"), lambda x: (x != "") & ~x.rlike(r"^\d+$")), lambda x: F.concat(F.lit("path "), x)
        ),
        F.when(F.endswith(path, F.lit("/")), F.array(F.lit("end /"))).otherwise(F.array().cast("array<string>")),
        F.transform(
            F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("key "), F.substring_index(x, "=", 1))
        ),
        F.when(F.instr(url, "#") > 0, F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>")),
    )
    return F.when(F.coalesce(host, F.lit("")) != "", F.array_sort(F.array_distinct(made))).otherwise(
        F.array().cast("array<string>")
    )


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_count: int = MIN_COUNT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame | None:
    """Rules ``rule_id, tokens, confidence`` from ``tokens`` (array) and ``bad`` (boolean) of labelled URLs.

    None if there are fewer labelled URLs than ``min_count``. Rows with null or no tokens or null labels are left out.
    """
    items = labelled.where("bad is not null and size(tokens) > 0").select(
        F.when(F.col("bad"), F.concat("tokens", F.array(F.lit(BAD)))).otherwise(F.col("tokens")).alias("items")
    )
    total = items.count()
    if total < min_count:
        return None
    # Half a row less, so that rounding cannot ask for one row more.
    least = max(min_count, -(-int(total * min_support * 1_000_000) // 1_000_000))
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / total, minConfidence=min_confidence).fit(items)
    return model.associationRules.where(F.col("consequent") == F.array(F.lit(BAD))).select(
        F.md5(F.to_json(F.array_sort("antecedent"))).alias("rule_id"), F.array_sort("antecedent").alias("tokens"), "confidence"
    )


def matched(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct token sets that hold all tokens of a rule, with the highest confidence."""
    index = rules.select("rule_id", "confidence", F.size("tokens").alias("needed"), F.explode("tokens").alias("token"))
    key = F.md5(F.to_json("tokens"))
    some = sets.where(F.size("tokens") > 0).select("tokens").distinct()
    held = some.select(key.alias("set_id"), F.explode("tokens").alias("token"))
    return (
        held.join(index, "token")
        .groupBy("set_id", "rule_id")
        .agg(F.count(F.lit(1)).alias("found"), F.first("needed").alias("needed"), F.first("confidence").alias("confidence"))
        .where("found = needed")
        .groupBy("set_id")
        .agg(F.max("confidence").alias("confidence"))
    )


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]], **settings) -> DataFrame:
    """``page_id, host, path, rule, verdict, confidence`` for every row of ``pages``.

    A labelled URL ends in the doc_id that ``labels`` (``doc_id, quality, toxic``) knows; it is bad if any
    of its labels has quality 0 or toxic 1. Verdict: that of the longest fixed rule that fits, else ``block`` if a mined rule
    matches, else ``allow``. Null urls have empty host and path. Repeated rows are judged alike and
    all returned; other columns are ignored.
    """
    url = F.col("url")
    host, path = split_url(url)
    name, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    known = (
        pages.select("page_id", "url", host.alias("host"), path.alias("path"))
        .withColumn("tokens", tokens(url, F.col("host"), F.col("path")))
        .withColumns({"rule": name, "fixed": verdict})
    )
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max((F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)).alias("bad")
    )
    number = F.regexp_extract("path", r"(\d+)\D*$", 1)
    numbered = known.select("tokens", number.try_cast("long").alias("doc_id"))
    mined = mine(numbered.join(marks, "doc_id"), **settings)
    if mined is None:
        judged = known.withColumn("confidence", F.lit(None).cast("double"))
    else:
        judged = known.withColumn("set_id", F.md5(F.to_json("tokens"))).join(matched(known, mined), "set_id", "left")
    found = F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("fixed", found).alias("verdict"), "confidence")
