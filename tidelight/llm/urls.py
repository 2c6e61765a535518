"""URL filters: given rules first, then association rules mined from labelled pages.

FP-growth finds token combinations of URLs that go with a label; rules are pruned by support and
confidence and matched through an inverted index from tokens to rules.

Defined cases: a URL that is null or has no ``://`` has empty host and path, fits no rule and has no
tokens; it gets the default verdict. Repeated pages are judged one by one. An empty table gives an empty
result, and without labelled pages no rule is mined.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: verdict and host + path prefix of the rules that are given.
GIVEN = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path, both without what follows ``?`` or ``#``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def given_rules(spark, rules: tuple[tuple[str, str], ...] = GIVEN) -> DataFrame:
    rows = [(v, r, r.partition("/")[0], "/" + r.partition("/")[2]) for v, r in rules]
    return spark.createDataFrame(rows, "rule_verdict string, rule string, rule_host string, rule_path string")


def apply_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path) -> rule, rule_verdict of the longest rule that fits; only places that a rule fits.

    A rule's host is met by equality of one of the host's own suffixes, so this is a hash join.
    """
    places = pages.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffix = F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), ".")))
    met = places.select("host", "path", suffix.alias("rule_host")).join(rules, "rule_host").filter(F.expr("startswith(path, rule_path)"))
    best = F.struct(F.length("rule").alias("n"), "rule", "rule_verdict")
    return met.groupBy("host", "path").agg(F.max(best).alias("best")).select("host", "path", "best.rule", "best.rule_verdict")


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a URL: scheme, top two host labels, further labels, path pieces without numbers, query keys."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    near = F.array(F.concat(F.lit("domain="), F.array_join(F.slice(labels, F.greatest(n - 1, F.lit(1)), F.lit(2)), ".")))
    sub = F.transform(F.slice(labels, F.lit(1), F.greatest(n - 2, F.lit(0))), lambda x: F.concat(F.lit("label="), x))
    pieces = F.filter(F.split(path, r"[/._-]+"), lambda x: (x != "") & ~x.rlike(r"^[0-9]+$"))
    keys = F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([A-Za-z_]+)="), 1)
    out = F.concat(
        near, sub, F.transform(pieces, lambda x: F.concat(F.lit("path="), x)), F.transform(keys, lambda x: F.concat(F.lit("key="), x)),
        F.when(F.instr(url, "#") > 0, F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>")),
    )
    return F.when(host != "", F.array_distinct(out)).otherwise(F.array().cast("array<string>"))


def mine(labelled: DataFrame, support: float, confidence: float, target: str = "bad") -> DataFrame:
    """rule_id, token, n_tokens, confidence: rules {tokens} -> target. ``labelled``: tokens array<string>, bad boolean.

    A rule that a rule with fewer of its tokens matches at no less confidence is left out.
    """
    empty = "rule_id long, token string, n_tokens int, confidence double"
    baskets = labelled.filter(F.size("tokens") > 0).select(F.when(F.col("bad"), F.array_append("tokens", F.lit(f"={target}"))).otherwise(F.col("tokens")).alias("items"))
    if baskets.isEmpty():
        return labelled.sparkSession.createDataFrame([], empty)
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    rules = model.associationRules.filter((F.element_at("consequent", 1) == f"={target}") & (F.size("consequent") == 1))
    rules = rules.select(F.array_sort("antecedent").alias("antecedent"), "confidence", F.xxhash64(F.array_sort("antecedent")).alias("rule_id"))
    # one token of every rule leads to the rules that hold it; only those are compared
    index = rules.select("rule_id", "antecedent", "confidence", F.explode("antecedent").alias("token"))
    short = index.select("token", F.col("rule_id").alias("r"), F.col("antecedent").alias("a"), F.col("confidence").alias("c"))
    wider = index.join(short, "token").filter((F.size("a") < F.size("antecedent")) & (F.col("c") >= F.col("confidence")) & (F.size(F.array_except("a", "antecedent")) == 0))
    kept = index.join(wider.select("rule_id").distinct(), "rule_id", "left_anti")
    return kept.select("rule_id", "token", F.size("antecedent").alias("n_tokens"), "confidence")


def matched(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """tokens_id -> confidence of the best mined rule all of whose tokens the page has."""
    seen = pages.select("tokens_id", F.explode("tokens").alias("token"))
    full = seen.join(rules, "token").groupBy("tokens_id", "rule_id").agg(F.count(F.lit(1)).alias("n"), F.first("n_tokens").alias("n_tokens"), F.first("confidence").alias("confidence"))
    return full.filter("n = n_tokens").groupBy("tokens_id").agg(F.max("confidence").alias("confidence"))


def judge(pages: DataFrame, labels: DataFrame, rules: DataFrame, support: float = 0.02, confidence: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, confidence of every page.

    ``labels``: doc_id, quality, toxic; the page with that number is bad if its quality is 0 or it is toxic.
    The verdict is the longest given rule's; else ``block`` if a mined rule fits, else ``allow``.
    """
    host, path = split_url(F.col("url"))
    parts = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    parts = parts.select("page_id", "host", "path", tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"))
    parts = parts.select("*", F.xxhash64(F.array_sort("tokens")).alias("tokens_id"))
    bad = labels.filter("quality is not null or toxic is not null").groupBy(F.col("doc_id").alias("page_id")).agg(F.max((F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False)))).alias("bad"))
    mined = mine(parts.join(bad, "page_id"), support, confidence)
    found = matched(parts.groupBy("tokens_id").agg(F.first("tokens").alias("tokens")), mined)
    out = parts.join(apply_rules(parts, rules), ["host", "path"], "left").join(found, "tokens_id", "left")
    verdict = F.coalesce("rule_verdict", F.when(F.col("confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "confidence")
