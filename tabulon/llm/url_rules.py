"""URL filters: host and path rules that are given, and association rules that FP-growth mines from labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabulon.llm.site_templates import host_column
from tabulon.session import staged

#: Rules as they are given: verdict and host with path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

LEAST_SUPPORT = 0.002  # of the labelled urls
LEAST_ROWS = 20  # labelled urls at least
LEAST_CONFIDENCE = 0.5
BROADCAST_RULES = 10_000
LABEL = "label:block"


def path_column(url: str) -> str:
    """SQL for the path of a url: after its host up to ?, # or the end; without :// (or null) empty."""
    return f"coalesce(regexp_extract({url}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"


def token_column(url: str) -> str:
    """SQL for the set of a url's tokens: scheme, host, labels of the host, segments of the path that are no numbers,
    names of query arguments, and whether there is a fragment. A null url has none."""
    host, path = host_column(url), path_column(url)
    query = f"regexp_extract({url}, '(?s)[?]([^#]*)', 1)"
    prefixed = lambda name, array: f"transform(filter({array}, x -> x <> ''), x -> concat('{name}:', x))"
    parts = [
        prefixed("scheme", f"array(lower(regexp_extract({url}, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)))"),
        prefixed("host", f"array({host})"),
        prefixed("label", f"split({host}, '[.]')"),
        prefixed("path", f"filter(split({path}, '/'), x -> NOT x RLIKE '^[0-9]+$')"),
        prefixed("argument", f"transform(split({query}, '&'), x -> regexp_extract(x, '^([^=]*)', 1))"),
        prefixed("part", f"array(CASE WHEN {url} LIKE '%#%' THEN 'fragment' ELSE '' END)"),
    ]
    return f"coalesce(array_distinct(concat({', '.join(parts)})), array())"


def mined_rules(
    labelled: DataFrame, support: float = LEAST_SUPPORT, confidence: float = LEAST_CONFIDENCE, least_rows: int = LEAST_ROWS
) -> DataFrame:
    """``rule`` (a number), ``tokens``, ``confidence`` and ``support``: sets of url tokens that mostly occur with label 1.

    ``labelled`` has ``url`` and ``bad`` (0/1; null rows are left out). FP-growth finds the frequent sets among all labelled urls; rules
    keep those that are frequent and confident enough and more confident than each rule with fewer of their tokens.
    """
    given = labelled.where("bad IS NOT NULL AND url IS NOT NULL")
    items = F.expr(f"array_union({token_column('url')}, CASE WHEN bad = 1 THEN array('{LABEL}') ELSE array() END)")
    baskets = staged(given.select(items.alias("items")), "baskets")
    n = baskets.count()
    schema = "rule long, tokens array<string>, confidence double, support double"
    if n < least_rows:
        return labelled.sparkSession.createDataFrame([], schema)
    least = max(support, least_rows / n)
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, least), minConfidence=confidence).fit(baskets)
    found = model.associationRules.where(F.col("consequent")[0] == LABEL)
    found = found.select(F.sort_array("antecedent").alias("tokens"), "confidence", "support")
    rules = staged(found, "url-rules").withColumn("key", F.concat_ws("\n", "tokens"))
    # A rule is idle if a part of it is a rule of no less confidence; parts are found by their first token.
    wider = rules.select("key", "tokens", "confidence", F.explode("tokens").alias("token"))
    part = rules.select(F.col("tokens").alias("fewer"), F.col("confidence").alias("surer"), F.col("tokens")[0].alias("token"))
    idle = wider.join(part, "token").where((F.size("fewer") < F.size("tokens")) & (F.col("surer") >= F.col("confidence")))
    idle = idle.where(F.size(F.array_except("fewer", "tokens")) == 0).select("key").distinct()
    return rules.join(idle, "key", "left_anti").select(F.xxhash64("key").alias("rule"), "tokens", "confidence", "support")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``url`` and ``rules`` (numbers) for the urls that a mined rule fits; ``urls`` has distinct ``url``.

    The inverted index has each rule once, under the token that is rarest among the rules' tokens; a url looks up its
    tokens and is checked against the rules it finds.
    """
    rules = staged(rules, "rules")
    token = rules.select("rule", "tokens", F.explode("tokens").alias("token"))
    usual = token.groupBy("token").agg(F.count("*").alias("n"))
    rarest = Window.partitionBy("rule").orderBy("n", "token")
    index = token.join(usual, "token").withColumn("place", F.row_number().over(rarest)).where("place = 1")
    index = index.select("token", "rule", F.col("tokens").alias("needed"))
    if rules.count() <= BROADCAST_RULES:
        index = F.broadcast(index)
    looked = urls.select("url", F.expr(f"{token_column('url')} AS own")).withColumn("token", F.explode("own"))
    hits = looked.join(index, "token").where(F.size(F.array_except("needed", "own")) == 0)
    return hits.groupBy("url").agg(F.sort_array(F.collect_set("rule")).alias("rules"))


def given_rule(rules: Sequence[tuple[str, str]]) -> tuple[str, str]:
    """SQL for the longest given rule that fits columns ``host`` and ``path``, and for its verdict (null: none fits)."""
    rule, verdict = "CASE", "CASE"
    for say, text in sorted(rules, key=lambda r: -len(r[1])):
        host, slash, path = text.partition("/")
        fits = f"(host = '{host}' OR endswith(host, '.{host}')) AND startswith(path, '{slash}{path}')"
        rule += f" WHEN {fits} THEN '{text}'"
        verdict += f" WHEN {fits} THEN '{say}'"
    return rule + " END", verdict + " END"


def judged(pages: DataFrame, labelled: DataFrame, rules: Sequence[tuple[str, str]] = RULES, **options) -> DataFrame:
    """``pages`` judged by their ``url``: ``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``mined`` (rules that fit).

    A given rule fits its host and all subdomains where the path starts with its own; the longest wins. Other urls are
    blocked if a mined rule fits, else allowed. A null url has empty host and path and is allowed; repeated rows are judged alike.
    """
    given, verdict = given_rule(rules)
    split = pages.select("page_id", "url", F.expr(f"{host_column('url')} AS host"), F.expr(f"{path_column('url')} AS path"))
    hits = matched(pages.where("url IS NOT NULL").select("url").distinct(), mined_rules(labelled, **options))
    joined = split.join(hits, "url", "left")
    by_rules = F.when(F.col("rules").isNull(), "allow").otherwise("block")
    return joined.select(
        "page_id", "host", "path", F.expr(given).alias("rule"), F.coalesce(F.expr(verdict), by_rules).alias("verdict"),
        F.coalesce(F.size("rules"), F.lit(0)).alias("mined"),
    )


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``url`` and ``bad`` (low quality or toxic) of pages whose url ends in the number of a labelled document."""
    number = F.expr(f"try_cast(regexp_extract({path_column('url')}, '/([0-9]+)/?$', 1) AS bigint)")
    bad = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.expr("CAST(quality = 0 OR toxic = 1 AS int)")).alias("bad"))
    return pages.select("url", number.alias("doc_id")).join(bad, "doc_id").select("url", "bad")
