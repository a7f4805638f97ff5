"""URL filters: explicit host and path rules first, association rules mined from labels for the rest.

URLs become sets of tokens: scheme, each host label with its depth from the right (``host2=example`` for example.com), the first
host label, path words, query keys. No token implies another, and a URL has as many as it has parts. Spark's
FP-growth mines token combinations together with the label of labelled URLs; rules whose consequent is a label are kept
when they hold for enough URLs (a share and an absolute number), are confident, and say more than the label's base rate.
A rule is dropped where a shorter one with the same verdict is as confident: the shorter one fits wherever it fits
and wins, so no verdict changes and no number of rules is fixed. An inverted index holds each rule once, under the token
that the fewest rules hold, so a URL meets only rules that share that token. The index is joined by token; it is
broadcast only while it is below the session's threshold. A URL without a fitting rule is allowed.

Defined results: a null URL or one without ``://`` has empty host and path and fits no rule; repeated rows are
judged alike and all returned; without labels, or with too few for any rule, only the explicit rules decide; ties between mined rules
go to the more confident, then more supported, then longer rule, then to block; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.llm.base import materialise

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK, ALLOW = "block", "allow"
_LABEL = "label="


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def document_number(url: Column) -> Column:
    """The number that ends a URL's path, as in ``/en/728.html``, as a long; null where there is none."""
    return F.regexp_extract(path(url), r"/(\d{1,18})(?:\.\w+)?/?$", 1).try_cast("long")


def explicit_rule(h: Column, p: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest (action, host/path) rule that fits, nulls where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda r: len(r[1])):  # the longest is tested last and wins
        name, _, rest = text.partition("/")
        fits = ((h == name) | h.endswith("." + name)) & p.startswith("/" + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, action).otherwise(verdict)
    return rule, verdict


def tokens(url: Column) -> Column:
    """Distinct tokens of a URL; digits in words are written as 0, so that numbers do not multiply tokens."""
    h, p = host(url), path(url)
    labels = F.filter(F.split(h, r"\."), lambda x: x != "")
    depths = F.transform(F.reverse(labels), lambda x, i: F.concat(F.lit("host"), (i + 1).cast("string"), F.lit("="), x))
    lead = F.transform(F.slice(labels, 1, 1), lambda x: F.concat(F.lit("lead="), x))
    words = F.transform(F.filter(F.split(F.regexp_replace(p, r"\d+", "0"), r"[/._-]+"), lambda x: x != ""), lambda x: F.concat(F.lit("path="), x))
    keys = F.transform(F.regexp_extract_all(url, F.lit(r"[?&]([^=&#]+)"), F.lit(1)), lambda x: F.concat(F.lit("key="), x))
    scheme = F.array(F.concat(F.lit("scheme="), F.translate(F.regexp_extract(url, r"(?s)^(.*?)://", 1), _UPPER, _LOWER)))
    some = F.array_distinct(F.concat(scheme, depths, lead, words, keys))
    return F.when(url.contains("://"), some).otherwise(F.array().cast("array<string>"))


def mine(labelled: DataFrame, url_col: str = "url", label_col: str = "label", min_support: float = 0.005, min_count: int = 10, min_confidence: float = 0.7) -> DataFrame:
    """(verdict, tokens, confidence, support) of the pruned rules; ``label_col`` holds block or allow.

    A rule holds for at least ``min_count`` labelled URLs and a share of ``min_support`` of them.
    """
    from pyspark.ml.fpm import FPGrowth

    marked = F.concat(F.lit(_LABEL), F.col(label_col))
    sets = labelled.where(F.col(url_col).isNotNull() & F.col(label_col).isNotNull()).select(F.array_append(tokens(F.col(url_col).cast("string")), marked).alias("items"))
    sets = materialise(sets, "items")
    n = sets.count()
    if n < min_count:
        return labelled.sparkSession.createDataFrame([], "verdict string, tokens array<string>, confidence double, support double")
    model = FPGrowth(itemsCol="items", minSupport=max(min_support, min_count / n), minConfidence=min_confidence).fit(sets)
    rules = model.associationRules.where(F.get("consequent", F.lit(0)).startswith(_LABEL) & ~F.exists("antecedent", lambda t: t.startswith(_LABEL)) & (F.col("lift") > 1))
    rules = materialise(rules.select(F.expr(f"substring(consequent[0], {len(_LABEL) + 1})").alias("verdict"), F.array_sort("antecedent").alias("tokens"), "confidence", "support"), "mined")
    return without_dominated(rules)


def without_dominated(rules: DataFrame) -> DataFrame:
    """Rules of which no rule with one token less has the same verdict and is as confident."""
    shorter = rules.where(F.size("tokens") > 1).select("verdict", "tokens", F.col("confidence").alias("mine"), F.explode(F.transform("tokens", lambda t: F.array_remove("tokens", t))).alias("part"))
    known = rules.select(F.col("verdict").alias("k_verdict"), F.col("tokens").alias("k_tokens"), F.col("confidence").alias("theirs"))
    weak = shorter.join(known, (F.col("verdict") == F.col("k_verdict")) & (F.col("part") == F.col("k_tokens")) & (F.col("theirs") >= F.col("mine"))).select("verdict", "tokens")
    return rules.join(weak, ["verdict", "tokens"], "left_anti")


def inverted_index(rules: DataFrame) -> DataFrame:
    """(i_token, verdict, tokens, confidence, support): each rule under its token that the fewest rules hold."""
    spread = rules.withColumn("token", F.explode("tokens"))
    rare = spread.groupBy("token").agg(F.count(F.lit(1)).alias("used"))
    keyed = spread.join(rare, "token")
    return keyed.groupBy("verdict", "tokens", "confidence", "support").agg(F.min(F.struct("used", "token")).alias("rarest")).select(F.col("rarest.token").alias("i_token"), "verdict", "tokens", "confidence", "support")


def judge(pages: DataFrame, rules: list[tuple[str, str]], mined: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, mined_rule."""
    url = F.col(url_col).cast("string")
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("page_id"), host(url).alias("host"), path(url).alias("path"), tokens(url).alias("held"))
    rows = materialise(rows, "tokens")  # tokens are computed once for each row
    index = materialise(inverted_index(mined), "rules")
    met = rows.select("row", "held", F.explode("held").alias("token")).join(index, F.col("token") == F.col("i_token"))
    met = met.where(F.size(F.array_except("tokens", "held")) == 0)
    best = F.max(F.struct("confidence", "support", F.size("tokens").alias("n"), "verdict", "tokens"))
    decided = met.groupBy(F.col("row").alias("d_row")).agg(best.alias("best"))
    rule, verdict = explicit_rule(F.col("host"), F.col("path"), rules)
    judged = rows.select("row", "page_id", "host", "path").join(decided, F.col("row") == F.col("d_row"), "left")
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.col("best.verdict"), F.lit(ALLOW)).alias("verdict"), F.array_join("best.tokens", " ").alias("mined_rule"))
