"""URL filters by association rules.

URLs are cut into tokens.  FP-growth mines token combinations that come with a
bad (or a good) label; rules on too few pages, or too close to the labels' base
rates, are pruned.  An inverted index from each rule's rarest token to the rule finds the
candidates of a URL, and a rule matches if the URL has all its tokens.  Listed
host and path rules come first.

Tokens that occur in exactly the same labelled pages are mined as one: every
combination of them has the same pages, so only the largest says anything.
Without this, a few copies of one long URL would give a rule for each subset of
its segments.

DataFrame functions and Spark's own FP-growth only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_path

BAD, GOOD = "label=bad", "label=good"
ANY = "any"  # in every basket, never in a rule; tokens of URLs begin with their kind


@dataclass(frozen=True)
class ListedRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


HOST_LENGTH = 253  # of a domain name


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_host_and_path(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Append ``host`` (after the first ``://`` up to ``/ ? #``) and ``path`` (then up to ``? #``); empty without ``://``."""
    url = F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return pages.withColumns({"host": ascii_lower(host), "path": path})


def listed(rules: list[ListedRule], host: Column, path: Column) -> Column:
    """The longest listed rule (verdict, name) that fits host or a parent of it and begins the path; else null."""
    out = F.lit(None).cast("struct<verdict:string,name:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.verdict).alias("verdict"), F.lit(r.name).alias("name"))).otherwise(out)
    return out


def tokens(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens of a URL: its host and parent hosts, path segments, their endings, and the names of query fields.

    Segments of digits alone count as one token, as they number pages.  A host longer
    than names may be (HOST_LENGTH) has no parent hosts.
    """
    labels = F.when(F.length(host) > HOST_LENGTH, F.array(host)).otherwise(F.filter(F.split(host, r"\."), lambda x: x != ""))
    hosts = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels), F.lit(1))),
                        lambda i: F.concat(F.lit("h:"), F.array_join(F.slice(labels, i, F.greatest(F.size(labels) - i + 1, F.lit(0))), ".")))
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    parts = F.transform(segments, lambda s: F.concat(F.lit("p:"), F.regexp_replace(F.regexp_replace(s, r"\.[A-Za-z0-9]{1,5}$", ""), r"^[0-9]+$", "#")))
    endings = F.transform(F.filter(segments, lambda s: s.rlike(r"\.[A-Za-z0-9]{1,5}$")), lambda s: F.concat(F.lit("e:"), F.regexp_extract(s, r"\.([A-Za-z0-9]{1,5})$", 1)))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^?#]*\?([^#]*)", 1)
    fields = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda q: F.concat(F.lit("q:"), F.regexp_extract(q, "^([^=]*)", 1)))
    return F.array_distinct(F.filter(F.concat(hosts, parts, endings, fields), lambda x: F.length(x) > 2))


def mine(labelled: DataFrame, tokens_col: str = "tokens", bad_col: str = "bad", min_support: float = 0.0,
         min_confidence: float = 0.0, min_count: int = 1, min_lift: float = 0.0) -> DataFrame:
    """Rules (rule, items, key, n_items, bad, confidence, support, lift) from labelled token sets.

    A token combination is kept if it comes with one label in ``min_count`` rows
    at least, a number that does not grow with the table, and in shares of
    ``min_support`` of all rows and ``min_confidence`` of its own.  ``lift`` is
    its confidence over the label's share of all rows.  It must be ``min_lift``
    or more, or that of the other label ``1 / min_lift`` or less, so that a label
    that most rows have can be told too.  ``key`` is its rarest token, under which
    the inverted index lists it.  No rows give no rules.
    """
    rows = labelled.select(F.col(tokens_col).alias("items"), F.when(F.col(bad_col), BAD).otherwise(GOOD).alias("label")).where("size(items) > 0")
    total = rows.count()
    spark = labelled.sparkSession
    if not total:
        return spark.createDataFrame([], "rule int, items array<string>, key string, n_items int, bad boolean, confidence double, support double, lift double")
    baskets = rows.select(F.array_append("items", F.col("label")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=max(min_support, (min_count - 0.5) / total), minConfidence=min_confidence).fit(baskets)
    sets = model.freqItemsets
    alone = sets.where(F.size("items") == 1).select(F.col("items")[0].alias("key"), F.col("freq").alias("key_freq"))
    rules = model.associationRules.where(F.col("consequent")[0].isin(BAD, GOOD)).select(
        F.array_sort(F.array_except("antecedent", F.array(F.lit(BAD), F.lit(GOOD)))).alias("items"),
        (F.col("consequent")[0] == BAD).alias("bad"), "confidence", "support", "lift")
    base = F.col("confidence") / F.col("lift")
    rules = rules.where((F.col("lift") >= min_lift - 1e-9) | ((1 - F.col("confidence")) * min_lift <= (1 - base) + 1e-9))
    keyed = rules.select("*", F.explode("items").alias("key")).join(alone, "key").groupBy("items", "bad", "confidence", "support", "lift").agg(
        F.min(F.struct("key_freq", "key")).alias("k"))
    return keyed.select(F.xxhash64("items", "bad").alias("rule"), "items", F.col("k.key").alias("key"), F.size("items").alias("n_items"), "bad", "confidence", "support", "lift")


def bundles(known: DataFrame, tokens_col: str = "tokens", row_col: str = "row", min_count: int = 1) -> DataFrame:
    """(key, members): the tokens of at least ``min_count`` rows, those of exactly the same rows together under the first of them.

    Tokens have the same rows if their counts and two sums of row hashes agree.
    A bundle is part of every URL that has any token of it, so it is never larger
    than a URL's tokens.  ``row_col`` must differ between rows."""
    each = known.select(F.col(row_col).alias("r"), F.explode(tokens_col).alias("token"))
    marks = [F.sum(F.xxhash64("r", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in (1, 2)]
    same = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"), *marks).where(F.col("n") >= min_count)
    return same.groupBy("n", "s1", "s2").agg(F.array_sort(F.collect_list("token")).alias("members")).select(F.col("members")[0].alias("key"), "members")


def mine_bundles(known: DataFrame, min_support: float = 0.0, min_confidence: float = 0.0, min_count: int = 1, min_lift: float = 0.0) -> DataFrame:
    """``mine`` over (row, tokens, bad) with bundled tokens: of the combinations with the same pages, rules hold the largest."""
    groups = bundles(known, min_count=min_count)
    firsts = known.select("row", F.explode("tokens").alias("key")).join(groups.select("key"), "key").groupBy("row").agg(F.collect_list("key").alias("tokens"))
    baskets = known.select("row", "bad").join(firsts, "row", "left").select(F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"), "bad")
    # a row without a frequent token still counts in the labels' shares
    rules = mine(baskets.withColumn("tokens", F.array_append("tokens", F.lit(ANY))), "tokens", "bad", min_support, min_confidence, min_count, min_lift)
    same = ["rule", "key", "bad", "confidence", "support", "lift"]
    wide = rules.withColumn("items", F.array_remove("items", ANY)).where(F.size("items") > 0).select(*same, F.explode("items").alias("first")).join(
        groups.select(F.col("key").alias("first"), "members"), "first").groupBy(*same).agg(F.array_sort(F.flatten(F.collect_list("members"))).alias("items"))
    # with and without the token of every row a rule is the same
    once = wide.groupBy("items", "bad", "confidence", "support", "lift").agg(F.min(F.when(F.col("key") != ANY, F.col("key"))).alias("key"))
    return once.where("key is not null").select(F.xxhash64("items", "bad").alias("rule"), "items", "key", F.size("items").alias("n_items"), "bad", "confidence", "support", "lift")


def judge(pages: DataFrame, rules: DataFrame, listed_rules: list[ListedRule], url_col: str = "url", keep: list[str] | None = None) -> DataFrame:
    """Append ``host``, ``path``, ``rule`` (a listed rule's name or null), ``verdict`` and ``matched`` (the mined rule's tokens).

    The longest listed rule decides; else the mined rule with the highest
    lift among those whose tokens the URL has (then the one with the most
    tokens, the highest support, a good one, the first in order); else ``allow``.
    A null URL or one without ``://`` has empty host and path and is allowed
    unless a mined rule says otherwise.  One row out for each row in.
    """
    keep = [c for c in (pages.columns if keep is None else keep) if c not in ("host", "path", "rule", "verdict", "matched")]
    src = with_host_and_path(pages.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{url_col}`").cast("string").alias("__url")), "__url")
    # written once, so that the numbers of rows stay while their tokens are looked up apart from them
    at = shared_path(pages.sparkSession, "judged-urls")
    src.withColumns({"listed": listed(listed_rules, F.col("host"), F.col("path")), "tokens": tokens(F.col("host"), F.col("path"), F.col("__url")),
                     "row": F.monotonically_increasing_id()}).drop("__url").write.parquet(at)
    row = pages.sparkSession.read.parquet(at)
    index = rules.select(F.col("key"), F.struct((-F.col("lift")).alias("l"), (-F.col("n_items")).alias("n"), (-F.col("support")).alias("s"),
                                                F.col("bad"), F.col("items")).alias("m"))
    # The optimizer sends the index to the tasks if it is small and deals out both sides if it is not.  A token goes
    # out with its row's number alone: a long URL has many, and only the rules it meets are held against all of them.
    hits = row.select("row", F.explode("tokens").alias("key")).join(index, "key").groupBy("row").agg(F.collect_set("m").alias("ms"))
    fitting = F.filter("ms", lambda m: F.size(F.array_except(m["items"], F.col("tokens"))) == 0)
    best = row.join(hits, "row", "left").withColumn("best", F.array_min(fitting))
    method = F.when(F.col("best.bad"), "block").otherwise("allow")
    return best.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "host", "path", F.col("listed.name").alias("rule"),
                       F.coalesce("listed.verdict", method).alias("verdict"), F.when(F.col("listed").isNull(), F.col("best.items")).alias("matched"))


def filter_urls(pages: DataFrame, labels: DataFrame, listed_rules: list[ListedRule], url_col: str = "url", id_col: str = "page_id",
                min_support: float = 0.0, min_confidence: float = 0.0, keep: list[str] | None = None,
                min_count: int = 3, min_lift: float = 2.0) -> DataFrame:
    """Mine rules from the pages that ``labels`` (id, bad) marks, and judge all pages.

    Rows of ``labels`` with a null id or mark are left out, and an id marked more
    than once counts as bad if any of its marks is.  Repeated pages count each.
    By default a rule needs three pages of its label, whatever the size of the
    table, and twice the label's base rate (or half the other label's).  URLs may
    be of any length; empty tables of pages or labels give no rules and no error.
    """
    marks = labels.where("id is not null and bad is not null").groupBy("id").agg(F.max("bad").alias("bad"))
    cut = with_host_and_path(pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url")), "url")
    known = cut.select("id", tokens(F.col("host"), F.col("path"), F.col("url")).alias("tokens")).join(marks, "id")
    path = shared_path(pages.sparkSession, "labelled-urls")
    known.select("tokens", "bad").withColumn("row", F.monotonically_increasing_id()).write.parquet(path)
    rules = mine_bundles(pages.sparkSession.read.parquet(path), min_support, min_confidence, min_count, min_lift)
    return judge(pages, rules, listed_rules, url_col, keep)
