"""URL filters by association rules, with DataFrame functions only.

A url becomes tokens of all its parts: scheme, registered domain, what stands before it, every host label, every path
segment (the first two with their places too) and its words, file extension, all query keys, values and their words,
fragment, depth. Spark's FP-growth mines the combinations that are frequent among labelled urls together with the label;
of the rules `tokens => bad` those with enough support and confidence stay whose confidence is above the share of bad urls
by MIN_Z standard errors, and of these the ones without a shorter rule that is as confident. Rules are matched by an inverted index: each is listed under its rarest token, urls are looked up
by their tokens, and the rule's other tokens are then checked.

Tokens that are frequent and stand in exactly the same labelled urls are one item of the mining, and any of them fits
where the item does: mining them one by one would give the same rules once for each choice of tokens.

Explicit rules `host/path` go first: a rule fits its host and all subdomains where the url's path begins with its path;
the longest that fits decides.

Scale: urls without their pages are read; mining sees labelled rows only, and of their tokens those with enough support,
which bounds the itemsets; the frequent tokens are broadcast. The index is broadcast if it has at most MAX_BROADCAST rules, else joined by shuffle; a hot token is
then split by the adaptive join. Defined cases: a null url, or one without `://`, has empty host and path, no tokens, and
is allowed; repeated rows get equal verdicts; with no labels nothing is mined and everything without a rule is allowed; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, checkpointed

RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: Share of the labelled urls, rows, and share of bad ones that a rule needs, and by how many standard errors its
#: urls are more often bad than all.
MIN_SUPPORT, MIN_ROWS, MIN_CONFIDENCE, MIN_Z = 0.001, 30, 0.6, 3.0
MAX_BROADCAST = 10_000
BAD = "label:bad"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(ascii_lower(rest), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def explicit_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, said in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        own, _, rest = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def tokens(url: Column) -> Column:
    """Distinct tokens of a url; numbers outside the host are written as 0, words are lower-cased."""
    labels = F.split(host_of(url), r"\.")
    segments = F.filter(F.split(path_of(url), "/"), lambda s: s != "")
    plain = lambda c: F.regexp_replace(c, "[0-9]+", "0")
    words = lambda c: F.filter(F.split(ascii_lower(plain(c)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    called = lambda name, values: F.transform(values, lambda v: F.concat(F.lit(f"{name}:"), v))
    domain = F.array_join(F.slice(labels, -F.least(F.lit(2), F.size(labels)), 2), ".")
    before = F.when(F.size(labels) > 2, F.array_join(F.slice(labels, 1, F.greatest(F.lit(1), F.size(labels) - 2)), "."))
    query, fragment = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), F.regexp_extract(url, "(?s)#(.*)$", 1)
    params = F.filter(F.split(query, "[&;]"), lambda p: p != "")
    named = [
        ("scheme", ascii_lower(F.regexp_extract(url, "(?s)^(.*?)://", 1))),
        ("domain", domain),
        ("sub", before),
        ("path", plain(F.get(segments, F.lit(0)))),
        ("path2", plain(F.get(segments, F.lit(1)))),
        ("ext", F.nullif(F.regexp_extract(path_of(url), r"\.([A-Za-z0-9]{1,8})$", 1), F.lit(""))),
        ("mark", F.when(F.contains(url, F.lit("#")), F.lit("1"))),
        ("fragment", F.nullif(plain(fragment), F.lit(""))),
        ("depth", F.least(F.size(segments), F.lit(6)).cast("string")),
    ]
    listed = [
        ("host", labels),
        ("segment", F.transform(segments, plain)),
        ("word", words(path_of(url))),
        ("key", F.transform(params, lambda p: F.substring_index(p, "=", 1))),
        ("param", F.transform(F.filter(params, lambda p: F.contains(p, F.lit("="))), plain)),
        ("value", words(F.array_join(F.transform(params, lambda p: F.regexp_extract(p, "(?s)=(.*)$", 1)), " "))),
    ]
    every = F.concat(F.array(*(F.concat(F.lit(f"{name}:"), value) for name, value in named)), *(called(name, values) for name, values in listed))
    return F.when(F.contains(url, F.lit("://")), F.array_distinct(F.filter(every, lambda t: t.isNotNull()))).otherwise(F.array().cast("array<string>"))


def items_of(labelled: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(item, tokens, freq) of the tokens of `least` rows or more, those of the same rows together, and (items) of each row."""
    rows = checkpointed(labelled.select("tokens", "bad", F.monotonically_increasing_id().alias("row")))
    found = rows.select("row", F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("freq"), F.bit_xor(F.xxhash64("row")).alias("one"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("two")).where(F.col("freq") >= least)
    classes = checkpointed(found.groupBy("freq", "one", "two").agg(F.array_sort(F.collect_list("token")).alias("tokens")).select(F.col("tokens")[0].alias("item"), "tokens", "freq"))
    # Any token of a class stands for it, as they are in the same rows.
    own = rows.select("row", F.explode("tokens").alias("item")).join(F.broadcast(classes.select("item")), "item").groupBy("row").agg(F.collect_list("item").alias("own"))
    none = F.array().cast("array<string>")
    return classes, checkpointed(rows.select("row", "bad").join(own, "row", "left").select(F.concat(F.coalesce("own", none), F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(none)).alias("items")))


def shortest(rules: DataFrame, longest: int) -> DataFrame:
    """The rules without a shorter one that is as confident; rules: (antecedent, confidence, rows) with all their parts."""
    level = checkpointed(rules.where("size(antecedent) = 1").withColumn("best", F.lit(-1.0)))
    out = level
    for k in range(2, longest + 1):
        parts = rules.where(f"size(antecedent) = {k}").withColumn("part", F.explode(F.transform("antecedent", lambda t: F.array_remove("antecedent", t))))
        below = level.select(F.col("antecedent").alias("part"), F.greatest("confidence", "best").alias("top"))
        level = checkpointed(parts.join(below, "part").groupBy("antecedent", "confidence", "rows").agg(F.max("top").alias("best")))
        out = out.union(level)
    return out.where("best < confidence").drop("best")


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_rows: int = MIN_ROWS, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(antecedent, confidence, rows, token) of the rules for bad urls. labelled: (tokens, bad).

    antecedent: for each item its tokens, one of which a url must have; token: those of the rarest item, a row for each.
    """
    n, share = labelled.agg(F.count("*"), F.avg(F.col("bad").cast("double"))).first()
    if not n:
        return labelled.sparkSession.createDataFrame([], "antecedent array<array<string>>, confidence double, rows double, token string")
    classes, items = items_of(labelled, max(min_support * n, min_rows))
    frequent = checkpointed(FPGrowth(itemsCol="items", minSupport=min(1.0, max(min_support, min_rows / n))).fit(items).freqItemsets.select(F.array_sort("items").alias("items"), "freq"))
    bad = frequent.where(F.array_contains("items", BAD) & (F.size("items") > 1)).select(F.array_remove("items", BAD).alias("antecedent"), F.col("freq").alias("rows"))
    rules = checkpointed(bad.join(frequent.select(F.col("items").alias("antecedent"), "freq"), "antecedent").select("antecedent", (F.col("rows") / F.col("freq")).alias("confidence"), F.col("rows").cast("double").alias("rows")))
    error = F.sqrt(F.lit(share * (1 - share)) / (F.col("rows") / F.col("confidence")))
    longest = rules.agg(F.max(F.size("antecedent"))).first()[0] or 0
    kept = shortest(rules, longest).where((F.col("confidence") >= min_confidence) & (F.col("confidence") - share >= MIN_Z * error))
    listed = kept.select(F.col("antecedent").alias("own"), "confidence", "rows", F.explode("antecedent").alias("item")).join(classes, "item")
    rarest = F.min_by("tokens", F.struct("freq", "item"))
    return checkpointed(listed.groupBy("own", "confidence", "rows").agg(F.collect_list("tokens").alias("antecedent"), rarest.alias("rarest")).select("antecedent", "confidence", "rows", F.explode("rarest").alias("token")))


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, confidence) of the distinct urls (url, tokens) that a rule fits."""
    index = rules.select("token", "antecedent", "confidence")
    if rules.count() <= MAX_BROADCAST:
        index = F.broadcast(index)
    looked_up = urls.select("url", "tokens", F.explode("tokens").alias("token")).join(index, "token")
    return looked_up.where(F.forall("antecedent", lambda item: F.arrays_overlap(item, "tokens"))).groupBy("url").agg(F.max("confidence").alias("confidence"))


def url_verdicts(pages: DataFrame, labels: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, confidence of each row of pages.

    labels: (doc_id, quality, toxic) by page id; a page is bad if its quality is 0 or it is toxic.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    bad = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.coalesce((F.col("quality") == 0) | (F.col("toxic") > 0), F.lit(False))).alias("bad"))
    labelled = rows.join(bad, rows.page_id == bad.doc_id).select(tokens(F.col("url")).alias("tokens"), "bad").where("size(tokens) > 0")
    distinct = rows.select("url").distinct().withColumn("tokens", tokens(F.col("url")))
    hits = matched(distinct, mine(labelled))
    rule, verdict = explicit_rule(host_of(F.col("url")), path_of(F.col("url")), rules)
    joined = rows.join(hits, "url", "left")
    return joined.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), rule.alias("rule"), F.coalesce(verdict, F.when(F.col("confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "confidence")
