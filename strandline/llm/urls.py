"""URL filters: host suffixes and path prefixes looked up by a short digest prefix, confirmed by the full digest.

A URL's expressions are every suffix of its host at a dot joined with every prefix of its path at a slash. A rule is
filed under its host and the part of its path up to the last slash, which is one of the expressions of every URL that it
fits. The join is on the first hex digits of the expression's digest; the full digest and the rest of the rule's path
are compared afterwards, and the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hex digits of the digest that the join compares.
PREFIX = 8
#: Keys up to which the rule table is broadcast; a key is a digest and its rules, some hundred bytes.
BROADCAST_KEYS = 100_000
#: Beyond that, shares of a hot key.
SALTS = 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: F.Column) -> tuple[F.Column, F.Column]:
    """(host, path): host from after the first `://` to `/`, `?`, `#` or the end, A-Z lower-cased; path on to `?`, `#` or the
    end. Both empty for null and where there is no `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(F.split(rest, "[?#]", 2)[0], F.lit(""))
    host = F.split(rest, "/", 2)[0]
    return F.translate(host, _UPPER, _LOWER), F.substring(rest, F.length(host) + 1, F.length(rest))


def rule_table(rules: DataFrame) -> DataFrame:
    """(short, digest, rules): the rules (host, path, verdict) filed by key. Null rules and hosts are left out; repeated
    rules count once; of rules alike but for the verdict, block wins."""
    r = rules.select(F.translate("host", _UPPER, _LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").where("host is not null and host <> ''")
    r = r.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    folder = F.regexp_extract("path", "^(?s)(.*/)?", 0)
    digest = F.sha2(F.concat("host", F.lit("\n"), folder), 256)
    one = F.struct(F.length(F.concat("host", "path")).alias("size"), F.concat("host", "path").alias("rule"), "path", "verdict")
    return r.select(F.substring(digest, 1, PREFIX).alias("short"), digest.alias("digest"), one.alias("one")).groupBy("short", "digest").agg(F.collect_list("one").alias("rules"))


def judge(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict): a row for every row of `pages`; the longest rule (host and path together) that
    fits decides, else `default`.

    A rule fits its host and all subdomains, where the path starts with the rule's path. Null and broken URLs have empty
    host and path and take the default. Repeated rows and null page ids come out as often as they went in. No rules, or no
    pages, are no error. Other columns are not read."""
    table = rule_table(rules)
    most = rules.select(F.coalesce(F.max(F.size(F.split("host", r"\."))), F.lit(1)), F.coalesce(F.max(F.size(F.split("path", "/"))), F.lit(1))).first()
    labels, depth = int(most[0]), int(most[1])  # longer suffixes and deeper prefixes are no rule's key
    host, path = split_url(F.col(url))
    p = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    p = p.groupBy("page_id", "host", "path").agg(F.count(F.lit(1)).alias("times"))
    suffixes = F.expr(f"transform(sequence(1, least(size(split(host, '[.]')), {labels})), k -> substring_index(host, '.', -k))")
    folders = F.concat(F.array(F.lit("")), F.expr(f"transform(sequence(1, least(size(split(path, '/')), {depth})), k -> if(k < size(split(path, '/')), concat(substring_index(path, '/', k), '/'), ''))"))
    keys = F.array_distinct(F.flatten(F.transform(suffixes, lambda s: F.transform(folders, lambda f: F.concat(s, F.lit("\n"), f)))))
    e = p.select("page_id", "host", "path", "times", F.explode(keys).alias("expression"))
    e = e.withColumn("digest", F.sha2("expression", 256)).drop("expression").withColumn("short", F.substring("digest", 1, PREFIX))
    t = table.withColumnRenamed("digest", "full")
    if table.count() <= BROADCAST_KEYS:
        hit = e.join(F.broadcast(t), "short", "left")
    else:
        e = e.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)))
        hit = e.join(t.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["short", "salt"], "left")
    fits = F.filter("rules", lambda r: F.col("path").startswith(r["path"]))
    best = F.when(F.col("digest") == F.col("full"), F.array_max(fits))
    won = hit.select("page_id", "host", "path", "times", best.alias("best")).groupBy("page_id", "host", "path", "times").agg(F.max("best").alias("best"))
    won = won.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("_n"))
    return won.drop("_n")
