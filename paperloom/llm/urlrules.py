"""URL filters by hashed expressions.

A canonical URL is expanded into the combinations of its host suffixes (the host itself and all of two labels or
more) and its path prefixes (with query, without, the root, and all leading directories), down to the
number of labels and directories that the deepest rule has, so that every rule can be met. Each expression is hashed; URLs and rules are
equi-joined on the first 32 bits of the SHA-256 digest and a hit counts only if the whole digest
agrees. Of the rules that hit, the one with the longest host suffix decides, then the longest path,
then ``allow`` before ``block``, then the least rule_id. A URL that no rule hits is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.session import fresh_name

#: hexadecimal digits of the short prefix
PREFIX_DIGITS = 8


def canonical_parts(url: Column) -> tuple[Column, Column, Column]:
    """(host, path, query) of a URL; the host is null where there is none.

    Control and outer white space go, as do scheme, user, port and fragment; the host is in lower
    case without outer or doubled dots; runs of slashes become one and ``.`` and ``..`` are resolved.
    The query keeps its question mark; no query is an empty string.
    """
    clean = F.regexp_replace(F.trim(F.regexp_replace(url, r"[\t\r\n]", "")), r"#.*$", "")
    rest = F.regexp_replace(clean, r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    authority = F.regexp_extract(rest, r"^([^/?]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":\d*$", ""))
    host = F.regexp_replace(F.regexp_replace(host, r"\.+", "."), r"^\.|\.$", "")
    tail = F.regexp_extract(rest, r"^[^/?]*(.*)$", 1)
    path = F.regexp_replace(F.regexp_extract(tail, r"^([^?]*)", 1), r"/+", "/")
    steps = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))

    def step(done: Column, s: Column) -> Column:
        return F.when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(s)))

    resolved = F.when(path.rlike(r"(^|/)\.\.(/|$)"), F.aggregate(steps, F.array().cast("array<string>"), step)).otherwise(steps)
    joined = F.concat(F.lit("/"), F.array_join(resolved, "/"))
    slash = F.when(path.rlike(r"/(\.{1,2})?$") & (joined != "/"), F.lit("/")).otherwise(F.lit(""))
    return F.when(host != "", host), F.concat(joined, slash), F.regexp_extract(tail, r"(\?.*)$", 1)


def host_suffixes(host: Column, labels_at_most: Column | int) -> Column:
    """The host and its suffixes of two labels or more, up to so many; an address only itself."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    top = F.lit(labels_at_most)
    starts = F.sequence(F.greatest(n - top + 1, F.lit(2)), F.greatest(n - 1, F.lit(2)))
    shorter = F.transform(F.filter(starts, lambda i: i <= n - 1), lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."))
    shorter = F.when((n > 2) & (top >= 2), shorter).otherwise(F.array().cast("array<string>"))
    return F.when(host.rlike(r"^\d+(\.\d+){3}$|^\["), F.array(host)).otherwise(F.array_distinct(F.concat(F.array(host), shorter)))


def path_prefixes(path: Column, query: Column, directories_at_most: Column | int) -> Column:
    """The path with query, without, the root and the leading directories, up to so many deep."""
    steps = F.split(path, "/")
    top = F.least(F.size(steps) - 2, F.lit(directories_at_most))
    folders = F.transform(F.filter(F.sequence(F.lit(1), F.greatest(top, F.lit(1))), lambda i: i <= top), lambda i: F.concat(F.array_join(F.slice(steps, F.lit(1), i + 1), "/"), F.lit("/")))
    return F.array_distinct(F.concat(F.array(F.concat(path, query), path, F.lit("/")), folders))


def expression(rule: Column) -> Column:
    """The canonical expression of a rule such as ``example.com/ads/``; a bare host means its root."""
    host, path, query = canonical_parts(rule)
    return F.concat(host, path, query)


def filter_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """``pages``, all columns, with (verdict, rule_id): what the deciding rule says of each URL.

    ``rules`` has (rule_id, pattern, action), action ``allow`` or ``block``. Rules without a pattern, a
    host or a known action are left out; of equal patterns the precedence above decides. A URL that
    is null or has no host is ``allow`` with a null rule, like one that no rule hits. Repeated rows
    are judged alike and stay. Very long URLs are expanded as far as the rules reach. No pages or no rules give no hits. Columns of ``pages`` called verdict or rule_id keep their names and
    the new ones get an underscore.
    """
    own = {c: fresh_name(pages, c) for c in ("_e", "_hit")}
    verdict, rule_id = fresh_name(pages, "verdict"), fresh_name(pages, "rule_id")
    known = rules.where(F.col("action").isin("allow", "block")).select("rule_id", "action", expression(F.col("pattern")).alias("expression")).where("expression is not null")
    known = known.withColumn("digest", F.sha2("expression", 256))
    place = F.split_part("expression", F.lit("?"), F.lit(1))
    deepest = known.agg(F.max(F.size(F.split(F.split_part(place, F.lit("/"), F.lit(1)), r"\."))).alias("labels"), F.max(F.size(F.split(place, "/")) - 2).alias("directories")).first()  # one row
    known = known.select("rule_id", "action", "expression", "digest", F.substring("digest", 1, PREFIX_DIGITS).alias("short"))
    # rules meet distinct URLs, so repeated URLs cost nothing more
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number given keeps the expansion from being coalesced to few tasks
    urls = pages.select(F.col(url_col).alias("u")).where("u is not null").repartition(parts, "u").distinct()
    host, path, query = canonical_parts(F.col("u"))
    urls = urls.select("u", host.alias("host"), path.alias("path"), query.alias("query")).where("host is not null")
    each = urls.select("u", F.explode(host_suffixes(F.col("host"), deepest.labels or 0)).alias("suffix"), path_prefixes(F.col("path"), F.col("query"), deepest.directories or 0).alias("paths"))
    each = each.select("u", F.length("suffix").alias("host_length"), F.explode(F.transform("paths", lambda p: F.concat("suffix", p))).alias("e"))
    each = each.withColumn("full", F.sha2("e", 256))
    hits = each.join(known, F.substring("full", 1, PREFIX_DIGITS) == F.col("short")).where("full = digest")
    rank = F.struct(-F.col("host_length"), -F.length("e"), F.when(F.col("action") == "allow", 0).otherwise(1), F.col("rule_id"))
    decided = hits.groupBy("u").agg(F.min_by(F.struct("action", "rule_id"), rank).alias("best")).select(F.col("u").alias(own["_e"]), F.col("best").alias(own["_hit"]))
    joined = pages.join(decided, F.col(url_col) == F.col(own["_e"]), "left")
    return joined.select(*(pages[c] for c in pages.columns), F.coalesce(F.col(own["_hit"])["action"], F.lit("allow")).alias(verdict), F.col(own["_hit"])["rule_id"].alias(rule_id))
