"""URL filter as a temporal list join.

List entries carry a date and an action. Per list and pattern they become validity intervals [added, next change), and
every capture is evaluated against the entries that were active when it was fetched: an as-of join, done as an equality
join on (pattern, time bucket) with the interval as its rest. Buckets of `BUCKET_DAYS` keep a host with a third of all
captures from meeting all of its intervals, and let Spark split its rows.

A capture's patterns are its host, every parent domain of it, and the host with the first path segment. Decisions are
made once per distinct (url, day) and joined back, so repeated captures cost one.

Defined results: of several entries of one pattern on one day a removal wins; a null url, a url without a host or a
null day matches nothing; entries with a null field are ignored; repeated rows are repeated; no entries or no captures
give no match or no row. Columns of the captures pass through, except those named as the outcome (n_active, lists,
since, blocked). Hosts of entries are written as `host_of` writes them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

BUCKET_DAYS = 64
BROADCAST_ROWS = 500_000
ADDED = ("n_active", "lists", "since", "blocked")


def host_of(url: Column) -> Column:
    """The host in lower case, without user data, port and trailing dots; an IPv6 host with its brackets."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[0-9a-f:.%]+\]|[^/:?#\[\]]+)", 1)
    return F.nullif(F.regexp_replace(host, r"\.+$", ""), F.lit(""))


def prefix_of(url: Column) -> Column:
    """host/first-segment, null without a first segment."""
    return F.nullif(F.concat_ws("/", host_of(url), F.nullif(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://[^/?#]+/([^/?#]+)", 1), F.lit(""))), host_of(url))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, kind, pattern, since, until) from entries (list, kind, pattern, action, day); until is null while active."""
    known = entries.dropna(subset=["list", "kind", "pattern", "action", "day"])
    daily = known.groupBy("list", "kind", "pattern", "day").agg(F.max(F.when(F.col("action") == "remove", 1).otherwise(0)).alias("gone"))
    after = F.lead("day").over(W.partitionBy("list", "kind", "pattern").orderBy("day"))
    return daily.withColumn("until", after).where("gone = 0").select("list", "kind", "pattern", F.col("day").alias("since"), "until")


def evaluate(captures: DataFrame, entries: DataFrame, url: str = "url", day: str = "day") -> DataFrame:
    """Adds n_active, lists, since (earliest entry that is active) and blocked to every capture."""
    asked = captures.select(F.col(url).alias("__url"), F.col(day).cast("long").alias("__day")).where("__url is not null and __day is not null").distinct()
    host = host_of(F.col("__url"))
    # Addresses in brackets have no parent domains.
    labels = F.when(F.startswith(host, F.lit("[")), F.array(host)).otherwise(F.split(host, r"\."))
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    pattern = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("pattern"))
    patterns = F.concat(F.array(pattern("host", host), pattern("prefix", prefix_of(F.col("__url")))), F.transform(parents, lambda p: pattern("domain", p)))
    keyed = asked.where(host.isNotNull()).select("__url", "__day", F.floor(F.col("__day") / BUCKET_DAYS).alias("__b"), F.explode(patterns).alias("__p"))
    keyed = keyed.select("__url", "__day", "__b", "__p.kind", "__p.pattern").where("pattern is not null")
    # A pattern that no entry has - a top-level domain that a third of all captures share - is not dealt out.
    listed = entries.select("kind", "pattern").dropna().distinct()
    keyed = keyed.join(F.broadcast(listed) if listed.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else listed, ["kind", "pattern"], "left_semi")
    last = asked.agg(F.max("__day").alias("__last"), F.min("__day").alias("__first"))
    held = intervals(entries).crossJoin(F.broadcast(last)).where("since <= __last and coalesce(until, __last + 1) > __first")  # one row
    bucket = lambda at: F.floor(at / BUCKET_DAYS)
    until = F.least(F.coalesce(F.col("until") - 1, F.col("__last")), F.col("__last"))
    spread = held.where(until >= F.col("since")).select("list", "kind", "pattern", "since", "until", F.explode(F.sequence(bucket(F.greatest("since", "__first")), bucket(until))).alias("__b"))
    if spread.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        spread = F.broadcast(spread)
    met = keyed.join(spread, ["kind", "pattern", "__b"]).where("since <= __day and (until is null or __day < until)")
    found = met.groupBy("__url", "__day").agg(F.count(F.lit(1)).alias("__n"), F.array_sort(F.collect_set("list")).alias("__lists"), F.min("since").alias("__since"))
    # Columns of the captures that are named as the outcome give way to it.
    kept = captures.select([c for c in captures.columns if c not in ADDED or c in (url, day)])
    out = kept.join(found, (kept[url] == F.col("__url")) & (kept[day].cast("long") == F.col("__day")), "left")
    n, lists = F.coalesce("__n", F.lit(0)).cast("long"), F.coalesce("__lists", F.array().cast("array<string>"))
    made = {"n_active": n, "lists": F.array_join(lists, ","), "since": F.col("__since"), "blocked": (n > 0) & ~F.array_contains(lists, "allow")}
    return out.select(*[F.col(c) for c in kept.columns], *[made[c].alias(c) for c in ADDED])


# Words of the sample list's spam entries, as whole words of a host or path.
SPAM = r"(?<![a-z])(?:casino|bets|pills|win)(?![a-z])"


def capture_days(pages: DataFrame) -> DataFrame:
    """Captures of the pages table, which has no fetch time: the day follows from the page's number."""
    return pages.select("page_id", "url", F.pmod(F.col("page_id") * 17, F.lit(720)).alias("day"))


def sample_entries(pages: DataFrame) -> DataFrame:
    """A dated list that follows from the table's own hosts and first path segments: adds, removals and second adds."""
    number = lambda x, at: F.conv(F.substring(F.md5(x), at, 6), 16, 10).cast("long")
    hosts = pages.select(host_of(F.col("url")).alias("pattern")).where("pattern is not null").distinct().withColumn("kind", F.lit("host"))
    domains = hosts.select(F.substring_index("pattern", ".", -3).alias("pattern")).distinct().withColumn("kind", F.lit("domain"))
    prefixes = pages.select(prefix_of(F.col("url")).alias("pattern")).where("pattern is not null").distinct().withColumn("kind", F.lit("prefix"))
    named = hosts.unionByName(domains).unionByName(prefixes).select("kind", "pattern", F.concat_ws(":", "kind", "pattern").alias("k"))
    named = named.where(number(F.col("k"), 1) % 3 == 0)
    first, gap = number(F.col("k"), 7) % 400, 30 + number(F.col("k"), 13) % 200
    which = F.when(number(F.col("k"), 19) % 5 == 0, "allow").when(F.col("k").rlike(SPAM), "spam").otherwise("block")
    dated = F.array(
        F.struct(F.lit("add").alias("action"), first.alias("day")),
        F.struct(F.lit("remove").alias("action"), (first + gap).alias("day")),
        F.struct(F.lit("add").alias("action"), (first + 2 * gap).alias("day")),
    )
    return named.select(which.alias("list"), "kind", "pattern", F.explode(dated).alias("e")).select("list", "kind", "pattern", "e.action", "e.day")


SQL = r"""
WITH c AS (SELECT page_id, url, (page_id * 17) % 720 AS day,
    nullif(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[0-9a-f:.%]+\]|[^/:?#\[\]]+)', 1), '\.+$', ''), '') AS host,
    nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://[^/?#]+/([^/?#]+)', 1), '') AS seg FROM pages),
h AS (SELECT DISTINCT host AS pattern FROM c WHERE host IS NOT NULL),
pats AS (SELECT 'host' AS kind, pattern FROM h
  UNION SELECT 'domain', array_to_string(list_slice(string_split(pattern, '.'), greatest(1, len(string_split(pattern, '.')) - 2), len(string_split(pattern, '.'))), '.') FROM h
  UNION SELECT 'prefix', host || '/' || seg FROM c WHERE host IS NOT NULL AND seg IS NOT NULL),
k AS (SELECT kind, pattern, kind || ':' || pattern AS k FROM pats),
e AS (SELECT kind, pattern, ('0x' || substr(md5(k), 7, 6))::bigint % 400 AS f, 30 + ('0x' || substr(md5(k), 13, 6))::bigint % 200 AS g,
    CASE WHEN ('0x' || substr(md5(k), 19, 6))::bigint % 5 = 0 THEN 'allow' WHEN regexp_matches(k, '(^|[^a-z])(casino|bets|pills|win)([^a-z]|$)') THEN 'spam' ELSE 'block' END AS list
  FROM k WHERE ('0x' || substr(md5(k), 1, 6))::bigint % 3 = 0),
iv AS (SELECT kind, pattern, list, f AS since, f + g AS until FROM e UNION ALL SELECT kind, pattern, list, f + 2 * g, NULL FROM e),
hp AS (SELECT page_id, url, day, host, CASE WHEN host LIKE '[%' THEN [host] ELSE string_split(host, '.') END AS l FROM c WHERE host IS NOT NULL),
keys AS (SELECT page_id, day, 'host' AS kind, host AS pattern FROM c WHERE host IS NOT NULL
  UNION ALL SELECT page_id, day, 'prefix', host || '/' || seg FROM c WHERE host IS NOT NULL AND seg IS NOT NULL
  UNION ALL SELECT page_id, day, 'domain', array_to_string(list_slice(l, i, len(l)), '.') FROM (SELECT page_id, day, l, unnest(range(1, len(l) + 1)) AS i FROM hp)),
m AS (SELECT page_id, count(*) AS n, string_agg(DISTINCT list, ',' ORDER BY list) AS lists, min(since) AS since
  FROM keys JOIN iv USING (kind, pattern) WHERE since <= day AND (until IS NULL OR day < until) GROUP BY 1)
SELECT c.page_id, c.url, c.day, coalesce(n, 0) AS n_active, coalesce(lists, '') AS lists, since,
  coalesce(n, 0) > 0 AND NOT list_contains(string_split(coalesce(lists, ''), ','), 'allow') AS blocked
FROM c LEFT JOIN m USING (page_id)
"""
