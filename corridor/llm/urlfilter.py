"""URL filters over time: dated list entries become validity intervals, captures are judged as of their fetch.

An event (list, pattern, day, action) switches a pattern on ('add') or off ('remove').  Per list and pattern, an
'add' holds from its day up to the next event's day; of several events on a day the last by ``seq`` counts.  A capture
asks for its URL without query and fragment and for every suffix of its host of two labels or more (for an IP address,
the whole alone), so the as-of join is an equality join on the pattern with the fetch day inside the interval.  A capture is blocked if a pattern
of a 'block' list holds and none of an 'allow' list does.  DataFrame operations only.

Null or malformed URLs, such as those without a scheme, match nothing; null days match nothing; events with a null pattern, day or action are ignored.
Repeated events change nothing; a capture given several times is judged once and returned as often as given, null ids
too.  Other columns of captures and events are ignored; empty tables give empty results or no hits.  A host with very many captures is one side of a join that adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def host(url: Column) -> Column:
    """Lower-case host without user, port and final dot; empty if there is none."""
    authority = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", ""), r"\.$", "")


def patterns(url: Column) -> Column:
    """What a list may name: the host's suffixes and the URL without query and fragment."""
    labels = F.split(host(url), r"\.")
    address = host(url).rlike(r"^([0-9.]+|\[.*)$")
    most = F.when(address, F.lit(1)).otherwise(F.greatest(F.size(labels) - 1, F.lit(1)))  # parts of an address name nothing
    suffixes = F.transform(F.sequence(F.lit(1), most), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    bare = F.regexp_replace(url, r"[?#][\s\S]*$", "")
    return F.when(host(url) != "", F.array_distinct(F.concat(suffixes, F.array(bare)))).otherwise(F.array().cast("array<string>"))


def intervals(events: DataFrame) -> DataFrame:
    """(list, kind, pattern, since, until): since <= day < until; until is null for what still holds."""
    known = events.where("pattern is not null and day is not null and action in ('add', 'remove')")
    daily = known.groupBy("list", "kind", "pattern", "day").agg(F.max_by("action", F.struct("seq", "action")).alias("action"))
    w = Window.partitionBy("list", "kind", "pattern").orderBy("day")
    return daily.withColumn("until", F.lead("day").over(w)).where("action = 'add'").select("list", "kind", "pattern", F.col("day").alias("since"), "until")


def judged(captures: DataFrame, events: DataFrame) -> DataFrame:
    """captures (page_id, url, day) -> with blocks, allows (numbers of entries that hold), first_rule and blocked."""
    rows = captures.select("page_id", "url", "day")
    asked = rows.distinct().select("page_id", "url", "day", F.explode_outer(patterns(F.col("url"))).alias("pattern"))
    held = intervals(events).withColumnRenamed("pattern", "entry")
    on = (asked["pattern"] == held["entry"]) & (asked["day"] >= held["since"]) & (held["until"].isNull() | (asked["day"] < held["until"]))
    hit = asked.join(held, on, "left")
    out = hit.groupBy("page_id", "url", "day").agg(
        F.count_if(F.col("kind") == "block").alias("blocks"),
        F.count_if(F.col("kind") == "allow").alias("allows"),
        F.min(F.when(F.col("kind") == "block", F.concat_ws("|", "list", "entry"))).alias("first_rule"),
    )
    same = [out[c].alias(f"{c}_") for c in rows.columns]
    out = out.select(*same, "blocks", "allows", "first_rule")
    back = rows.join(out, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in rows.columns]).drop(*[f"{c}_" for c in rows.columns])
    return back.withColumn("blocked", (F.col("blocks") > 0) & (F.col("allows") == 0))


def dated_lists(pages: DataFrame) -> DataFrame:
    """The lists of the registered query, by rule from the hosts and URLs of the pages.

    Each host is blocked on a day that its length sets, released 45 days later and blocked again after 90; each
    parent domain is blocked for one month; pages in a file '.html' are allowed from a day their length sets.
    """
    known = pages.select("url", host(F.col("url")).alias("host")).where("host <> ''")
    hosts = known.select("host").distinct().withColumn("start", F.length("host") * 29 % 300)
    steps = F.explode(F.array(*[F.struct(F.lit(k).alias("seq"), F.lit(d).alias("after"), F.lit(a).alias("action")) for k, d, a in ((1, 0, "add"), (2, 45, "remove"), (3, 90, "add"))]))
    spam = hosts.select("host", "start", steps.alias("e")).select(F.lit("hosts").alias("list"), F.lit("block").alias("kind"), F.col("host").alias("pattern"), (F.col("start") + F.col("e.after")).cast("int").alias("day"), F.col("e.action").alias("action"), F.col("e.seq").alias("seq"))
    parent = hosts.select(F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1).alias("pattern")).where("pattern <> ''").distinct().withColumn("start", F.length("pattern") * 17 % 330)
    month = F.explode(F.array(F.struct(F.lit(1).alias("seq"), F.lit(0).alias("after"), F.lit("add").alias("action")), F.struct(F.lit(2).alias("seq"), F.lit(30).alias("after"), F.lit("remove").alias("action"))))
    wide = parent.select("pattern", "start", month.alias("e")).select(F.lit("domains").alias("list"), F.lit("block").alias("kind"), "pattern", (F.col("start") + F.col("e.after")).cast("int").alias("day"), F.col("e.action").alias("action"), F.col("e.seq").alias("seq"))
    bare = known.select(F.regexp_replace("url", r"[?#][\s\S]*$", "").alias("pattern")).where(F.col("pattern").endswith(".html")).distinct()
    good = bare.select(F.lit("files").alias("list"), F.lit("allow").alias("kind"), "pattern", (F.length("pattern") * 7 % 200).cast("int").alias("day"), F.lit("add").alias("action"), F.lit(1).alias("seq"))
    return spam.unionByName(wide).unionByName(good)


ORACLE_SQL = r"""
WITH p AS (SELECT page_id, url, CAST(page_id * 37 % 366 AS INTEGER) AS day,
    regexp_replace(regexp_replace(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', ''), '\.$', '') AS host,
    regexp_replace(url, '[?#][\s\S]*$', '') AS bare FROM pages),
h AS (SELECT DISTINCT host AS pattern FROM p WHERE host <> ''),
d AS (SELECT DISTINCT regexp_extract(pattern, '([^.]+\.[^.]+)$', 1) AS pattern FROM h),
f AS (SELECT DISTINCT bare AS pattern FROM p WHERE host <> '' AND ends_with(bare, '.html')),
ev AS (
  SELECT 'hosts' AS list, 'block' AS kind, pattern, length(pattern) * 29 % 300 + a AS day, act AS action FROM h, (VALUES (0, 'add'), (45, 'remove'), (90, 'add')) v(a, act)
  UNION ALL SELECT 'domains', 'block', pattern, length(pattern) * 17 % 330 + a, act FROM d, (VALUES (0, 'add'), (30, 'remove')) v(a, act) WHERE pattern <> ''
  UNION ALL SELECT 'files', 'allow', pattern, length(pattern) * 7 % 200, 'add' FROM f),
k AS (SELECT DISTINCT page_id, url, day, pattern FROM (
  SELECT page_id, url, day, bare AS pattern FROM p WHERE host <> ''
  UNION ALL SELECT page_id, url, day, array_to_string(string_split(host, '.')[i:], '.') FROM (
    SELECT *, unnest(range(1, CASE WHEN regexp_matches(host, '^([0-9.]+|\[.*)$') THEN 1 ELSE greatest(len(string_split(host, '.')) - 1, 1) END + 1)) AS i FROM p WHERE host <> ''))),
l AS (SELECT DISTINCT list, kind FROM ev),
hit AS (SELECT k.page_id, k.url, k.day, l.list, l.kind, k.pattern, ev.action
  FROM (SELECT * FROM k, l) k JOIN l USING (list, kind)
  ASOF JOIN ev ON ev.list = k.list AND ev.kind = k.kind AND ev.pattern = k.pattern AND ev.day <= k.day),
g AS (SELECT page_id, url, count(*) FILTER (WHERE kind = 'block') AS blocks, count(*) FILTER (WHERE kind = 'allow') AS allows,
  min(list || '|' || pattern) FILTER (WHERE kind = 'block') AS first_rule FROM hit WHERE action = 'add' GROUP BY ALL)
SELECT p.page_id, p.url, p.day, CAST(coalesce(blocks, 0) AS BIGINT) AS blocks, CAST(coalesce(allows, 0) AS BIGINT) AS allows, first_rule,
  coalesce(blocks, 0) > 0 AND coalesce(allows, 0) = 0 AS blocked
FROM p LEFT JOIN g USING (page_id, url)
"""
