"""URL filters: every capture against the list entries active when it was fetched.

List entries are dated: an entry is active from its ``add`` until the next ``remove``
of the same kind and value, so the dated rows of a value are validity intervals. A
capture asks for all values that could name it: its host and parent domains (kind
``domain``) and the directories of its path (kind ``prefix``). An as-of join finds the
state of each of them at fetch time; the most specific active entry blocks. The join
runs by value and day with a carried state, so one host may hold any share of the
captures. Only DataFrame functions are used.

Defined results: a null or unreadable url, or a null fetch time, is not blocked; rows
equal in page_id, url and fetch time count once; at one instant ``remove`` comes before
``add`` and both before captures; entries with a null value or time count for nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.windows import running_last

SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*://"
HOST = SCHEME + r"(?:[^/?#@]*@)?([^/:?#]+)"
PATH = SCHEME + r"[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, HOST, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, PATH, 1)


def domains(host: Column) -> Column:
    """The host and its parent domains of two labels or more."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
                       lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def directories(host: Column, path: Column) -> Column:
    """Host and path of every directory on the way to the page, each ending in a slash."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
                       lambda i: F.concat(host, F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")))


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``captures`` (page_id, url, fetched) against ``entries`` (kind, value, since, action).

    Returns page_id, url, fetched, blocked, kind, value and active_since of the blocking entry.
    """
    read = captures.select("page_id", "url", "fetched").distinct().withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    usable = F.coalesce((F.col("host") != "") & F.col("fetched").isNotNull(), F.lit(False))
    asked = F.concat(
        F.transform(domains(F.col("host")), lambda d: F.struct(F.lit("domain").alias("kind"), d.alias("value"))),
        F.transform(directories(F.col("host"), F.col("path")), lambda d: F.struct(F.lit("prefix").alias("kind"), d.alias("value"))))
    questions = (read.filter(usable).select("page_id", "url", "fetched", F.explode(asked).alias("k"))
                 .select("k.kind", "k.value", F.col("fetched").alias("at"), F.lit(2).alias("turn"), "page_id", "url"))
    dated = entries.filter("kind is not null and value is not null and since is not null and action in ('add', 'remove')").select(
        "kind", "value", F.col("since").alias("at"), F.when(F.col("action") == "add", 1).otherwise(0).alias("turn")).distinct()
    rows = questions.unionByName(dated, allowMissingColumns=True).withColumn("day", F.to_date("at"))
    state = F.when(F.col("turn") < 2, F.struct(F.col("turn").alias("on"), F.col("at").alias("since")))
    seen = running_last(rows, ["kind", "value"], "day", ["at", "turn"], {"state": state}).filter("turn = 2 and state.on = 1")
    # the longest value is the most specific; a domain beats a directory of equal length
    rank = F.struct(F.length("value").alias("size"), (F.col("kind") == "domain").alias("domain"), "kind", "value", F.col("state.since").alias("since"))
    blocking = seen.groupBy("page_id", "url", F.col("at").alias("fetched")).agg(F.max(rank).alias("b"))
    blocking = blocking.select(F.col("page_id").alias("_p"), F.col("url").alias("_u"), F.col("fetched").alias("_f"), "b")
    match = read["page_id"].eqNullSafe(blocking["_p"]) & (read["url"] == blocking["_u"]) & (read["fetched"] == blocking["_f"])
    return read.join(blocking, match, "left").select(
        "page_id", "url", "fetched", F.col("b").isNotNull().alias("blocked"), "b.kind", "b.value", F.col("b.since").alias("active_since"))


def page_captures(pages: DataFrame) -> DataFrame:
    """Captures of ``pages``, which have no dates: two years, dealt out by page_id."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 7919 % 730).cast("int"))
    return pages.select("page_id", "url", F.timestamp_seconds(F.unix_date(day) * F.lit(86400) + F.col("page_id") % 24 * 3600).alias("fetched"))


def page_entries(pages: DataFrame) -> DataFrame:
    """A dated list from ``pages``: each page adds or removes its host or its first directory at a date of its own."""
    host, parts = host_of(F.col("url")), F.split(path_of(F.col("url")), "/")
    first = F.when(F.size(parts) > 2, F.concat(host, F.lit("/"), F.get(parts, F.lit(1)), F.lit("/"))).otherwise(F.concat(host, F.lit("/")))
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 104729 % 730).cast("int"))
    return pages.filter(host != "").select(
        F.when(F.col("page_id") % 2 == 0, "domain").otherwise("prefix").alias("kind"),
        F.when(F.col("page_id") % 2 == 0, host).otherwise(first).alias("value"),
        F.timestamp_seconds(F.unix_date(day) * F.lit(86400)).alias("since"),
        F.when(F.floor(F.col("page_id") / 2) % 3 == 0, "add").otherwise("remove").alias("action"))


SQL = rf"""
WITH p AS (SELECT DISTINCT page_id, url, lower(regexp_extract(url, '{HOST}', 1)) AS host, regexp_extract(url, '{PATH}', 1) AS path,
                  epoch(DATE '2024-01-01' + (page_id * 7919 % 730)::INT)::BIGINT + page_id % 24 * 3600 AS fetched FROM pages),
e AS (SELECT DISTINCT CASE WHEN page_id % 2 = 0 THEN 'domain' ELSE 'prefix' END AS kind,
             CASE WHEN page_id % 2 = 0 THEN host WHEN len(string_split(path, '/')) > 2 THEN host || '/' || string_split(path, '/')[2] || '/' ELSE host || '/' END AS value,
             epoch(DATE '2024-01-01' + (page_id * 104729 % 730)::INT)::BIGINT AS since,
             CASE WHEN page_id // 2 % 3 = 0 THEN 1 ELSE 0 END AS is_on
      FROM p WHERE host <> ''),
d AS (SELECT kind, value, since, max(is_on) AS is_on FROM e GROUP BY 1, 2, 3),
i AS (SELECT kind, value, is_on, since, lead(since) OVER (PARTITION BY kind, value ORDER BY since) AS till FROM d),
k AS (SELECT page_id, url, fetched, 'domain' AS kind, array_to_string(string_split(host, '.')[n:], '.') AS value
      FROM p, unnest(range(1, greatest(len(string_split(host, '.')), 2))) u(n) WHERE host <> ''
      UNION ALL
      SELECT page_id, url, fetched, 'prefix', host || array_to_string(string_split(path, '/')[1:n], '/') || '/'
      FROM p, unnest(range(1, greatest(len(string_split(path, '/')), 2))) u(n) WHERE host <> ''),
m AS (SELECT k.*, i.since, row_number() OVER (PARTITION BY k.page_id, k.url ORDER BY length(k.value) DESC, k.kind, k.value DESC) AS nth
      FROM k JOIN i ON i.kind = k.kind AND i.value = k.value AND i.since <= k.fetched AND (i.till IS NULL OR k.fetched < i.till) AND i.is_on = 1)
SELECT p.page_id, p.url, p.fetched, m.value IS NOT NULL AS blocked, m.kind, m.value, m.since AS active_since
FROM p LEFT JOIN m ON m.page_id = p.page_id AND m.url = p.url AND m.nth = 1
"""
