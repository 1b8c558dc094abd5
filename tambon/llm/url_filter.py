"""URL filtering against dated lists: an as-of join of captures with validity intervals.

A list is a log of dated entries (pattern, action `add` or `remove`, day). A pattern is a domain
(`d:example.org`, for it and all below it) or a folder (`p:example.org/docs`, for the paths below
it). An entry holds from its day until the day of the pattern's next entry; on one day, a removal
comes after an addition. A capture is fetched on a day; its URL is broken into every pattern that could list it,
one for each label of the host and one for each folder down to the greatest depth that any listed folder has; these meet the intervals on
equality, and the day decides. All of it is DataFrame functions: nothing leaves the JVM.

No step gathers the rows of a host: a capture's patterns are its own rows, the join's other side has
a few intervals a pattern (Spark splits a hot pattern's captures), and hits are summed before they are shuffled
by capture.

Defined cases: a null URL, or one without `scheme://host`, is never blocked and has a null host; a
null day matches nothing; entries with a null part are ignored, repeated ones count once; captures are returned
a row for each row, equal ones with equal answers; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import only, read_table

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"


def validity(entries: DataFrame) -> DataFrame:
    """(pattern, action, day) to (pattern, valid_from, valid_to) of the times when a pattern is listed; valid_to is excluded, null for ever."""
    log = only(entries, pattern="string", action="string", day="date").where("pattern is not null and day is not null and action in ('add', 'remove')")
    # The last word of a day: a removal beats an addition.
    daily = log.groupBy("pattern", "day").agg(F.max("action").alias("action"))
    then = F.lead("day").over(Window.partitionBy("pattern").orderBy("day"))
    return daily.withColumn("valid_to", then).where("action = 'add'").select("pattern", F.col("day").alias("valid_from"), "valid_to")


def with_host(captures: DataFrame) -> DataFrame:
    host = F.regexp_replace(F.lower(F.nullif(F.regexp_extract("url", HOST, 1), F.lit(""))), r"^www\.|\.+$", "")
    return captures.withColumn("host", F.nullif(host, F.lit("")))


def patterns(deepest: F.Column) -> F.Column:
    """All patterns that could list the capture, with at most so many folders: an array."""
    labels = F.split("host", r"\.")
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("d:"), F.array_join(F.slice(labels, i, n - i + 1), ".")))
    folders = F.filter(F.split(F.regexp_extract("url", PATH, 1), "/"), lambda x: x != "")
    depth = F.least(F.size(folders), deepest)
    paths = F.when(depth > 0, F.transform(F.sequence(F.lit(1), depth), lambda i: F.concat(F.lit("p:"), F.col("host"), F.lit("/"), F.array_join(F.slice(folders, 1, i), "/")))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(domains, paths))


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """From (page_id, url, fetched) and (pattern, action, day): page_id, url, fetched, host, blocked, n_patterns, pattern (the longest that blocks)."""
    rows = with_host(only(captures, page_id="long", url="string", fetched="date"))
    lists = validity(entries)
    deepest = lists.where("pattern like 'p:%'").agg(F.coalesce(F.max(F.size(F.split("pattern", "/")) - 1), F.lit(0)).alias("deepest"))  # one row
    asked = rows.where("host is not null and fetched is not null").distinct().crossJoin(F.broadcast(deepest)).withColumn("pattern", F.explode(patterns(F.col("deepest")))).drop("deepest")
    active = (F.col("fetched") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched") < F.col("valid_to")))
    hits = asked.join(lists, "pattern").where(active)
    best = hits.groupBy("page_id", "url", "fetched").agg(F.count("*").alias("n_patterns"), F.max_by("pattern", F.struct(F.length("pattern"), "pattern")).alias("pattern"))
    found = best.select(F.col("page_id").alias("_id"), F.col("url").alias("_url"), F.col("fetched").alias("_day"), "n_patterns", "pattern")
    same = F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("url") == F.col("_url")) & (F.col("fetched") == F.col("_day"))
    out = rows.join(found, same, "left")
    return out.select("page_id", "url", "fetched", "host", F.col("n_patterns").isNotNull().alias("blocked"), F.coalesce("n_patterns", F.lit(0).cast("long")).alias("n_patterns"), "pattern")


def dated(pages: DataFrame) -> DataFrame:
    """Captures of the pages table, which has no dates: a page is fetched page_id mod 365 days after 2024-01-01."""
    rows = only(pages, page_id="long", url="string")
    return rows.withColumn("fetched", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(365)).cast("int")))


def example_lists(pages: DataFrame) -> DataFrame:
    """Dated entries made from the pages' own hosts by a rule, since no list is among the tables.

    A host whose first page has an even id is listed from day (id mod 200), taken off 60 days later if the id is also a multiple of 4, and listed again 120 days
    after that if a multiple of 8. The folder of a host's first page (in any one language) is listed from day 30 if its first page's id is a multiple of 5.
    """
    rows = with_host(only(pages, page_id="long", url="string")).where("host is not null and page_id is not null")
    start = F.lit("2024-01-01").cast("date")
    day = lambda n: F.date_add(start, n.cast("int"))
    hosts = rows.groupBy("host").agg(F.min("page_id").alias("id")).where("id % 2 = 0").withColumn("at", F.pmod("id", F.lit(200)))
    pattern = F.concat(F.lit("d:"), F.col("host")).alias("pattern")
    added = hosts.select(pattern, F.lit("add").alias("action"), day(F.col("at")).alias("day"))
    removed = hosts.where("id % 4 = 0").select(pattern, F.lit("remove").alias("action"), day(F.col("at") + 60).alias("day"))
    again = hosts.where("id % 8 = 0").select(pattern, F.lit("add").alias("action"), day(F.col("at") + 180).alias("day"))
    folder = F.regexp_extract("url", PATH.replace("(/[^?#]*)", "/([^/?#]+)"), 1)
    folders = rows.withColumn("folder", folder).where("folder <> ''").groupBy("host", "folder").agg(F.min("page_id").alias("id")).where("id % 5 = 0")
    return added.union(removed).union(again).union(folders.select(F.concat(F.lit("p:"), F.col("host"), F.lit("/"), F.col("folder")), F.lit("add"), day(F.lit(30))))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return judge(dated(pages), example_lists(pages))


OP9_SQL = r"""
with captures as (
  select page_id, url, (date '2024-01-01' + cast(((page_id % 365) + 365) % 365 as integer)) as fetched,
    nullif(regexp_replace(regexp_replace(lower(nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '')), '^www\.', ''), '\.+$', ''), '') as host,
    list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/'), lambda x: x <> '') as folders
  from pages
), hosts as (
  select host, min(page_id) as id from captures where host is not null group by host having min(page_id) % 2 = 0
), first_folders as (
  select host, folders[1] as folder, min(page_id) as id from captures where host is not null and len(folders) > 0 group by host, folders[1] having min(page_id) % 5 = 0
), entries as (
  select 'd:' || host as pattern, 'add' as action, date '2024-01-01' + cast(id % 200 as integer) as day from hosts
  union select 'd:' || host, 'remove', date '2024-01-01' + cast(id % 200 + 60 as integer) from hosts where id % 4 = 0
  union select 'd:' || host, 'add', date '2024-01-01' + cast(id % 200 + 180 as integer) from hosts where id % 8 = 0
  union select 'p:' || host || '/' || folder, 'add', date '2024-01-31' from first_folders
), daily as (
  select pattern, day, max(action) as action from entries group by pattern, day
), spans as (
  select pattern, day as valid_from, action, lead(day) over (partition by pattern order by day) as valid_to from daily
), asked as (
  select distinct page_id, url, fetched, unnest(list_distinct(list_concat(
    list_transform(generate_series(1, len(string_split(host, '.'))), lambda i: 'd:' || array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.')),
    list_transform(generate_series(1, least(len(folders), 2)), lambda i: 'p:' || host || '/' || array_to_string(list_slice(folders, 1, i), '/'))))) as pattern
  from captures where host is not null
), hits as (
  select a.page_id, a.url, a.fetched, count(*) as n, max_by(a.pattern, lpad(cast(length(a.pattern) as varchar), 8, '0') || a.pattern) as pattern
  from asked a join spans s on a.pattern = s.pattern and s.action = 'add' and a.fetched >= s.valid_from and (s.valid_to is null or a.fetched < s.valid_to)
  group by 1, 2, 3
)
select c.page_id, c.url, c.fetched, c.host, h.n is not null as blocked, coalesce(h.n, 0) as n_patterns, h.pattern
from captures c left join hits h on c.page_id = h.page_id and c.url = h.url and c.fetched = h.fetched
"""
