"""URL filters by a temporal list join, with native plans only.

A list has dated entries: from ``day`` on, an ``action`` (block, allow or remove) holds for a ``key`` of a
``kind`` (path: host and first path segment; host; domain: the host's registrable name, which is its last
two labels, or three where the last two are a public suffix such as ``co.uk``; addresses have none). Entries of a key
become validity intervals [day, day of its next entry). A capture joins, kind by kind, the one interval
of its key that covers its fetch day. The most specific kind with an active block or allow decides.

Lists of at most ``BOUND`` intervals are broadcast, which the plan checks by counting; longer ones are
joined by key and salt, so that a host with a third of all captures is spread over ``SALT`` tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

KINDS = ("path", "host", "domain")
BOUND, SALT = 200_000, 32


#: Second-level labels that make a public suffix with a country code: fixed values.
SUFFIXES = "ac co com edu gov net or org"
_AGAIN = "|".join(SUFFIXES.split())
HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/?#:]*)"
PATH = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^/?#]*)"
#: Hosts without a registrable name: addresses, and public suffixes themselves.
NAMELESS = rf"^(?:\[.*|[0-9]+(?:\.[0-9]+){{3}}|(?:{_AGAIN})\.[a-z]{{2}})$"
DOMAIN = rf"([^.]+\.(?:(?:{_AGAIN})\.[a-z]{{2}}|[^.]+))$"


def url_host(url: Column) -> Column:
    """Lower-case host without trailing dots, in brackets if it is an IPv6 address; empty where there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.+$", "")


def url_keys(url: Column) -> dict[str, Column]:
    host = url_host(url)
    some = lambda c: F.when(F.length(c) > 0, c)
    path = F.regexp_extract(url, PATH, 1)
    domain = F.when(~host.rlike(NAMELESS), some(F.regexp_extract(host, DOMAIN, 1)))
    return {"path": F.when((F.length(host) > 0) & (F.length(path) > 0), F.concat(host, path)), "host": some(host), "domain": domain}


def intervals(entries: DataFrame) -> DataFrame:
    """(kind, key, action, since, until) from (kind, key, action, day). Of entries of one day block beats allow beats remove."""
    e = entries.filter("kind is not null and key is not null and day is not null").filter(F.col("action").isin("block", "allow", "remove"))
    rank = F.when(F.col("action") == "block", 2).when(F.col("action") == "allow", 1).otherwise(0)
    one = e.groupBy("kind", "key", "day").agg(F.max(rank).alias("r"))
    w = Window.partitionBy("kind", "key").orderBy("day")
    named = F.when(F.col("r") == 2, "block").when(F.col("r") == 1, "allow").otherwise("remove")
    return one.select("kind", "key", named.alias("action"), F.col("day").alias("since"), F.lead("day").over(w).alias("until"))


def filter_urls(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", day_col: str = "day", bound: int = BOUND) -> DataFrame:
    """(id, host, day, verdict, kind, key, since) for each capture.

    ``verdict`` is block, allow or none; ``kind``, ``key`` and ``since`` tell which entry decided. Null or
    malformed URLs have a null host and match nothing, as have captures without a fetch day. Repeated
    captures are each judged. Entries with a null field or unknown action are ignored. Other columns are
    ignored.
    """
    valid = cut(intervals(entries))  # read once a kind below
    small = valid.count() <= bound
    keys = url_keys(F.col(url_col))
    rows = captures.select(F.col(id_col).alias("id"), F.col(day_col).cast("int").alias("day"), *[c.alias(k) for k, c in keys.items()])
    if not small:
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int"))
    for kind in KINDS:
        side = valid.filter(F.col("kind") == kind).select(F.col("key").alias(f"{kind}_key"), F.col("action").alias(f"{kind}_action"), F.col("since").alias(f"{kind}_since"), F.col("until").alias(f"{kind}_until"))
        on = (F.col(kind) == F.col(f"{kind}_key")) & (F.col("day") >= F.col(f"{kind}_since")) & (F.col(f"{kind}_until").isNull() | (F.col("day") < F.col(f"{kind}_until")))
        if small:
            side = F.broadcast(side)  # counted above: at most ``bound`` rows
        else:
            side = side.withColumn("side_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
            on = on & (F.col("salt") == F.col("side_salt"))
        rows = rows.join(side, on, "left").drop("side_salt")
    decides = [F.col(f"{k}_action").isin("block", "allow") for k in KINDS]
    pick = lambda name: F.coalesce(*[F.when(d, F.col(f"{k}_{name}")) for d, k in zip(decides, KINDS)])
    kind = F.coalesce(*[F.when(d, F.lit(k)) for d, k in zip(decides, KINDS)])
    return rows.select("id", F.col("host"), "day", F.coalesce(pick("action"), F.lit("none")).alias("verdict"), kind.alias("kind"), pick("key").alias("key"), pick("since").alias("since"))


def dated_list(pages: DataFrame) -> DataFrame:
    """A list made from the table's own hosts, domains and paths, by fixed rules on their MD5, in one pass."""
    keys = url_keys(F.col("url"))
    rules = (("path", 40, 1), ("host", 5, 5), ("domain", 9, 9))
    named = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), keys[kind].alias("key"), F.lit(most).alias("most"), F.lit(at).alias("at")) for kind, most, at in rules])).alias("x")
    k = pages.select(named).select("x.*").filter("key is not null").distinct()
    n = lambda plus: F.conv(F.substring(F.md5(F.col("key").cast("binary")), F.col("at") + plus, F.lit(4)), 16, 10).cast("int")
    k = k.filter(n(0) % F.col("most") == 0).withColumn("day", n(12) % 200)
    first = F.struct(F.when(n(8) % 4 == 0, "allow").otherwise("block").alias("action"), F.col("day"))
    later = F.struct(F.when(n(16) % 2 == 0, "remove").otherwise("allow").alias("action"), (F.col("day") + 30 + n(20) % 90).alias("day"))
    both = F.explode(F.when(n(16) % 3 != 0, F.array(first, later)).otherwise(F.array(first))).alias("e")
    return k.select("kind", "key", both).select("kind", "key", "e.action", "e.day")


def op9_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").withColumn("day", F.pmod("page_id", F.lit(365)).cast("int"))
    return filter_urls(pages, dated_list(pages)).withColumnRenamed("id", "page_id")


def _sql_list(kind: str, column: str, most: int, at: int) -> str:
    n = lambda i: f"CAST('0x' || substr(md5(key), {i}, 4) AS INT)"
    return f"""
  {kind}_first AS (SELECT '{kind}' AS kind, key, CASE WHEN {n(at + 8)} % 4 = 0 THEN 'allow' ELSE 'block' END AS action, {n(at + 12)} % 200 AS day
    FROM (SELECT DISTINCT {column} AS key FROM c WHERE {column} IS NOT NULL) WHERE {n(at)} % {most} = 0),
  {kind}_all AS (SELECT * FROM {kind}_first UNION ALL
    SELECT kind, key, CASE WHEN {n(at + 16)} % 2 = 0 THEN 'remove' ELSE 'allow' END, day + 30 + {n(at + 20)} % 90 FROM {kind}_first WHERE {n(at + 16)} % 3 <> 0),
  {kind}_valid AS (SELECT key, action, day AS since, lead(day) OVER (PARTITION BY key ORDER BY day) AS until FROM {kind}_all)"""


_ON = "ON {k}_valid.key = c.{k} AND c.day >= {k}_valid.since AND (c.day < {k}_valid.until OR {k}_valid.until IS NULL)"
_DECIDES = {k: f"{k}_valid.action IN ('block', 'allow')" for k in KINDS}
_PICK = {what: "CASE " + " ".join(f"WHEN {_DECIDES[k]} THEN {value.format(k=k)}" for k in KINDS) + " END" for what, value in (("verdict", "{k}_valid.action"), ("kind", "'{k}'"), ("key", "{k}_valid.key"), ("since", "{k}_valid.since"))}
OP9_SQL = f"""
WITH h AS (SELECT page_id, url, CAST(page_id % 365 AS INT) AS day,
    regexp_replace(lower(regexp_extract(url, '{HOST}', 1)), '\\.+$', '') AS h, regexp_extract(url, '{PATH}', 1) AS p FROM pages),
  c AS (SELECT page_id, day, nullif(h, '') AS host, CASE WHEN h <> '' AND p <> '' THEN h || p END AS path,
    CASE WHEN NOT regexp_matches(h, '{NAMELESS}') THEN nullif(regexp_extract(h, '{DOMAIN}', 1), '') END AS domain FROM h),
  {_sql_list("path", "path", 40, 1)},{_sql_list("host", "host", 5, 5)},{_sql_list("domain", "domain", 9, 9)}
SELECT page_id, host, c.day AS day, coalesce({_PICK["verdict"]}, 'none') AS verdict, {_PICK["kind"]} AS kind, {_PICK["key"]} AS key, {_PICK["since"]} AS since
FROM c {" ".join(f"LEFT JOIN {k}_valid {_ON.format(k=k)}" for k in KINDS)}
"""
