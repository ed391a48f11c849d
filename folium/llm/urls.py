"""URL filters over dated lists.

A list says from which date on a domain is blocked or allowed. The entries of
a domain become validity intervals, each from its date to the next one, and a
capture is judged by the intervals that hold on the day it was fetched. The
host's most specific listed suffix decides. Intervals are spread over the
months they touch, so the join is an equi-join on (domain, month) with few
rows to a key however long a domain's history is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Interval rows that may be broadcast; beyond that both sides are shuffled and skewed keys are split at run time.
BROADCAST_ROWS = 500_000


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and final dots; '' where there is none. A scheme may be absent, with its slashes or without."""
    rest = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"^([a-z][a-z0-9+.-]*:)?//", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, r"[/?#].*$", ""), r"^.*@", ""), r"\.*(:[0-9]*)?$", "")


def suffixes(host: Column) -> Column:
    """(domain, labels) of the host and each parent domain."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, i, F.size(parts)), ".").alias("domain"), (F.size(parts) - i + 1).alias("labels")))


def intervals(entries: DataFrame) -> DataFrame:
    """(domain, action, since, until): each dated entry holds until the next one of its domain.

    Of several entries on one day the blocking one counts. Rows with a null
    domain, action or date are no entries.
    """
    clean = entries.select(F.lower("domain").alias("domain"), "action", F.col("since").cast("date").alias("since")).dropna()
    day = clean.groupBy("domain", "since").agg(F.max("action").alias("action"))  # 'allow' < 'block'
    return day.withColumn("until", F.lead("since").over(Window.partitionBy("domain").orderBy("since")))


def judge(captures: DataFrame, entries: DataFrame, keys: list[str], url: str = "url", fetched: str = "fetched") -> DataFrame:
    """One row for each distinct (``keys``, url, date): the deciding domain and action as of the fetch date, and ``blocked``.

    Adds host, matched_domain and action (null where no entry holds) and
    blocked (false then). Null or malformed urls and null dates match nothing.
    Repeated captures come back once. Further columns are ignored.
    """
    rows = captures.select(*[F.col(f"`{k}`").alias(k) for k in keys], F.col(f"`{url}`").alias("url"), F.col(f"`{fetched}`").cast("date").alias("fetched")).withColumn("host", host_of(F.col("url")))
    valid = intervals(entries)
    day = F.col(f"`{fetched}`").cast("date")
    first, last = (F.lit(x).cast("date") for x in captures.agg(F.min(day), F.max(day)).first())
    horizon, begun = last, F.greatest("since", first)  # an interval has no rows for months before the first capture
    months = F.sequence(F.trunc(begun, "month"), F.trunc(F.greatest(F.coalesce(F.least(F.date_sub("until", 1), horizon), horizon), begun), "month"), F.expr("interval 1 month"))
    spread = valid.filter((F.col("since") <= horizon) & (F.col("until").isNull() | (F.col("until") > first))).select("domain", "action", "since", "until", F.explode(months).alias("month"))
    n = spread.count()
    if n <= BROADCAST_ROWS:
        spread = F.broadcast(spread)
    probes = rows.withColumn("s", F.explode_outer(F.when(F.col("host") != "", suffixes(F.col("host"))))).withColumn("month", F.trunc("fetched", "month")).select(*keys, "url", "fetched", "host", "month", F.col("s.domain").alias("domain"), F.col("s.labels").alias("labels"))
    joined = probes.join(spread, ["domain", "month"], "left").withColumn("holds", (F.col("since") <= F.col("fetched")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until"))))
    best = F.max(F.when(F.col("holds"), F.struct("labels", F.col("domain").alias("matched_domain"), "action"))).alias("b")
    out = joined.groupBy(*keys, "url", "fetched", "host").agg(best)
    return out.select(*keys, "url", "fetched", "host", "b.matched_domain", "b.action", (F.coalesce(F.col("b.action"), F.lit("allow")) == "block").alias("blocked"))
