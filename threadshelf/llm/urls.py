"""URL filters: dated list entries become validity intervals, captures meet those of their time.

Only joins, windows and column expressions. Captures are first reduced to their distinct hosts
and days, so a host that holds a third of all captures has one row per day, with the entries
that hold at any time of it; intervals are laid out by month, so that the join is on keys with at
most a month's entries each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType

from threadshelf.plans.lineage import cut

# What an entry does to its domain, the strictest first.
ACTIONS = ("block", "allow", "remove")
LAST_DAY = "9999-12-31"


def clean_host(name: Column) -> Column:
    """A host or domain as both sides are compared: percent signs decoded, in lower case, without
    white space around it and without final dots; null if nothing is left."""
    # `+` stands for itself in a host; what cannot be decoded stays as it is
    plain = F.coalesce(F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), name)
    plain = F.lower(F.regexp_replace(plain, r"^[\s\x00-\x20]+|[\s\x00-\x20]+$", ""))
    return F.nullif(F.regexp_replace(plain, r"\.+$", ""), F.lit(""))


def host(url: Column) -> Column:
    """The host of a URL, as `clean_host` gives it, without user and port; null if there is none.

    As readers of URLs do, a backslash counts as a slash, tabs and line breaks as nothing, and
    the user ends at the last `@`; an address in brackets is one host.
    """
    plain = F.translate(F.trim(F.regexp_replace(url, r"[\t\r\n]", "")), "\\", "/")
    authority = F.regexp_extract(plain, r"^[A-Za-z][A-Za-z0-9+.-]*:/+([^/?#]*)", 1)
    place = F.regexp_replace(authority, r"(?s)^.*@", "")
    return clean_host(F.regexp_extract(place, r"^(\[[^\]]*\]|[^:]*)", 1))


def domains(name: Column) -> Column:
    """The host and all domains above it, as (domain, labels)."""
    labels = F.split(name, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.struct(
            F.array_join(F.slice(labels, i, F.size(labels) - i + 1), ".").alias("domain"), (F.size(labels) - i + 1).alias("labels")
        ),
    )


def moment(df: DataFrame, column: str) -> Column:
    """A time, or the midnight a day begins with."""
    return df[column].cast("timestamp")


def intervals(log: DataFrame) -> DataFrame:
    """(domain, action, since, until) from a log of (domain, action, listed_on).

    An entry holds from its time, or from the start of its day where the log has days, until the
    domain's next one; `remove` ends what was there. Of entries of one time the strictest counts.
    Entries without domain, action or time, and with an unknown action, say nothing.
    """
    rank = F.array_position(F.array(*map(F.lit, ACTIONS)), F.col("action"))
    dated = (
        log.select(clean_host(F.col("domain").cast("string")).alias("domain"), rank.alias("rank"), moment(log, "listed_on").alias("since"))
        .where("domain IS NOT NULL AND rank > 0 AND since IS NOT NULL")
        .groupBy("domain", "since").agg(F.min("rank").alias("rank"))
    )
    following = F.lead("since").over(Window.partitionBy("domain").orderBy("since"))
    held = dated.withColumn("until", F.coalesce(following, F.lit(LAST_DAY).cast("timestamp")))
    action = F.element_at(F.array(*map(F.lit, ACTIONS)), F.col("rank").cast("int"))
    return held.select("domain", action.alias("action"), "since", "until").where("action <> 'remove'")


def verdicts(days: DataFrame, held: DataFrame) -> DataFrame:
    """(host, day, entries): the entries of the host and the domains above it that hold at any
    time of the day, as (labels, action, domain, since, until), for each (host, day) that has any."""
    month = lambda c: F.trunc(c, "month")
    asked = days.withColumn("d", F.explode(domains(F.col("host")))).select(
        "host", "day", F.col("d.domain").alias("domain"), F.col("d.labels").alias("labels"), month("day").alias("month")
    )
    first, last = asked.agg(F.min("month"), F.max("month")).first()
    if first is None:
        first = last = F.lit(None).cast("date")
    # an interval is laid out only over months that are asked for
    spread = held.where((F.col("until") > F.lit(first)) & (F.col("since") < F.add_months(F.lit(last), 1))).withColumn(
        "month",
        F.explode(
            F.sequence(
                F.greatest(month("since"), F.lit(first)),
                F.least(month(F.expr("until - interval 1 microsecond")), F.lit(last)), F.expr("interval 1 month"),
            )
        ),
    )
    return (
        asked.join(cut(spread), ["domain", "month"])
        .where("since < date_add(day, 1) AND day < until")
        .groupBy("host", "day")
        .agg(F.collect_list(F.struct("labels", "action", "domain", "since", "until")).alias("entries"))
    )


def filter_captures(captures: DataFrame, log: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """(id, host, fetched_on, verdict, listed_domain, listed_on) of every capture.

    The verdict is that of the list as it stood at the time of the fetch, or at the end of its day
    where captures have days only; `none` where no entry was active, the host cannot be told or
    the time is null. A more specific domain wins. `listed_on` is a day where the log has days,
    else a time.
    """
    at = moment(captures, time_col)
    if captures.schema[time_col].dataType == DateType():
        at = F.date_add(captures[time_col], 1).cast("timestamp") - F.expr("interval 1 microsecond")
    asked = captures.select(
        F.col(id_col), host(F.col(url_col)).alias("host"), F.to_date(F.col(time_col)).alias("day"), at.alias("at")
    )
    days = cut(asked.where("host IS NOT NULL AND day IS NOT NULL").select("host", "day").distinct())
    told = cut(verdicts(days, intervals(log)))
    active = F.array_max(F.filter("entries", lambda e: (e["since"] <= F.col("at")) & (F.col("at") < e["until"])))
    listed = "date" if log.schema["listed_on"].dataType == DateType() else "timestamp"
    return asked.join(told, ["host", "day"], "left").withColumn("m", active).select(
        id_col, "host", F.col("day").alias("fetched_on"), F.coalesce("m.action", F.lit("none")).alias("verdict"),
        F.col("m.domain").alias("listed_domain"), F.col("m.since").cast(listed).alias("listed_on"),
    )
