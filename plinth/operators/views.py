"""Published views: listings, next meeting, search, sections, rosters, bylines, redirects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions import text as X
from plinth.functions.dates import term_rank


def archive(talks: DataFrame) -> DataFrame:
    """Rows of no special kind that have a title; an empty title is a title."""
    return talks.where(F.col("kind").isNull() & F.col("title").isNotNull())


def upcoming(talks: DataFrame, as_of: str) -> DataFrame:
    """Listed from a given day on; the day is an argument, never today."""
    return archive(talks).where(F.col("date") >= F.lit(as_of).cast("date"))


def next_one(talks: DataFrame, as_of: str, order: list[Column]) -> DataFrame:
    return upcoming(talks, as_of).orderBy(*order).limit(1)


def matches(haystack: Column, query: str) -> Column:
    """Substring search on plain lower case; an empty query matches everything; wildcards have no meaning."""
    q = query.strip().lower()
    return F.lit(True) if not q else F.coalesce(F.contains(haystack, F.lit(q)), F.lit(False))


def shown(sections: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    return sections.join(hits.select(key).distinct(), key, "left_semi")


def hidden(sections: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    return sections.join(hits.select(key).distinct(), key, "left_anti")


def ordered_terms(terms: DataFrame, key: str) -> DataFrame:
    return terms.orderBy(term_rank(F.col(key)).desc(), F.col(key))


def byline(talks: DataFrame, id_: str, speakers: str, people: DataFrame) -> DataFrame:
    """Names in order, '(affiliation)' where the person is not on the roster, the slug where nobody is known."""
    s = talks.select(id_, F.posexplode(speakers).alias("pos", "slug"))
    j = s.join(people.select("slug", "name", "roster", "affiliation"), "slug", "left")
    name = F.coalesce("name", "slug")
    one = F.when(F.col("roster").isNull() & F.col("affiliation").isNotNull(), F.concat(name, F.lit(" ("), F.col("affiliation"), F.lit(")"))).otherwise(name)
    g = j.groupBy(id_).agg(F.array_sort(F.collect_list(F.struct("pos", one.alias("n")))).alias("_l"))
    return g.select(id_, F.array_join(F.transform("_l", lambda x: x["n"]), ", ").alias("byline"))


def roster_groups(people: DataFrame, group: str, name: str) -> DataFrame:
    """Members of each group by the last word of the name."""
    last = F.element_at(F.split(F.col(name), " "), -1)
    g = people.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(last.alias("k"), F.col(name).alias("n")))).alias("_l"))
    return g.select(group, F.array_join(F.transform("_l", lambda x: x["n"]), "; ").alias("members"))


def details_shown(room: Column, default_room: Column, time: Column, default_time: Column, weekday: Column) -> Column:
    """Whether a row shows room and time. Reads right to left: a missing room hides a differing time."""
    return F.coalesce(room.isNotNull() & ((room != default_room) | (time.isNotNull() & ((time != default_time) | weekday.isNotNull()))), F.lit(False))


def redirects(talks: DataFrame, url: str, date: str, slug: str, label: Column) -> DataFrame:
    """Every spelling of every legacy url with the anchor it leads to."""
    return talks.select(F.explode(X.both_paddings(F.col(url))).alias("url"), F.concat(F.lit("/archive.html#"), X.anchor(F.col(date), F.col(slug))).alias("target"), label.alias("label"))


def is_break(kind: Column) -> Column:
    """Rows that say there is no meeting; an open date is none."""
    return F.coalesce(kind.isin("no_meeting", "cancelled"), F.lit(False))


def roster_people(roster: DataFrame, people: DataFrame, member: str, key: str) -> DataFrame:
    """Members of a roster with their record; members nobody knows are left out."""
    return roster.join(people, F.col(member) == F.col(key)).drop(key)


def gate(rows: DataFrame, what: str, least: int) -> DataFrame:
    """(what, n, least, ok): whether there are as many rows as a publication must have."""
    return rows.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n", F.lit(least).alias("least"), (F.col("n") >= least).alias("ok"))
