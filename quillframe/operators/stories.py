"""Reading orders over the catalog: complete stories, neighbours, chapters, votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Positions of judges.
POSITIONS = {"majority": "Mengikuti putusan", "concurring": "Alasan berbeda", "dissenting": "Pendapat berbeda", "unverified": "Belum diverifikasi"}
UNVERIFIED = "unverified"


def complete_stories(stories: DataFrame, entries: DataFrame, cases: DataFrame, story: str = "slug", number: str = "case_number") -> DataFrame:
    """Stories that have entries, all of whose entries are in the catalog: relational division by two joins on keys."""
    known = cases.select(F.col(number).alias("_n")).distinct()
    broken = entries.join(known, F.col(number) == F.col("_n"), "left_anti").select(story).distinct()
    return stories.join(entries.select(story).distinct(), story, "left_semi").join(broken, story, "left_anti")


def story_entries(entries: DataFrame, summaries: DataFrame, number: str = "case_number", position: str = "pos") -> DataFrame:
    """Entries with their case's summary; of several cases with one number the last counts."""
    last = summaries.groupBy(number).agg(F.max_by(F.struct(*[c for c in summaries.columns if c != number]), F.col(position)).alias("_s")).select(F.col(number).alias("_n"), "_s.*")
    return entries.join(last, F.col(number) == F.col("_n")).drop("_n")


def neighbours(entries: DataFrame, story: str, order: str, value: str) -> DataFrame:
    """Entries with the value of the one before and the one after in their story, their number in it, and its size."""
    w = Window.partitionBy(story).orderBy(order)
    return entries.withColumns({
        "number": F.row_number().over(w),
        "entries": F.count(F.lit(1)).over(Window.partitionBy(story)),
        "previous": F.lag(value).over(w),
        "next": F.lead(value).over(w),
    })


def chapters(entries: DataFrame, groups: DataFrame, story: str = "slug", chapter: str = "chapter") -> DataFrame:
    """Chapters with the number of their entries, none included."""
    counts = entries.groupBy(story, chapter).agg(F.count(F.lit(1)).alias("n"))
    return groups.join(counts, [story, chapter], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def with_positions(judges: DataFrame, positions: DataFrame, keys: list[str], known: list[str] | None = None) -> DataFrame:
    """Judges with their recorded position; names without one, and unknown kinds, are unverified."""
    known = known or list(POSITIONS)
    kind = F.when(F.col("position").isin(known), F.col("position")).otherwise(UNVERIFIED)
    return judges.join(positions, keys, "left").withColumn("position", kind)


def tally(judges: DataFrame, keys: list[str]) -> DataFrame:
    """Judges of each position."""
    return judges.groupBy(*keys, "position").agg(F.count(F.lit(1)).alias("n"))


def split_dictum(dictum: Column, provisional: Column) -> Column:
    """struct<provisional, merits>: the first so many items, and the rest."""
    n = F.coalesce(provisional, F.lit(0))
    return F.struct(F.slice(dictum, F.lit(1), n).alias("provisional"), F.slice(dictum, n + 1, F.greatest(F.size(dictum) - n, F.lit(0))).alias("merits"))


def insight_rows(insights: DataFrame, kind: str, number: str = "case_number") -> DataFrame:
    """Rows of one of an insight's tables (``reasoning`` or ``thresholds.rows``), in order."""
    return insights.select(number, F.posexplode(F.col(kind)).alias("pos", "item"))


def insight_changes(insights: DataFrame, number: str = "case_number") -> DataFrame:
    """(number, before, after, pages) of the insights that tell a change; of ``pages`` and ``page`` the first that is there, without empty ones."""
    change = F.col("change")
    pages = F.filter(F.coalesce(change["pages"], F.array(change["page"])), lambda p: p.isNotNull() & (p != 0))
    return insights.where(change.isNotNull()).select(number, change["before"].alias("before"), change["after"].alias("after"), pages.alias("pages"))


def insight_thresholds(insights: DataFrame, number: str = "case_number") -> DataFrame:
    """(number, page, pos, cells): the rows of the insights' tables of thresholds, in order."""
    return insights.where(F.col("thresholds").isNotNull()).select(number, F.col("thresholds.page").alias("page"), F.posexplode("thresholds.rows").alias("pos", "cells"))


def citations(insights: DataFrame, number: str = "case_number", label: str = "PDF hlm. ") -> DataFrame:
    """(number, part, pos, page, label): every page that an insight cites, by part: its change, reasoning, thresholds, court and the positions of its judges. No or zero pages aren't citations."""
    pages = lambda part, found: F.transform(F.coalesce(found, F.array().cast("array<int>")), lambda p, i: F.struct(F.lit(part).alias("part"), i.alias("pos"), p.cast("int").alias("page")))
    change = F.coalesce(F.col("change.pages"), F.array("change.page"))
    every = F.concat(pages("change", change), pages("reasoning", F.col("reasoning.page")), pages("thresholds", F.array("thresholds.page")), pages("court", F.array("court.page")), pages("positions", F.col("court.positions.page")))
    rows = insights.select(number, F.explode(F.filter(every, lambda c: c["page"].isNotNull() & (c["page"] != 0))).alias("c"))
    return rows.select(number, "c.part", "c.pos", "c.page", F.concat(F.lit(label), F.col("c.page").cast("string")).alias("label"))


def story_cards(stories: DataFrame, entries: DataFrame, slug: str = "slug") -> DataFrame:
    """Stories with what their card shows: how many entries and chapters they have; stories without entries show none."""
    counts = entries.groupBy(slug).agg(F.count(F.lit(1)).alias("n_entries"), F.count_distinct("chapter").alias("n_chapters"))
    return stories.join(counts, slug, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_entries", "n_chapters")})
