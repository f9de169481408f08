"""Filtering, ranking, excerpts, sorting, paging and facets over flat rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.search_text import Query, matches_reference

# Weights of the fields, of a matched case reference, and the shape of an excerpt.
REFERENCE_SCORE, REFERENCE_WEIGHT = 1000, 120
EXCERPT_BEFORE, EXCERPT_CHARS = 75, 240
PAGE_SIZE, RELATED = 20, 3
STATUS_ORDER = ["failed", "partial", "ok"]


@dataclass(frozen=True)
class Field:
    """A searched field: its label, the text shown, the text searched, its weight, and whether it is a translation."""

    label: str
    shown: Column
    searched: Column
    weight: int
    translated: bool = False


def contains_all(terms: Sequence[str], *texts: Column) -> Column:
    """Whether every term is a substring of one of the texts."""
    out = F.lit(True)
    for term in terms:
        here = F.lit(False)
        for text in texts:
            here = here | F.coalesce(text.contains(term), F.lit(False))
        out = out & here
    return out


def filter_rows(df: DataFrame, query: Query | None = None, equal: dict[str, str] | None = None, member: dict[str, str] | None = None, review_only: bool = False, texts: Sequence[str] = ("_normalized_search_text", "_english_search_text")) -> DataFrame:
    """Conjunction of equalities, memberships in array columns, the review switch, a case reference and search terms; empty values are off."""
    for column, value in (equal or {}).items():
        if value:
            df = df.where(F.col(column) == value)
    for column, value in (member or {}).items():
        if value:
            df = df.where(F.array_contains(column, value))
    if review_only:
        df = df.where("needs_manual_review")
    if query and query.reference:
        df = df.where(matches_reference(F.col("case_number"), query.reference))
    if query and query.terms:
        df = df.where(contains_all(query.terms, *map(F.col, texts)))
    return df


def hits(text: Column, terms: Sequence[str]) -> Column:
    """How many of the terms (repeats count) a text holds."""
    return sum((F.coalesce(text.contains(t), F.lit(False)).cast("int") for t in terms), F.lit(0))


def rank(df: DataFrame, fields: Sequence[Field], terms: Sequence[str], reference: Column | None = None) -> DataFrame:
    """Add ``relevance`` and the best matching field: ``match_label``, ``match_excerpt`` and ``match_translated``.

    A field scores its weight for each hit and once more if all terms hit. The best field is the largest of (all hit, weight, label, text).
    """
    score = F.when(reference, REFERENCE_SCORE).otherwise(0) if reference is not None else F.lit(0)
    candidates = []
    if reference is not None:
        candidates.append(F.when(reference, F.struct(F.lit(True).alias("all"), F.lit(REFERENCE_WEIGHT).alias("weight"), F.lit("Nomor perkara").alias("label"), F.col("case_number").alias("text"), F.lit(False).alias("translated"))))
    for f in fields:
        n = hits(f.searched, terms)
        full = (n == len(terms)) & F.lit(bool(terms))
        score = score + n * f.weight + F.when(full, f.weight).otherwise(0)
        candidates.append(F.when(n > 0, F.struct((n == len(terms)).alias("all"), F.lit(f.weight).alias("weight"), F.lit(f.label).alias("label"), F.coalesce(f.shown, F.lit("")).alias("text"), F.lit(f.translated).alias("translated"))))
    best = F.array_max(F.filter(F.array(*candidates), lambda x: x.isNotNull()))
    return df.withColumns({"relevance": score, "_best": best}).withColumns({"match_label": F.col("_best.label"), "match_excerpt": excerpt(F.col("_best.text"), terms), "match_translated": F.col("_best.translated")}).drop("_best")


def excerpt(text: Column, terms: Sequence[str], before: int = EXCERPT_BEFORE, chars: int = EXCERPT_CHARS) -> Column:
    """Up to ``chars`` characters from shortly before the first hit, with an ellipsis where text is left out."""
    found = F.array_min(F.filter(F.array(*[F.locate(t, F.lower(text)) for t in terms] or [F.lit(0)]), lambda p: p > 0))
    start = F.greatest(F.coalesce(found, F.lit(1)) - 1 - before, F.lit(0))
    return F.concat(F.when(start > 0, "…").otherwise(""), F.substring(text, start + 1, F.lit(chars)), F.when(F.length(text) > start + chars, "…").otherwise(""))


def order_of(name: str, position: Column, status_order: Sequence[str] = STATUS_ORDER, labels: Column | None = None) -> list[Column]:
    """The sort keys of an order by name; each ends in ``position``, so it is total. Unknown names sort by review priority."""
    status = F.array_position(F.array(*map(F.lit, status_order)), F.col("status"))
    status = F.when(status.isNull() | (status == 0), len(status_order) + 1).otherwise(status)
    dated = F.coalesce(F.col("decision_date"), F.lit("")) == ""
    number = F.lower(F.coalesce("case_number", "case_id", F.lit("")))
    orders = {
        "relevance": [F.desc("relevance"), F.coalesce("decision_date", F.lit("")).desc(), position],
        "newest": [dated, F.when(~dated, F.col("decision_date")).desc(), F.when(~dated, F.col("case_number")).desc(), position],
        "oldest": [dated, F.when(~dated, F.col("decision_date")).asc(), F.when(~dated, F.col("case_number")).asc(), position],
        "case_number": [number, position],
        "document_type": [labels if labels is not None else F.coalesce("document_type", F.lit("")), number, position],
        "status": [status, number, position],
        "review_priority": [F.col("needs_manual_review").desc(), F.size("review_flags").desc(), status, number, position],
    }
    return orders.get(name, orders["review_priority"])


def default_order(query: Query | None) -> str:
    return "relevance" if query and (query.terms or query.reference) else "newest"


def page_number(text: str, total: int, size: int = PAGE_SIZE) -> int:
    """A page number from what a reader typed, within 1 and the last page."""
    asked = int(text) if text.strip().isdigit() else 1
    return min(max(1, asked), max(1, -(-total // size)))


def page(df: DataFrame, order: Sequence[Column], number: int, size: int = PAGE_SIZE) -> DataFrame:
    """One page of a total order; Spark keeps only the first number x size rows of each task."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def facets(df: DataFrame) -> DataFrame:
    """(facet, value, n) of a collection: status, type, flags, topics, years, review and total, from one pass over the rows.

    A null or empty status or type counts as ``unknown``; an empty year doesn't count.
    """
    unknown = lambda c: F.coalesce(F.when(F.col(c) != "", F.col(c)), F.lit("unknown"))
    pair = lambda facet, value: F.struct(F.lit(facet).alias("facet"), value.alias("value"))
    single = [pair("status", unknown("status")), pair("document_type", unknown("document_type")), pair("total", F.lit("")), F.when(F.col("needs_manual_review"), pair("needs_review", F.lit(""))), F.when(F.coalesce(F.col("year"), F.lit("")) != "", pair("year", F.col("year")))]
    each = lambda facet: lambda x: pair(facet, x)
    many = [F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), each(f)) for f, c in (("review_flag", "review_flags"), ("topic", "topics"))]
    rows = df.select(F.explode(F.filter(F.concat(F.array(*single), *many), lambda x: x.isNotNull())).alias("f"))
    return rows.groupBy("f.facet", "f.value").agg(F.count(F.lit(1)).alias("n"))


def related(rows: DataFrame, key: str, topics: str, order: str, top: int = RELATED) -> DataFrame:
    """(key, rank, other, common): the newest ``top`` other rows that share a topic, with the shared topics in order.

    A row's newest others are among the newest ``top`` + 1 of one of its topics, so only these meet the rows of a topic: the work grows with
    rows x topics x ``top``, also for a topic that all rows share. Rows are dealt by key first, so the pairs of a key are sorted where they are made.
    """
    newest = F.coalesce(F.col(order), F.lit(""))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a small file has one task, which would sort all pairs
    x = rows.select(key, newest.alias("_order"), F.array_distinct(topics).alias("_topics")).repartition(tasks, key).withColumn("_topic", F.explode("_topics"))
    first = x.withColumn("_n", F.row_number().over(Window.partitionBy("_topic").orderBy(F.desc("_order"), key))).where(F.col("_n") <= top + 1)
    first = first.select("_topic", F.col(key).alias("other"), "_order", F.col("_topics").alias("_theirs"))
    met = x.drop("_order").join(first, "_topic").where(F.col(key) != F.col("other"))
    pairs = met.groupBy(key, "other").agg(F.first("_order").alias("_order"), F.array_join(F.array_sort(F.array_intersect(F.first("_topics"), F.first("_theirs"))), ", ").alias("common"))
    w = Window.partitionBy(key).orderBy(F.desc("_order"), "other")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select(key, "rank", "other", "common")
