"""Splitting documents into sections, inside their row: no line of text is shuffled."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Headings of rulings.
KNOWN_HEADINGS = [
    "identitas", "duduk perkara", "pertimbangan hukum", "amar putusan", "amar penetapan", "konklusi", "menimbang", "mengadili",
    "menetapkan", "pokok perkara", "kesimpulan", "hal-hal yang terjadi", "proses persidangan", "bukti", "alat bukti",
]
HEADING = r"^(?:bab\s+[ivxlcdm]+(?:\s+.*)?|[ivxlcdm]+\s*[\.\-]?\s+.*|\d+\.\s+.*|[A-Z][A-Z\s\-]{4,})$"
HEADING_CHARS = 120
TITLES = ["putusan", "ketetapan"]
OPENING = "pembuka"


def looks_like_heading(line: Column) -> Column:
    """Whether a normalized line is a heading of a ruling."""
    return F.lower(line).isin(KNOWN_HEADINGS) | ((F.length(line) <= HEADING_CHARS) & line.rlike(HEADING))


def split_sections(text: Column, is_heading: Callable[[Column], Column] = looks_like_heading, opening: str = OPENING, titles: list[str] = TITLES) -> Column:
    """array<struct<heading, slug, text, start_line, end_line>> of a text.

    Text before the first heading has the heading ``opening``. A title on line 1 is no heading. A heading with nothing below it
    gives no section; a text in which all have nothing gives one empty section, so every document has a section.
    """
    def of_rows(rows: Column) -> Column:
        return T.let(F.transform(rows, T.normalize_whitespace), lambda clean: T.let(F.concat(F.array(F.lit(0)), heads(clean)), lambda starts: chosen(rows, clean, starts)))

    def heads(clean: Column) -> Column:
        flagged = F.transform(clean, lambda x, i: F.when(is_heading(x) & (x != "") & ~((i == 0) & F.lower(x).isin(titles)), i + 1))
        return F.filter(flagged, lambda i: i.isNotNull())

    def chosen(rows: Column, clean: Column, starts: Column) -> Column:
        n = F.size(rows)

        def section(start: Column, k: Column) -> Column:
            end = F.coalesce(F.get(starts, k + 1), n + 1)
            heading = F.when(start == 0, F.lit(opening)).otherwise(F.get(clean, start - 1))
            body = F.array_join(F.slice(rows, start + 1, end - start - 1), "\n")
            return F.struct(heading.alias("heading"), T.slugify(heading).alias("slug"), T.strip(body).alias("text"), (start + 1).alias("start_line"), F.greatest(end - 1, F.lit(1) - n).alias("end_line"))

        def full(every: Column) -> Column:
            kept = F.filter(every, lambda s: s["end_line"] >= s["start_line"])
            return T.let(kept, lambda k: F.when(F.size(k) > 0, k).otherwise(F.slice(every, -1, 1)))

        return T.let(F.transform(starts, section), full)

    return T.let(T.lines(text), of_rows)


def explode_sections(docs: DataFrame, key: str, text: str = "text", **how) -> DataFrame:
    """(key, idx, heading, slug, text, start_line, end_line), idx from 1."""
    return docs.select(key, F.posexplode(split_sections(F.col(text), **how)).alias("idx", "s")).select(key, (F.col("idx") + 1).alias("idx"), "s.*")


def number_lines(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line_no, line), line_no from 1; a text without lines gives none."""
    return docs.select(key, F.posexplode(T.lines(F.col(text))).alias("n", "line")).select(key, (F.col("n") + 1).alias("line_no"), "line")


# What a preview of a document's sections shows.
PREVIEW_WORDS = ["putusan", "ketetapan", "duduk perkara", "pertimbangan", "amar", "konklusi", "petitum", "kewenangan", "kedudukan hukum", "pokok permohonan"]
PREVIEW_CHARS, PREVIEW_SECTIONS, SHORT_HEADING, SHORT_HEADING_WORDS = 280, 18, 48, 6


def preview(parts: Column) -> Column:
    """array<struct<heading, excerpt>> of the first sections whose heading is short or telling."""

    def telling(heading: Column) -> Column:
        out = (F.length(heading) <= SHORT_HEADING) & (F.size(F.split(heading, " ")) <= SHORT_HEADING_WORDS)
        for word in PREVIEW_WORDS:
            out = out | F.lower(heading).contains(word)
        return out

    shown = F.slice(F.filter(parts, lambda s: (s["heading"] != "") & telling(s["heading"])), 1, PREVIEW_SECTIONS)
    return F.transform(shown, lambda s: F.struct(s["heading"].alias("heading"), F.concat(F.substring(s["text"], 1, PREVIEW_CHARS), F.when(F.length(s["text"]) > PREVIEW_CHARS, "...").otherwise("")).alias("excerpt")))
