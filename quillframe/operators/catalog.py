"""One catalog of many sources: priorities, overlays, editorial notes and the flat rows that search works on."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.search_text import fold_texts
from ..session import shared_folder
from . import validate

# Sources from the strongest on, labels of outcomes, and titles that say nothing.
SOURCE_PRIORITY = ["review_queue", "validated_json", "parsed_json"]
OUTCOME_LABELS = {
    "granted_partly": "Dikabulkan sebagian", "granted": "Dikabulkan", "rejected": "Ditolak", "inadmissible": "Tidak dapat diterima",
    "mixed": "Sebagian tidak diterima; sisanya ditolak", "withdrawn": "Ditarik kembali", "dismissed": "Gugur", "unknown": "Belum teridentifikasi",
}
EMPTY_TITLES = ["PUTUSAN", "KETETAPAN", "SALINAN", "SALINA N"]
OVERLAY_SOURCE = "library"


def pick_source(rows: DataFrame, key: str, source: str, payload: Sequence[str], priority: Sequence[str] = SOURCE_PRIORITY, path: str | None = None) -> DataFrame:
    """One row for each key from its strongest source, with ``available`` (source -> path): an aggregation with map-side combine, no sort.

    Of several rows of one source the smallest path counts. Sources that aren't listed are left out.
    """
    rank = F.array_position(F.array(*map(F.lit, priority)), F.col(source))
    where = F.col(path) if path else F.lit("")
    known = rows.where(F.col(source).isin(list(priority)))
    best = F.min_by(F.struct(source, *payload), F.struct(rank, where)).alias("_best")
    available = F.map_from_entries(F.array_sort(F.collect_set(F.struct(source, where.alias("path"))))) if path else F.array_sort(F.collect_set(source))
    return known.groupBy(key).agg(best, available.alias("available")).select(key, "_best.*", "available")


def overlay(base: DataFrame, edits: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Full outer overlay: an edit's non-null field replaces the base's; rows on one side only stay, with ``overlaid`` and ``added`` saying so."""
    b, e = base.alias("b"), edits.alias("e")
    joined = b.join(e, F.col(f"b.{key}") == F.col(f"e.{key}"), "full_outer")
    rest = [c for c in base.columns if c != key and c not in fields]
    return joined.select(
        F.coalesce(F.col(f"b.{key}"), F.col(f"e.{key}")).alias(key),
        *[F.coalesce(F.col(f"e.{f}"), F.col(f"b.{f}")).alias(f) for f in fields],
        *[F.col(f"b.{c}") for c in rest],
        F.col(f"e.{key}").isNotNull().alias("overlaid"),
        F.col(f"b.{key}").isNull().alias("added"),
    )


def last_wins(rows: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The values of each key's last row in an order; an aggregation, not a sort."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_last")).select(*keys, *[F.col(f"_last.{v}").alias(v) for v in values])


def fill_download_url(records: DataFrame, manifests: DataFrame) -> DataFrame:
    """Records with ``source.download_url`` filled from manifests (file, idx, case_number, document_type, url) where it is missing; the last manifest wins."""
    named = manifests.select(T.normalize_case_number(F.col("case_number")).alias("_number"), F.coalesce("document_type", F.lit("putusan")).alias("_type"), "file", "idx", "url")
    last = last_wins(named, ["_number", "_type"], ["file", "idx"], ["url"])
    same = T.normalize_case_number(F.col("document.case_number")).eqNullSafe(F.col("_number")) & F.col("document.document_type").eqNullSafe(F.col("_type"))
    url = F.coalesce(T.nullif_empty(F.col("source.download_url")), T.nullif_empty(F.col("url")))
    return records.join(last, same, "left").withColumn("source", F.col("source").withField("download_url", url)).drop("_number", "_type", "url")


def attach(records: DataFrame, side: DataFrame, number: str = "case_number") -> DataFrame:
    """Left join of editorial notes or insights on the case number; records without any keep nulls."""
    return records.join(side.withColumnRenamed(number, "_n"), F.col("document.case_number") == F.col("_n"), "left").drop("_n")


#: The facts an owner may correct, by group.
FACTS = {"case_number": "document", "document_type": "document", "decision_date": "document", "applicants": "parties", "judges": "adjudicators", "clerks": "adjudicators", "dictum": "outcome"}


def apply_corrections(records: DataFrame) -> DataFrame:
    """Records with ``edits`` (a struct of the facts; applicants as names) and ``edited`` (the facts that it sets, null values included).

    Edited facts replace the record's; the summary follows an edited dictum and the decision type an edited document type. Checks are
    computed again for edited records (their schema errors stay), the parser's block never.
    """
    edited = F.coalesce("edited", F.array().cast("array<string>"))
    applicants = F.transform(F.col("edits.applicants"), lambda n: F.struct(n.alias("name"), F.lit("applicant").alias("role"), F.lit(None).cast("string").alias("description")))
    value = {f: applicants if f == "applicants" else F.col(f"edits.{f}") for f in FACTS}
    groups = {g: F.col(g) for g in dict.fromkeys(FACTS.values())}
    for fact, group in FACTS.items():
        groups[group] = groups[group].withField(fact, F.when(F.array_contains(edited, fact), value[fact]).otherwise(F.col(f"{group}.{fact}")))
    outcome = groups["outcome"].withField("summary", F.when(F.array_contains(edited, "dictum"), F.get(value["dictum"], F.lit(0))).otherwise(F.col("outcome.summary")))
    groups["outcome"] = outcome.withField("decision_type", F.when(F.array_contains(edited, "document_type"), value["document_type"]).otherwise(F.col("outcome.decision_type")))
    kept = records.withColumn("_before", F.col("validation")).withColumn("_touched", F.size(edited) > 0).withColumns(groups).drop("edits", "edited")
    checked = validate.with_validation(kept, F.coalesce("_before.schema_errors", F.array().cast("array<string>")))
    return checked.withColumn("validation", F.when(F.col("_touched"), F.col("validation")).otherwise(F.col("_before"))).drop("_before", "_touched")


def summarize(records: DataFrame, english: DataFrame | None = None) -> DataFrame:
    """The flat search row of each record (case_id, route_source, record groups, optionally editorial, insights).

    Private columns start with ``_``. ``english`` is a dictionary (source, target) of exact translations for the topics' and titles' English index.
    """
    have = set(records.columns)
    note = F.col("editorial") if "editorial" in have else F.lit(None).cast("struct<title:string,summary:string,topics:array<string>,law:string>")
    law = F.coalesce(T.nullif_empty(note["law"]), F.get(F.col("legal_basis.object_of_review"), F.lit(0)), F.lit(""))
    title = F.coalesce(T.nullif_empty(note["title"]), T.nullif_empty(F.col("document.title")))
    title = F.when(title.isNotNull() & ~F.upper(title).isin(EMPTY_TITLES), title).otherwise(F.coalesce(T.nullif_empty(law), F.concat(F.lit("Perkara "), F.coalesce(T.nullif_empty(F.col("document.case_number")), F.col("case_id")))))
    key = T.classify_outcome(F.col("outcome.summary"))
    topics = F.coalesce(note["topics"], F.array().cast("array<string>"))
    out = records.select(
        "case_id",
        F.col("route_source").alias("source"),
        F.coalesce(F.col("source.file_name"), F.concat("case_id", F.lit(".json"))).alias("file_name"),
        F.col("document.document_type").alias("document_type"),
        F.col("document.case_number").alias("case_number"),
        F.col("document.decision_date").alias("decision_date"),
        F.coalesce(F.substring("document.decision_date", 1, 4), F.lit("")).alias("year"),
        title.alias("title"),
        F.coalesce(T.nullif_empty(note["summary"]), T.nullif_empty(F.col("document.summary")), F.col("outcome.summary")).alias("description"),
        topics.alias("topics"),
        law.alias("law"),
        (F.coalesce(note["summary"], F.lit("")) != "").alias("editorial"),
        F.col("parser.status").alias("status"),
        F.coalesce(F.col("validation.needs_manual_review"), F.lit(False)).alias("needs_manual_review"),
        F.coalesce(F.col("validation.review_flags"), F.array().cast("array<string>")).alias("review_flags"),
        F.size(F.coalesce("parties.applicants", F.array())).alias("applicant_count"),
        F.size(F.coalesce("parties.respondents", F.array())).alias("respondent_count"),
        F.col("outcome.summary").alias("outcome_summary"),
        key.alias("outcome_key"),
        T.label_of(key, OUTCOME_LABELS).alias("outcome_label"),
        (F.col("insights.featured_rank") if "insights" in have else F.lit(None).cast("int")).alias("featured_rank"),
        (F.col("insights.impact") if "insights" in have else F.lit(None).cast("string")).alias("impact"),
        F.flatten(F.array(*[F.transform(F.coalesce(F.col(f"parties.{g}"), F.array()), lambda p: p["name"]) for g in ("applicants", "legal_counsels", "respondents", "experts", "witnesses", "amicus_curiae")])).alias("_names"),
        F.transform(F.coalesce("sections", F.array()), lambda s: F.concat(s["heading"], F.lit(" "), s["text"])).alias("_sections"),
    )
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("case_number", "title", "description", "law", "file_name", "document_type", "outcome_summary")]
    everything = F.concat_ws(" ", *parts, F.array_join("_names", " "), F.array_join("topics", " "), F.array_join("_sections", " "))
    out = out.withColumn("_excerpt_text", T.normalize_whitespace(everything)).drop("_names", "_sections")
    out = out.withColumn("_normalized_search_text", fold_texts(F.col("_excerpt_text")))
    if english is None:
        return out.withColumn("_english_search_text", F.lit(""))
    terms = out.select("case_id", F.explode(F.array_distinct(F.concat(F.col("topics"), F.array("title", "description", "law")))).alias("source_text")).where("source_text <> ''")
    found = terms.join(english.select(F.col("source").alias("source_text"), "target"), "source_text").groupBy("case_id").agg(F.array_join(F.array_sort(F.collect_set("target")), " ").alias("_english"))
    return out.join(found, "case_id", "left").withColumn("_english_search_text", fold_texts(F.coalesce("_english", F.lit("")))).drop("_english")


def case_record(records: DataFrame, case_id: str, source: str = "source_name", payload: Sequence[str] = (), path: str | None = None) -> DataFrame:
    """One case by its id, from its strongest source; no row if no source has it. Only its rows are looked at."""
    return pick_source(records.where(F.col("case_id") == case_id), "case_id", source, payload, path=path)


def public(summaries: DataFrame) -> DataFrame:
    """Without the private columns."""
    return summaries.drop(*[c for c in summaries.columns if c.startswith("_")])


def translate(df: DataFrame, column: str, dictionary: DataFrame, out: str) -> DataFrame:
    """Exact translation by a dictionary (source, target); what it lacks stays as it is."""
    pairs = dictionary.select(F.col("source").alias("_from"), F.col("target").alias("_to")).dropDuplicates(["_from"])
    return df.join(pairs, F.col(column) == F.col("_from"), "left").withColumn(out, F.coalesce("_to", F.col(column))).drop("_from", "_to")


#: Fragments of the interface that only differ in numbers, and their English.
PHRASES = [
    (r"Halaman (\d+)", "Page $1"), (r"PDF hlm\. (\d+)", "PDF p. $1"), (r"(\d+) hakim", "$1 judges"), (r"Jelajahi (\d+) topik", "Browse $1 topics"), (r"Jelajahi (\d+) perkara →", "Browse $1 cases →"),
    (r"Bagian (\d+) dari (\d+)", "Part $1 of $2"), (r"Cerita (\d+) · (\d+) perkara", "Story $1 · $2 cases"), (r"Bab (\d+) · (\d+) perkara", "Chapter $1 · $2 cases"),
    (r"Satu pertanyaan · (\d+) putusan", "One question · $1 decisions"), (r"Satu pertanyaan · (\d+) putusan · 3 bab", "One question · $1 decisions · 3 chapters"), (r"([\d–]+) dari (\d+) perkara", "$1 of $2 cases"),
    (r"(\d+) perkara", "$1 cases"), (r"(\d+) topik", "$1 topics"),
]


def translate_phrases(c: Column, phrases: Sequence[tuple[str, str]] = PHRASES) -> Column:
    """A whole text by the first phrase that matches it; others stay as they are."""
    out = c
    for pattern, english in reversed(phrases):
        out = F.when(c.rlike(f"^(?:{pattern})$"), F.regexp_replace(c, f"^(?:{pattern})$", english)).otherwise(out)
    return out


#: Texts around parts that are translated in turn; the first that fits counts. ``{t}`` is such a part, ``{list}`` a list of them
#: parted by commas, ``{label}`` a part that the dictionary must hold, ``{o}`` one that stays as it is, such as the short name of a source.
COMPOSITES = [
    (r"^(.*) · teks asli$", ("{t}", " · Indonesian match")),
    (r"^(.*) · ([A-Z]{3,5})$", ("{t}", " · ", "{o}")),
    (r"^Disusun dari: (.*?)\.?$", ("Prepared from: ", "{t}", ".")),
    (r"^Sama-sama membahas (.*)$", ("Also about ", "{list}")),
    (r"^(.*?): (.*)$", ("{label}", ": ", "{t}")),
    (r"^Hapus (.*?): (.*)$", ("Remove ", "{t}", ": ", "{t}")),
    (r"^Hapus (.*)$", ("Remove ", "{t}")),
]
#: Marks around a text that is translated without them.
LEADING, TRAILING = "· ", (" ↗", " →")
#: What is replaced inside a text that nothing else fits: kinds of decisions at the end, hidden items, dates.
KINDS = {"Putusan": "Judgment", "Ketetapan": "Order"}
ENGLISH_MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]


def _finished(c: Column) -> Column:
    """The last resort for a text that nothing fits: counts without their number, kinds of decisions, hidden items and dates."""
    out = F.when(c.rlike(r"^perkara(?: · \d+ topik)?$"), F.regexp_replace(F.regexp_replace(c, r"\bperkara\b", "cases"), r"\btopik\b", "topics")).otherwise(c)
    for kind, english in KINDS.items():
        out = F.regexp_replace(out, f" · {kind}$", f" · {english}")
    out = F.regexp_replace(out, r"\(\+(\d+) item lain disembunyikan\)", r"(+$1 more items hidden)")
    for month, english in zip(T.MONTHS, ENGLISH_MONTHS, strict=True):
        out = F.regexp_replace(out, rf"\b(\d{{1,2}}) {month.capitalize()} (\d{{4}})\b", rf"$1 {english} $2")
    return out


def _piece(text: Column, translated: bool) -> Column:
    return F.struct(text.alias("text"), F.lit(translated).alias("open"))


def _decomposed(core: Column, composites: Sequence[tuple[str, tuple[str, ...]]]) -> Column:
    """array of (rule, label, pieces): the ways in which rules cut a text, in their order; pieces are (text, whether it is translated in turn)."""
    ways = []
    for number, (pattern, shape) in enumerate(composites):
        group, pieces, label = 0, F.array().cast("array<struct<text:string,open:boolean>>"), F.lit(None).cast("string")
        for part in shape:
            if not part.startswith("{"):
                pieces = F.concat(pieces, F.array(_piece(F.lit(part), False)))
                continue
            group += 1
            text = F.regexp_extract(core, pattern, group)
            if part == "{list}":
                each = F.transform(F.split(text, ", "), lambda x, i: F.concat(F.when(i > 0, F.array(_piece(F.lit(", "), False))).otherwise(F.array().cast("array<struct<text:string,open:boolean>>")), F.array(_piece(x, True))))
                pieces = F.concat(pieces, F.flatten(each))
            else:
                pieces = F.concat(pieces, F.array(_piece(text, part != "{o}")))
                label = text if part == "{label}" else label
        ways.append(F.when(core.rlike(pattern), F.struct(F.lit(number).alias("rule"), label.alias("label"), pieces.alias("pieces"))))
    before = F.when(core.startswith(LEADING), LEADING).otherwise("")
    rest = F.substring(core, F.length(before) + 1, F.length(core))
    after = F.when(rest.endswith(TRAILING[0]), TRAILING[0]).when(rest.endswith(TRAILING[1]), TRAILING[1]).otherwise("")
    marked = F.array(_piece(before, False), _piece(F.substring(rest, F.lit(1), F.length(rest) - F.length(after)), True), _piece(after, False))
    ways.append(F.when((before != "") | (after != ""), F.struct(F.lit(len(composites)).alias("rule"), F.lit(None).cast("string").alias("label"), marked.alias("pieces"))))
    return F.filter(F.array(*ways), lambda w: w.isNotNull())


def translate_composite(df: DataFrame, column: str, dictionary: DataFrame, out: str, phrases: Sequence[tuple[str, str]] = PHRASES, composites: Sequence[tuple[str, tuple[str, ...]]] = COMPOSITES, most: int = 40) -> DataFrame:
    """Translation by a dictionary (source, target), phrases and texts that are composed of parts, which are translated in turn; the space around a text stays.

    The first that fits counts: dictionary, phrase, composition, and at last the fragments of ``_finished``; what nothing fits stays as it is. The distinct texts are
    cut level by level: a level's open parts are the texts of the next, joined with the dictionary once for all rows, until none is open. Then parts are put
    together from the innermost level outwards. ``most`` levels at most are cut; texts nested deeper are an error.
    """
    spark, folder = df.sparkSession, f"{shared_folder(df.sparkSession)}/quillframe-translate-{uuid.uuid4().hex}"
    pairs = dictionary.select(F.col("source").alias("_from"), F.col("target").alias("_to")).dropDuplicates(["_from"])
    trim = lambda c: F.regexp_extract(c, r"(?s)^\s*(.*?)\s*$", 1)
    kind = "core string, done string, rule int, pieces array<struct<text:string,open:boolean>>"
    level = df.select(trim(F.col(column)).alias("core")).where("core <> ''").distinct()
    levels = 0
    while levels == 0 or not level.isEmpty():
        if levels == most:
            raise ValueError(f"texts are nested in more than {most} levels")
        known = level.join(pairs, F.col("core") == F.col("_from"), "left").drop("_from")
        phrase = translate_phrases(F.col("core"), phrases)
        known = known.withColumn("done", F.coalesce("_to", F.when(phrase != F.col("core"), phrase))).drop("_to")
        cut = known.withColumn("ways", F.when(F.col("done").isNull(), _decomposed(F.col("core"), composites)).otherwise(F.array()))
        # A label must be in the dictionary: of the ways to cut a text those without one always hold.
        labels = cut.select("core", F.explode("ways").alias("w")).where("w.label is not null").select("core", F.col("w.label").alias("_label")).join(pairs.select(F.col("_from").alias("_label")), "_label", "left_semi").select("core", F.lit(True).alias("_labelled")).distinct()
        cut = cut.join(labels, "core", "left").withColumn("way", F.get(F.filter("ways", lambda w: w["label"].isNull() | F.coalesce("_labelled", F.lit(False))), F.lit(0)))
        cut.select("core", "done", "way.rule", "way.pieces").write.parquet(f"{folder}/{levels}")
        stored = spark.read.schema(kind).parquet(f"{folder}/{levels}")
        level = stored.select(F.explode("pieces").alias("p")).where("p.open").select(trim(F.col("p.text")).alias("core")).where("core <> ''").distinct()
        levels += 1
    below = spark.createDataFrame([], "core string, done string")
    for n in reversed(range(levels)):
        rows = spark.read.schema(kind).parquet(f"{folder}/{n}")
        parts = rows.where("pieces is not null").select("core", "rule", F.posexplode("pieces").alias("i", "p")).withColumn("_core", F.when(F.col("p.open"), trim(F.col("p.text"))))
        parts = parts.join(below.toDF("_core", "_done"), "_core", "left").withColumn("_text", F.coalesce(spaced(F.col("p.text"), F.col("_done")), F.col("p.text")))
        put = parts.groupBy("core", "rule").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "_text"))), lambda x: x["_text"]), "").alias("_put"))
        put = put.select("core", F.when(F.col("rule") == len(composites), _finished(F.col("_put"))).otherwise(F.col("_put")).alias("_put"))
        done = rows.join(put, "core", "left").select("core", F.coalesce("done", "_put", _finished(F.col("core"))).alias("done"))
        done.write.parquet(f"{folder}/done-{n}")
        below = spark.read.schema("core string, done string").parquet(f"{folder}/done-{n}")
    joined = df.withColumn("_core", trim(F.col(column))).join(below.toDF("_core", "_done"), "_core", "left")
    return joined.withColumn(out, F.coalesce(spaced(F.col(column), F.col("_done")), F.col(column))).drop("_core", "_done")


def spaced(text: Column, core: Column) -> Column:
    """Another core in the space that is around a text."""
    return F.concat(F.regexp_extract(text, r"(?s)^(\s*)", 1), core, F.regexp_extract(text, r"(?s)(?<=\S)(\s*)$", 1))
