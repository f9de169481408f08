"""Structured facts of rulings, as column expressions over the text: no row leaves its task and no Python runs.

Every extractor maps a text (and, where it needs them, its sections) to a struct or an array; ``EXTRACTORS`` names them and
``parse_documents`` puts their results, the checks and a status into one record for each document.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import shared_folder
from . import validate
from .sections import split_sections

SCHEMA_VERSION = "1.0.0"
# What marks the parts of a ruling.
HEAD_LINES, DATE_REACH, OPENING_CHARS, LAW_CHARS, PHRASE_LINES, MAX_PROCEEDINGS = 25, 240, 5000, 4000, 20, 40
STOP_HEADING = r"(?iU)^\s*(?:\d+\.\s*)?(?:duduk perkara|pertimbangan hukum|menimbang|konklusi|amar putusan|amar penetapan|mengadili|menetapkan)\b"
NAME_BLOCK = r"(?isUd)(?:^|\n)\s*(?:\d+\.\s*)?Nama\s*:\s*(.+?)(?=\n\s*(?:Pekerjaan|Alamat|Selanjutnya disebut sebagai|Nama\s*:|Dalam hal ini|Sebagai|Membaca|Mendengar|Memeriksa|Menimbang|$))"
AMICUS = r"(?isU)amicus curiae\s*(?:dari|:)\s*(.+?)(?=(?:;|\n|\.))"
COUNSEL = r"(?isUd)(?:memberi kuasa kepada|memberikan kuasa kepada|kuasa kepada)\s*(.+?)(?=(?:;|\n|bertindak|selanjutnya|kesemuanya|yang berkedudukan|$))"
DEGREE = r"(?i)^(?:S\.?H\.?|M\.?H\.?|M\.?H\.?um\.?|M\.?A\.?P\.?|M\.?K\.?n\.?|M\.?K\.?om\.?|M\.?I\.?K\.?om\.?|S\.?I\.?K\.?om\.?|S\.?K\.?om\.?|LL\.?M\.?|A\.?P\.?|A\.?P\.?T\.?|M\.?Ag\.?|M\.?M\.?)$"
INSTITUTIONS = ["DPR", "Presiden", "Pemerintah", "Pihak Terkait"]
HEARINGS = [
    (r"mendengar\s+keterangan\s+ahli", "mendengar keterangan ahli"),
    (r"mendengar\s+keterangan\s+saksi", "mendengar keterangan saksi"),
    (r"menerima\s+.*?amicus curiae", "menerima amicus curiae"),
    (r"sidang\s+gabungan", "sidang gabungan"),
    (r"sidang\s+pleno", "sidang pleno"),
    (r"rapat permusyawaratan hakim", "rapat permusyawaratan hakim"),
    (r"pembacaan\s+putusan", "pembacaan putusan"),
    (r"pembacaan\s+penetapan", "pembacaan ketetapan"),
]
REVIEWED = [r"pengujian\s+undang-undang\s+nomor\s+[^,;\n]+", r"pengujian\s+undang-undang\s+terhadap\s+u?u?d?\s*1945", r"objek\s+uji[:\s]+.+"]
OPERATIVE = [r"(?:\d+\.\s*)?(?:AMAR\s+(?:PUTUSAN|PENETAPAN)|MENETAPKAN)\s*:?\s*$", r"MENGADILI\s*:?\s*$"]
AFTER_OPERATIVE = r"(?:\d+\.\s*)?(?:Demikian\b|ALASAN\s+BERBEDA|PENDAPAT\s+BERBEDA|DISSENTING\s+OPINION|KETUA\s*,)"
PERSON_GROUPS = {"applicants": "applicant", "legal_counsels": "legal_counsel", "respondents": "respondent", "experts": "expert", "witnesses": "witness", "amicus_curiae": "amicus_curiae"}
NO_NAMES = "array<string>"


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), group)


def _present(c: Column) -> Column:
    return F.filter(c, lambda x: x.isNotNull() & (x != ""))


def _if_told(low: Column, marks: Sequence[str], found: Column, otherwise: Column) -> Column:
    """What is found, looked for only in a text whose lower-case form holds one of the marks, each a part of every match: most texts hold none, and a search costs far more.

    Marks have no ``i`` or ``s``, as patterns take a dotted capital and a long s for these, which lower case doesn't.
    """
    return F.when(functools.reduce(lambda a, b: a | b, [low.contains(m) for m in marks]), found).otherwise(otherwise)


def _none() -> Column:
    return F.array().cast(NO_NAMES)


def clean_name(c: Column) -> Column:
    return T.normalize_whitespace(T.normalize_party_name(T.cut_representation(c)))


def split_names(c: Column) -> Column:
    """Names of a list; an academic degree goes with the name before it, or nowhere."""

    def joined(tokens: Column) -> Column:
        starts = F.filter(F.transform(tokens, lambda x, i: F.when(~x.rlike(DEGREE), i + 1)), lambda i: i.isNotNull())
        return T.let(starts, lambda at: F.transform(at, lambda a, k: F.array_join(F.slice(tokens, a, F.coalesce(F.get(at, k + 1), F.size(tokens) + 1) - a), ", ")))

    return T.let(_present(F.transform(F.split(c, r"(?iU),|\bdan\b|/|\+|;"), T.strip)), joined)


def names_in_blocks(c: Column) -> Column:
    return _if_told(F.lower(c), ["nama"], _present(F.transform(_matches(c, NAME_BLOCK, 1), clean_name)), _none())


def names_in_lists(found: Column, least: int = 1) -> Column:
    names = F.flatten(F.transform(found, lambda x: split_names(clean_name(x))))
    return F.filter(F.transform(names, clean_name), lambda x: F.length(x) >= least)


def opening_block(text: Column, lines: Column | None = None, low: Column | None = None) -> Column:
    """The lines before the first heading of a ruling's body."""
    def before(rows: Column) -> Column:
        stops = F.filter(F.transform(rows, lambda x, i: F.when(x.rlike(STOP_HEADING), i)), lambda i: i.isNotNull())
        last = _if_told(F.lower(text) if low is None else low, ["dudu", "mbang", "konklu", "amar", "mengad", "menetap"], F.array_min(stops), F.lit(None).cast("int"))
        return F.array_join(F.slice(rows, F.lit(1), F.coalesce(last, F.size(rows))), "\n")

    return T.let(T.lines(text) if lines is None else lines, before)


def blocks_around(text: Column, phrase: str, span: int = PHRASE_LINES, lines: Column | None = None, low: Column | None = None) -> Column:
    """``span`` lines from each line that holds a phrase."""
    def around(rows: Column) -> Column:
        at = F.filter(F.transform(rows, lambda x, i: F.when(F.lower(x).contains(phrase), i + 1)), lambda i: i.isNotNull())
        return F.transform(at, lambda i: F.array_join(F.slice(rows, i, span), "\n"))

    told = (F.lower(text) if low is None else low).contains(phrase)  # lines are told the same way
    return F.when(told, T.let(T.lines(text) if lines is None else lines, around)).otherwise(_none())


def document_info(text: Column, lines: Column | None = None, low: Column | None = None) -> Column:
    def facts(rows: Column) -> Column:
        return T.let(F.array_join(rows, "\n"), lambda head: T.let(T.normalize_case_number(head), lambda number: T.let(decision_date(text, lines, low), lambda date: F.struct(
            F.when(head.rlike(r"(?iU)\bketetapan\b"), "ketetapan").when(head.rlike(r"(?iU)\bputusan\b"), "putusan").alias("document_type"),
            F.when(head.rlike(r"(?iU)\bpuu\b"), "PUU").alias("case_type"),
            number.alias("case_number"),
            F.filter(T.extract_case_numbers(head), lambda x: ~x.eqNullSafe(number)).alias("related_case_numbers"),
            F.get(rows, F.lit(0)).alias("title"),
            date["iso"].alias("decision_date"),
            date["raw"].alias("decision_date_raw"),
            F.lit(None).cast("string").alias("summary"),
        ))))

    rows = T.lines(text) if lines is None else lines
    return T.let(F.transform(F.slice(F.filter(rows, lambda x: T.normalize_whitespace(x) != ""), 1, HEAD_LINES), T.normalize_whitespace), facts)


def decision_date(text: Column, lines: Column | None = None, low: Column | None = None) -> Column:
    """struct<raw, iso> of the date a ruling was pronounced: the first valid one soon after an anchor in its closing."""
    low = F.lower(text) if low is None else low
    closing = F.regexp_extract(text, r"(?ismdU)\A.*^\s*(Demikian\s+(?:diputus\w*|ditetapkan)\b.*)\z", 1)
    fallback = F.array_join(F.filter(T.lines(text) if lines is None else lines, lambda x: x.rlike(r"(?iU)^\s*(?:diucapkan|dibacakan|ditetapkan)\b")), "\n")
    closing, fallback = _if_told(low, ["putu", "tetap"], closing, F.lit("")), _if_told(low, ["ucapkan", "bacakan", "tetapkan"], fallback, F.lit(""))
    closing = T.normalize_whitespace(F.regexp_replace(T.let(closing, lambda c: F.when(c != "", c).otherwise(fallback)), r"(?mdU)^\s*\d+\s*$", ""))
    return T.let(closing, _first_date)


def _first_date(closing: Column) -> Column:
    spoken, decided = (_matches(closing, rf"(?iU)\b(?:{a})\b(?=(.{{0,{DATE_REACH}}}))", 1) for a in ("diucapkan|dibacakan", "ditetapkan"))
    raw = T.let(spoken, lambda s: F.transform(F.when(F.size(s) > 0, s).otherwise(decided), lambda w: F.regexp_extract(w, T.DATE, 0)))
    dated = F.filter(F.transform(raw, lambda r: F.struct(r.alias("raw"), T.normalize_date(r).alias("iso"))), lambda d: d["iso"].isNotNull())
    return F.get(dated, F.lit(0))


def parties(text: Column, sections: Column, lines: Column | None = None, opening: Column | None = None, body: Column | None = None, low: Column | None = None) -> Column:
    """struct of six arrays of people (name, role); each name once, in order of appearance."""
    low = F.lower(text) if low is None else low
    opening = opening_block(text, lines, low) if opening is None else opening
    start = T.normalize_whitespace(F.substring(text, 1, OPENING_CHARS))
    named = F.coalesce(
        T.nullif_empty(F.regexp_extract(start, r"(?iU)(?:atas nama|bernama)\s+(.+?)(?=\s*\(|\s*,?\s*yang\b)", 1)),
        T.nullif_empty(F.regexp_extract(start, r"(?iU)permohonan bertanggal\s+.+?\s+dari\s+(.+?)(?=,?\s+yang\b)", 1)),
    )
    line = T.nullif_empty(_if_told(low, ["pemohon"], F.regexp_extract(text, r"(?imdU)^\s*Pemohon\s*:\s*(.+)$", 1), F.lit("")))
    told = lambda n: F.when(n.isNotNull(), F.transform(split_names(n), clean_name)).otherwise(F.coalesce(F.array_compact(F.array(clean_name(line))), F.array().cast(NO_NAMES)))
    applicants = T.let(names_in_blocks(opening), lambda names: F.when(F.size(names) > 0, names).otherwise(T.let(named, told)))
    body = section_body(sections) if body is None else body
    respondents = F.filter(F.array(*[F.when(body.rlike(rf"(?iU)\b{i}\b"), i) for i in INSTITUTIONS]), lambda x: x.isNotNull())
    experts, witnesses = (F.flatten(F.transform(blocks_around(text, phrase, lines=lines, low=low), names_in_blocks)) for phrase in ("keterangan ahli", "keterangan saksi"))
    counsels = _if_told(low, ["kua"], names_in_lists(_matches(opening, COUNSEL, 1), 3), _none())
    amici = _if_told(low, ["cur"], names_in_lists(_matches(opening, AMICUS, 1)), _none())
    found = [applicants, counsels, respondents, experts, witnesses, amici]
    return F.struct(*[people(T.ordered_distinct(names, F.lower), role).alias(group) for names, (group, role) in zip(found, PERSON_GROUPS.items(), strict=True)])


def people(names: Column, role: str) -> Column:
    return F.transform(names, lambda n: F.struct(n.alias("name"), F.lit(role).alias("role"), F.lit(None).cast("string").alias("description")))


def section_body(sections: Column) -> Column:
    """The texts of all sections, then their headings."""
    return F.concat(F.array_join(F.transform(sections, lambda s: s["text"]), "\n\n"), F.lit("\n"), F.array_join(F.transform(sections, lambda s: s["heading"]), "\n"))


def _whole(text: Column, sections: Column, separator: str = "\n\n") -> Column:
    return F.concat(F.array_join(F.transform(sections, lambda s: s["text"]), separator), F.lit("\n"), text)


def legal_basis(text: Column, sections: Column, whole: Column | None = None, numbers: Column | None = None, low: Column | None = None) -> Column:
    whole = _whole(text, sections) if whole is None else whole
    low = F.lower(text) if low is None else low  # the sections' texts are parts of the text
    rows = F.when(low.contains("pasal"), F.filter(T.lines(whole), lambda x: F.lower(x).contains("pasal"))).otherwise(_none())
    constitutional = F.filter(rows, lambda x: F.lower(x).rlike("uud|1945"))
    procedural = F.filter(rows, lambda x: ~F.lower(x).rlike("uud|1945") & F.lower(x).rlike("peraturan mahkamah|acara|registrasi|persidangan"))
    articles = [F.array_distinct(_present(F.transform(a, T.normalize_article))) for a in (constitutional, procedural)]
    clauses = _if_told(low, ["pengu", "objek"], F.concat(*[_matches(whole, f"(?iU){p}") for p in REVIEWED]), _none())
    objects = F.array_distinct(F.transform(clauses, lambda x: F.coalesce(T.normalize_article(x), T.normalize_whitespace(F.rtrim(x, F.lit(".;,"))))))
    start = F.regexp_replace(T.normalize_whitespace(F.substring(text, 1, LAW_CHARS)), r"(?iU)Undang\s*-\s*Undang", "Undang-Undang")
    challenged = T.nullif_empty(F.regexp_extract(start, r"(?iU)Pengujian\s+(Undang-Undang\s+Nomor\s+.+?)\s+terhad\s*ap\s+Undang-Undang\s+Dasar", 1))
    evidence = _if_told(low, ["bukt"], F.transform(_matches(whole, r"(?iU)\b(?:bukti|alat bukti)\s*(?:p\s*-?\s*)?\d+[a-z]?\b"), lambda x: T.normalize_whitespace(F.upper(x))), _none())
    cited = F.transform(T.extract_case_numbers(whole) if numbers is None else numbers, lambda x: F.concat(F.lit("REFERENSI:"), x))
    return F.struct(
        F.when(challenged.isNotNull(), F.array(challenged)).otherwise(objects).alias("object_of_review"),
        articles[0].alias("constitutional_articles"),
        articles[1].alias("procedural_articles"),
        F.array_distinct(F.concat(evidence, cited)).alias("evidence"),
    )


def proceedings(text: Column, sections: Column, whole: Column | None = None, low: Column | None = None) -> Column:
    whole = _whole(text, sections, "\n") if whole is None else whole
    low = F.lower(text) if low is None else low
    labels = F.filter(F.array(*[F.when(whole.rlike(f"(?iU){p}"), label) for p, label in HEARINGS]), lambda x: x.isNotNull())
    rows = F.transform(T.lines(whole), T.normalize_whitespace)
    held = F.filter(rows, lambda x: x.rlike(r"(?iU)\b(hearing|sidang|persidangan|pemeriksaan)\b") & ~F.lower(x).contains("perkara nomor") & (F.length(x) <= 60))
    labels, held = _if_told(low, ["mendengar", "mener", "dang", "rapat", "pembacaan"], labels, _none()), _if_told(low, ["hear", "dang", "pemer"], held, _none())
    return F.slice(F.array_distinct(F.concat(labels, held)), 1, MAX_PROCEEDINGS)


def outcome(text: Column, document_type: Column, low: Column | None = None) -> Column:
    """struct<decision_type, dictum, summary> of the last operative part."""
    tail = _if_told(F.lower(text) if low is None else low, ["amar", "menetap", "mengad"], F.coalesce(*[_after_last(text, mark) for mark in OPERATIVE]), F.lit(None).cast("string"))
    return T.let(tail, lambda t: F.when(t.isNull(), _no_outcome(document_type)).otherwise(_outcome_of(t, document_type)))


def _after_last(text: Column, mark: str) -> Column:
    """What follows the last line start that matches a mark; null without one."""
    start = rf"(?ismdU)\A.*^\s*{mark}"
    return F.when(text.rlike(start), F.regexp_replace(text, start, ""))


def _no_outcome(document_type: Column) -> Column:
    message = F.concat(F.when(document_type == "ketetapan", "ketetapan").otherwise("amar putusan"), F.lit(" tidak terdeteksi secara eksplisit"))
    return F.struct(document_type.alias("decision_type"), F.array(message).alias("dictum"), message.alias("summary"))


def _outcome_of(tail: Column, document_type: Column) -> Column:
    body = F.regexp_extract(tail, rf"(?ismdU)\A(.*?)(?:^\s*{AFTER_OPERATIVE}|\z)", 1)
    rows = F.filter(F.transform(T.lines(body), T.normalize_whitespace), lambda x: (x != "") & ~x.rlike(r"(?iU)^(?:\d+|[-–—]+|Mengadili\s*:?|Menetapkan\s*:?)$"))
    number = r"(?U)^\d+[.)](?!\d)\s*"

    def grouped(rows: Column) -> Column:
        kind = F.transform(rows, lambda x: F.when(x.rlike(r"(?iU)^(?:Dalam (?:Provisi|Pokok Permohonan|Eksepsi)|DALAM POKOK)"), "h").when(x.rlike(number), "n").otherwise("t"))
        starts = F.filter(F.transform(kind, lambda k, i: F.when((k == "n") | (k == "h") | (i == 0), F.struct((i + 1).alias("at"), (k == "h").cast("int").alias("skip")))), lambda i: i.isNotNull())

        def item(rows: Column, at: Column, s: Column, k: Column) -> Column:
            first, end = s["at"] + s["skip"], F.coalesce(F.get(at, k + 1)["at"], F.size(rows) + 1)
            taken = F.transform(F.slice(rows, first, end - first), lambda x: F.regexp_replace(x, number, ""))
            return F.regexp_replace(T.normalize_whitespace(F.array_join(taken, " ")), r"(?U)\s+([;,.])", "$1")

        return T.let(starts, lambda at: F.transform(at, lambda s, k: item(rows, at, s, k)))

    items = _present(T.let(rows, grouped))
    return T.let(items, lambda d: F.struct(document_type.alias("decision_type"), d.alias("dictum"), F.get(d, F.lit(0)).alias("summary")))


def signature_names(text: Column) -> Column:
    rows = F.transform(T.lines(text), lambda x: F.btrim(T.normalize_whitespace(F.regexp_replace(x, r"(?iU)\bttd\.?", "")), F.lit(" ,")))
    fine = F.filter(
        rows,
        lambda x: (x != "") & (F.length(x) <= 80) & (F.size(F.split(x, " ")) <= 8) & ~x.rlike(r"(?iU)\d|ketua|anggota|panitera|salinan|putusan|sekretaris") & x.rlike(r"(?U)^[A-ZÀ-Ý][\w .,’'\-]+$"),
    )
    return F.array_distinct(fine)


def adjudicators(text: Column, low: Column | None = None) -> Column:
    """struct<judges, clerks> of the signed panel after the last chair."""
    signed = _if_told(F.lower(text) if low is None else low, ["ketua"], F.regexp_extract(text, r"(?ismdU)\A.*^\s*KETUA\s*,?\s*$(.*)\z", 1), F.lit(""))
    clerk = r"^\s*PANITERA(?:\s+PENGGANTI)?\s*,?\s*$"
    return F.struct(signature_names(F.regexp_extract(signed, rf"(?ismdU)\A(.*?)(?:{clerk}|\z)", 1)).alias("judges"), signature_names(F.regexp_extract(signed, rf"(?ismdU){clerk}(.*)\z", 1)).alias("clerks"))


def relations(text: Column, sections: Column, numbers: Column | None = None) -> Column:
    numbers = T.extract_case_numbers(_whole(text, sections)) if numbers is None else numbers
    return F.struct(numbers.alias("joined_cases"), numbers.alias("referenced_cases"))


#: Parts of a record by name: each gets the columns with the text, the sections and the document's facts. Those here also use the columns that
#: ``parse_documents`` computes once for all of them.
EXTRACTORS: dict[str, Callable[[Column, Column, Column], Column]] = {
    "parties": lambda t, s, d: parties(t, s, F.col("_lines"), F.col("_opening"), F.col("_body"), F.col("_low")),
    "legal_basis": lambda t, s, d: legal_basis(t, s, F.col("_whole"), F.col("_numbers"), F.col("_low")),
    "proceedings": lambda t, s, d: proceedings(t, s, F.col("_joined"), F.col("_low")),
    "outcome": lambda t, s, d: outcome(t, d["document_type"], F.col("_low")),
    "adjudicators": lambda t, s, d: adjudicators(t, F.col("_low")),
    "relations": lambda t, s, d: relations(t, s, F.col("_numbers")),
}


def _pinned(value: Column) -> Column:
    """A struct as a value of ``let``: one that is only taken apart later would be merged into every use of its fields and computed for each."""
    return T.let(F.lit(0), lambda _: value)


def guarded(function: Callable, kind: str) -> Callable[[Column, Column, Column], Column]:
    """An extractor from a Python function of (text, sections, document): where it raises, the part is null and the record tells its failure."""

    @F.udf(returnType=f"struct<value: {kind}, error: string>")
    def run(text: str, sections: list, document: dict) -> tuple:
        try:
            return function(text, sections, document), None
        except Exception as failure:  # noqa: BLE001 - whatever the extractor raises goes to its row
            return None, str(failure)

    def extractor(text: Column, sections: Column, document: Column) -> Column:
        return run(text, sections, document)

    extractor.guarded = True
    return extractor


def _facts(docs: DataFrame, text: str, extractors: dict[str, Callable], skip: str | None = None) -> DataFrame:
    """Source, sections, document and what the extractors find, with ``_skip`` if there is such a column."""
    body = F.coalesce(F.col(text), F.lit(""))
    have = set(docs.columns)
    source = F.struct(
        *[(F.col(c) if c in have else F.lit(None)).cast(kind).alias(name) for c, name, kind in (("pdf_path", "pdf_path", "string"), ("file_name", "file_name", "string"), ("page_count", "page_count", "int"), ("engine", "text_extraction_engine", "string"), ("download_url", "download_url", "string"))]
    )
    skipped = [F.coalesce(F.col(skip), F.array().cast("array<struct<name:string,error:string>>")).alias("_skip")] if skip else []
    out = docs.select(F.lit(SCHEMA_VERSION).alias("schema_version"), source.alias("source"), body.alias("_text"), *skipped)
    out = out.withColumns({"_low": F.lower("_text"), "_lines": T.lines(F.col("_text")), "sections": split_sections(F.col("_text"))})
    t, s = F.col("_text"), F.col("sections")
    out = out.withColumns({"document": document_info(t, F.col("_lines"), F.col("_low")), "_opening": opening_block(t, F.col("_lines"), F.col("_low")), "_body": section_body(s), "_whole": _whole(t, s), "_joined": _whole(t, s, "\n")})
    out = out.withColumn("_numbers", T.extract_case_numbers(F.col("_whole")))
    parts = {name: f(t, s, F.col("document")) for name, f in extractors.items()}
    if skip:
        parts = {name: F.when(~F.array_contains(F.transform("_skip", lambda x: x["name"]), name), part) for name, part in parts.items()}
    return out.withColumns({n: c if getattr(extractors[n], "guarded", False) else _pinned(c) for n, c in parts.items()}).drop("_text", "_low", "_lines", "_opening", "_body", "_whole", "_joined", "_numbers")


def parse_documents(docs: DataFrame, text: str = "text", extractors: dict[str, Callable] = EXTRACTORS, schema: str | None = None, skip: str | None = None) -> DataFrame:
    """One record for each row of (file_name, text[, pdf_path, page_count, engine]): source, facts, checks and status. A null text is an empty one.

    With ``schema``, the text of a JSON Schema, records are checked against it as raw JSON. What a ``guarded`` extractor can't do fails no row but its
    own: the part is null, and ``parser`` names it. ``skip`` names a column, array<struct<name, error>>, of extractors that aren't run for a row and count as failed.
    """
    out = _facts(docs, text, extractors, skip)
    mine = [name for name, f in extractors.items() if getattr(f, "guarded", False)]
    failed = F.filter(F.array(*[F.when(F.col(f"{n}.error").isNotNull(), F.struct(F.lit(n).alias("name"), F.col(f"{n}.error").alias("error"))) for n in mine]), lambda x: x.isNotNull()) if mine else None
    if mine:
        out = out.withColumn("_failed", failed).withColumns({n: F.col(f"{n}.value") for n in mine})
        failed = F.col("_failed")
    if skip:
        out = out.withColumn("_failed", F.concat("_skip", failed) if mine else F.col("_skip"))
        failed = F.col("_failed")
    records = validate.with_parser(validate.with_validation(out), failed)
    if schema is not None:
        whole = F.struct(*[c for c in records.columns if c not in ("_failed", "_skip")])
        again = records.withColumn("_errors", validate.record_errors(whole, schema)).drop("parser")
        records = validate.with_parser(validate.with_validation(again, F.col("_errors")), failed).drop("_errors")
    return records.drop("_failed", "_skip")


def raising_rows(rows: DataFrame, key: str, compute: Callable[[DataFrame], DataFrame], most: int = 1000, fan: int = 16) -> list[tuple]:
    """(key, error) of the rows for which what ``compute`` makes of a table raises; ``most`` at most, more are a fault of the function and raised.

    Tasks fail as a whole, so rows are told apart by trying ever smaller parts of the table, ``fan`` of each part that fails. A part that fails is stored before
    its own parts are tried, so each try reads a sixteenth of what the one before read.
    """
    spark = rows.sparkSession
    folder = f"{shared_folder(spark)}/quillframe-raising-{uuid.uuid4().hex}"

    def error_of(part: DataFrame) -> str | None:
        try:
            compute(part).write.format("noop").mode("overwrite").save()
        except PySparkException as failure:
            return next((line for line in str(failure).splitlines() if line.startswith("[")), str(failure).strip().splitlines()[0])
        return None

    found, todo = [], [(rows, 0, error_of(rows))]
    while todo:
        part, level, error = todo.pop()
        if error is None:
            continue
        few = part.select(key).distinct().limit(2).collect()
        if len(few) == 1:
            found.append((few[0][0], error))
            if len(found) > most:
                raise RuntimeError(f"more than {most} rows fail, such as {found[0][0]}: {error}")
            continue
        for n in range(fan):
            chosen = part.where(F.pmod(F.xxhash64(F.col(key), F.lit(level)), F.lit(fan)) == n)
            if (wrong := error_of(chosen)) is not None:
                path = f"{folder}/{level}-{uuid.uuid4().hex}"
                chosen.write.parquet(path)
                todo.append((spark.read.schema(chosen.schema).parquet(path), level + 1, wrong))
    return found


def parse_isolated(docs: DataFrame, key: str = "file_name", text: str = "text", extractors: dict[str, Callable] = EXTRACTORS, schema: str | None = None, most: int = 1000, fan: int = 16) -> DataFrame:
    """``parse_documents`` of documents some of which make an extractor raise: such a part is null, ``parser`` tells it as failed, and all else is as it would be.

    First the extractors are run as one, which is all there is to do if none raises. Else each is run alone, and the rows that it fails for are looked for
    (``raising_rows``). The records that are returned leave those out, for these extractors only.
    """
    spark = docs.sparkSession
    whole = lambda part: _facts(part, text, extractors).select(*extractors)
    try:
        whole(docs).write.format("noop").mode("overwrite").save()
        return parse_documents(docs, text, extractors, schema)
    except PySparkException:
        found = [(k, name, error) for name, f in extractors.items() for k, error in raising_rows(docs, key, lambda part, n=name, f=f: _facts(part, text, {n: f}).select(n), most, fan)]
    kind = docs.schema[key].dataType.simpleString()
    skip = spark.createDataFrame(found, f"_key {kind}, name string, error string").groupBy("_key").agg(F.collect_list(F.struct("name", "error")).alias("_skipped"))
    return parse_documents(docs.join(F.broadcast(skip), F.col(key) == F.col("_key"), "left"), text, extractors, schema, "_skipped")  # at most ``most`` rows an extractor


def manual_truth_template(records: DataFrame) -> DataFrame:
    """A template for checking a record by hand, from records."""
    names = lambda group: F.transform(F.col(f"parties.{group}"), lambda p: p["name"])
    return records.select(
        F.col("source.file_name").alias("source_file"),
        F.lit("needs_annotation").alias("status"),
        F.struct(
            *[F.col(f"document.{c}").alias(c) for c in ("document_type", "case_number", "decision_date")],
            *[names(g).alias(g) for g in ("applicants", "legal_counsels", "respondents")],
            *[F.col(f"legal_basis.{c}").alias(c) for c in ("constitutional_articles", "procedural_articles")],
            F.col("outcome.summary").alias("outcome_summary"),
            F.col("outcome.dictum").alias("outcome_dictum"),
        ).alias("verified_fields"),
        F.lit("").alias("notes"),
        F.lit(False).alias("accept_parser_output"),
    )
