"""Column functions for text: spaces, lines, identifiers, dates, names and slugs. All of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space and line ends as Unicode-aware text tools see them, and the vocabulary of Indonesian dates and rulings.
SPACE = r"(?U)[\s\x1c-\x1f]"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
ODD_LINE_END = "[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
#: Runs of white space but single blanks, which stay as they are.
NOT_ONE_BLANK = r"(?U)(?:[\s\x1c-\x1f&&[^ ]]| (?=[\s\x1c-\x1f]))[\s\x1c-\x1f]*"
MONTHS = ["januari", "februari", "maret", "april", "mei", "juni", "juli", "agustus", "september", "oktober", "november", "desember"]
SMALL_NUMBERS = ["nol", "satu", "dua", "tiga", "empat", "lima", "enam", "tujuh", "delapan", "sembilan", "sepuluh", "sebelas"]
NUMBER_WORD = "(?:" + "|".join([*SMALL_NUMBERS, "belas", "puluh", "ratus", "ribu"]) + ")"
NUMBER = rf"(?:\d+|{NUMBER_WORD}(?:\s+{NUMBER_WORD})*)"
DATE = rf"(?iuU)({NUMBER})\s*,?\s*(?:bulan\s+)?({'|'.join(MONTHS)})\s*,?\s*(?:tahun\s+)?({NUMBER})\b"
CASE_NUMBER = r"(?iU)\d+/\s*[A-Z0-9\-./ ]+/\s*\d{4}"
ARTICLE = (
    r"(?iU)pasal\s+\d+[A-Z]?(?:\s+ayat\s*\(\d+\))?(?:\s+h\.?u\.?f?\s*[a-z])?"
    r"(?:\s+undang-undang\s+dasar\s+negara\s+republik\s+indonesia\s+tahun\s+1945|uud\s*1945|uud\s*nkri\s*tahun\s*1945)?"
)
ROLES = "pemohon|termohon|pemerintah|dpr|presiden|pihak terkait|kuasa hukum|ahli|saksi|amicus curiae"
REPRESENTED = [r"\s+yang\s+dalam\s+hal\s+ini\b", r"\s+yang\s+diwakili\b", r"\s+selaku\b"]
FIRST_YEAR, LAST_YEAR = 1900, 2100


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body and its lambdas name it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def nullif_empty(c: Column) -> Column:
    return F.when(c != "", c)


def normalize_whitespace(c: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(c, NOT_ONE_BLANK, " "))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def lines(c: Column) -> Column:
    """The lines of a text; an ending line end starts no line, an empty text has none. Null is an empty text."""
    # A split at one plain character needs no regular expression.
    parts = let(F.coalesce(c, F.lit("")), lambda t: F.when(t.rlike(ODD_LINE_END), F.split(t, LINE_END, -1)).otherwise(F.split(t, "\n", -1)))
    return let(parts, lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p))


def ordered_distinct(c: Column, key: Callable[[Column], Column] | None = None) -> Column:
    """The first of all elements with one key, in order."""
    if key is None:
        return F.array_distinct(c)

    def first_of_each(items: Column) -> Column:
        """Sorted by (key, place), the first of each run of keys; then by place again: no element is compared with all."""
        placed = F.array_sort(F.transform(items, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"))))
        firsts = let(placed, lambda s: F.filter(s, lambda x, j: (j == 0) | ~F.get(s, j - 1)["k"].eqNullSafe(x["k"])))
        return F.transform(F.array_sort(F.transform(firsts, lambda x: x["i"])), lambda i: F.get(items, i))

    return let(c, first_of_each)


def normalize_case_number(c: Column, pattern: str = CASE_NUMBER) -> Column:
    """The first identifier in a text without white space; null if there is none."""
    return nullif_empty(F.regexp_replace(F.regexp_extract(F.replace(c, F.lit("\n"), F.lit(" ")), pattern, 0), f"{SPACE}+", ""))


def extract_case_numbers(c: Column, pattern: str = CASE_NUMBER) -> Column:
    """All identifiers in a text without white space, each once, in order."""
    found = F.regexp_extract_all(F.replace(c, F.lit("\n"), F.lit(" ")), F.lit(pattern), 0)
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, f"{SPACE}+", "")))


def number_of(c: Column) -> Column:
    """A number in digits or in words: tens, hundreds and thousands multiply what was said before them."""
    word = F.split(c, f"{SPACE}+")
    small = F.create_map(*[x for i, w in enumerate(SMALL_NUMBERS) for x in (F.lit(w), F.lit(i))])

    def step(acc: Column, w: Column) -> Column:
        now = acc["now"]
        value = (
            F.when(w == "belas", now + 10)
            .when(w == "puluh", now * 10)
            .when(w == "ratus", now * 100)
            .when(w == "ribu", F.lit(0))
            .otherwise(now + F.coalesce(small[w], F.lit(0)))
        )
        return F.struct(F.when(w == "ribu", acc["total"] + now * 1000).otherwise(acc["total"]).alias("total"), value.alias("now"))

    spelled = F.aggregate(word, F.struct(F.lit(0).alias("total"), F.lit(0).alias("now")), step, lambda acc: acc["total"] + acc["now"])
    return F.when(c.rlike(r"^\d+$"), c.try_cast("int")).when(c != "", spelled)


def normalize_date(c: Column) -> Column:
    """The first date of a text as ISO text; null without one, if it isn't a day of the calendar, or outside 1900 to 2100."""
    text = normalize_whitespace(F.lower(c))
    day, month, year = (F.regexp_extract(text, DATE, i) for i in (1, 2, 3))
    y = number_of(year)
    iso = F.format_string("%04d-%02d-%02d", y, F.array_position(F.array(*map(F.lit, MONTHS)), month).cast("int"), number_of(day))
    return F.when((month != "") & y.between(FIRST_YEAR, LAST_YEAR), F.date_format(F.try_to_date(iso, "yyyy-MM-dd"), "yyyy-MM-dd"))


def cut_representation(c: Column) -> Column:
    """What stands before a clause that says who acts for someone."""
    for clause in REPRESENTED:
        c = F.regexp_extract(c, rf"(?isU)\A(.*?)(?:{clause}|\z)", 1)
    return c


def normalize_party_name(c: Column) -> Column:
    """A name without numbering, role prefix and representation clause."""
    name = F.regexp_replace(normalize_whitespace(c), r"(?U)\A(\d+[\.\)]\s*)+", "")
    name = F.regexp_replace(name, rf"(?iuU)\A({ROLES})\s*[:\-]?\s*", "")
    return F.btrim(cut_representation(name), F.lit(" ,;:-."))


def normalize_article(c: Column) -> Column:
    """The first article reference; null if there is none."""
    found = normalize_whitespace(F.regexp_extract(F.replace(c, F.lit("\n"), F.lit(" ")), ARTICLE, 0))
    return nullif_empty(F.replace(F.replace(found, F.lit("h. u. f."), F.lit("huruf")), F.lit("h u f"), F.lit("huruf")))


def slugify(c: Column, empty: str = "section") -> Column:
    """Lower-case letters and digits joined by single dashes."""
    return F.coalesce(nullif_empty(F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))), F.lit(empty))


def first_rule(c: Column, rules: list[tuple[Column, str]], default: str) -> Column:
    """The label of the first rule that holds; rules are ordered."""
    out = F.lit(default)
    for condition, label in reversed(rules):
        out = F.when(condition, F.lit(label)).otherwise(out)
    return F.when(c.isNull(), F.lit(default)).otherwise(out)


def classify_outcome(summary: Column) -> Column:
    """One of eight classes of a ruling's summary, by ordered rules."""
    t = F.lower(F.coalesce(summary, F.lit("")))
    inadmissible, granted = t.contains("tidak dapat diterima"), t.startswith("mengabulkan")
    return first_rule(
        F.lit(""),
        [
            (t.contains("penarikan") | t.contains("ditarik kembali") | t.contains("dicabut"), "withdrawn"),
            (t.contains("gugur"), "dismissed"),
            (inadmissible & t.contains("menolak") & ~granted, "mixed"),
            (inadmissible, "inadmissible"),
            (granted & t.contains("sebagian"), "granted_partly"),
            (granted, "granted"),
            (t.startswith("menolak"), "rejected"),
        ],
        "unknown",
    )


#: Roman numerals by size.
ROMAN = [(1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")]
SESSION_BASE = 2002


def to_roman(n: Column) -> Column:
    """A positive integer as a Roman numeral; others raise an error."""
    parts, rest = [], n.cast("long")
    for value, letters in ROMAN:
        parts.append(F.repeat(F.lit(letters), (rest / value).cast("int")))
        rest = rest % value
    return F.when(n <= 0, F.raise_error(F.lit("Roman numerals start at 1"))).otherwise(F.concat(*parts))


def build_case_number(sequence: Column, kind: Column, year: Column) -> Column:
    return F.concat(sequence.cast("string"), F.lit("/"), kind, F.lit("-"), to_roman(year - SESSION_BASE), F.lit("/"), year.cast("string"))


def slugify_case_number(c: Column) -> Column:
    return F.translate(F.regexp_replace(c, r"[^A-Za-z0-9\-_/]+", ""), "/", "_")


def url_component(c: Column) -> Column:
    """Percent-encoding of everything but letters, digits, ``_.-~``."""
    return F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def tracking_url(base: str, case_number: Column, page: str) -> Column:
    return F.concat(F.lit(f"{base}?id="), url_component(case_number), F.lit(f"&page={page}"))


def case_type_of(case_type: Column, case_number: Column) -> Column:
    """The type that a case states, else that in its number; null if there is neither."""
    return F.coalesce(nullif_empty(F.trim(case_type)), nullif_empty(F.regexp_extract(F.trim(case_number), r"/([A-Z]+)(?:-[A-Z0-9]+)?/", 1)))


def search_url(base: str, case_type: Column, case_number: Column, number: str = "search", kind: str = "jenis") -> Column:
    """A form's address that looks for a case by its number and, if one is known, its type; null without a number. Blanks are written as ``+``."""
    value = lambda c: F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    named, typed = nullif_empty(F.trim(case_number)), case_type_of(case_type, case_number)
    return F.concat(F.lit(f"{base}?{number}="), value(named), F.coalesce(F.concat(F.lit(f"&{kind}="), value(typed)), F.lit("")))


def file_name_of_url(c: Column) -> Column:
    """The last part of a URL's path; null if it has none."""
    path = F.regexp_extract(c, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    return nullif_empty(F.regexp_extract(path, r"([^/]+)/*$", 1))


def document_category(title: Column, url: Column) -> Column:
    """The kind of a linked file from its title and address, by ordered rules."""
    t, u = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(url, F.lit("")))
    return first_rule(
        F.lit(""),
        [
            (t.contains("putusan") | u.contains("download.putusan"), "decision"),
            (t.contains("permohonan") & t.contains("perbaikan"), "petition_revision"),
            (t.contains("permohonan"), "petition"),
            (t.contains("risalah") | ((t == "pdf") & u.contains("risalah")), "hearing_minutes_pdf"),
            ((t == "audio") | u.contains("audio"), "hearing_audio"),
            (t.contains("jadwal sidang"), "hearing_schedule"),
            (t == "ap3", "ap3"),
            (t == "arpk", "arpk"),
        ],
        "other",
    )


def is_challenge_page(html: Column, marks: list[str]) -> Column:
    """Whether a page holds one of the marks of a bot challenge, whatever their case."""
    text, out = F.lower(F.coalesce(html, F.lit(""))), F.lit(False)
    for mark in marks:
        out = out | text.contains(mark)
    return out


def url_key(c: Column) -> Column:
    """A URL without scheme and trailing slash, with a lower-case host and sorted query parameters: equal for equivalent URLs."""
    host = F.lower(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))
    path = F.regexp_replace(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1), "/+$", "")
    query = F.array_join(F.array_sort(F.split(F.regexp_extract(c, r"^[^?#]*\?([^#]*)", 1), "&")), "&")
    return F.concat(host, path, F.lit("?"), query)


def urls_equivalent(a: Column, b: Column, mark: str = "download.putusan") -> Column:
    """Whether two addresses lead to one file: equal keys, equal path and query, or one ``id`` on two pages that hold ``mark``."""
    tail = lambda u: F.regexp_replace(url_key(u), r"^[^/?]*", "")
    ident = lambda u: nullif_empty(F.regexp_extract(u, r"[?&]id=([^&#]*)", 1))
    marked = lambda u: F.lower(F.regexp_replace(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", "")).contains(mark)
    return (a == b) | (url_key(a) == url_key(b)) | (tail(a) == tail(b)) | F.coalesce((ident(a) == ident(b)) & marked(a) & marked(b), F.lit(False))


def display_date(iso: Column) -> Column:
    """``d Month yyyy`` in Indonesian; other texts stay as they are."""
    day = F.try_to_date(iso, "yyyy-MM-dd")
    month = F.element_at(F.array(*[F.lit(m.capitalize()) for m in MONTHS]), F.month(day))
    return F.coalesce(F.concat(F.dayofmonth(day).cast("string"), F.lit(" "), month, F.lit(" "), F.year(day).cast("string")), iso)


def label_of(c: Column, labels: dict[str, str]) -> Column:
    """A label from a fixed table, or the value itself."""
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair]) if labels else None
    return c if table is None else F.coalesce(table[c], c)


def pdf_link(has_pdf: Column, url: Column, file_name: Column, hosts: list[str], pattern: str, base: str) -> Column:
    """``stored``, a trusted download address, one built from a known file name, or null."""
    trusted = F.parse_url(url, F.lit("PROTOCOL")).eqNullSafe("https") & F.coalesce(F.parse_url(url, F.lit("HOST")).isin(hosts), F.lit(False)) & F.coalesce(F.parse_url(url, F.lit("PATH")).endswith(".pdf"), F.lit(False))
    return F.when(F.coalesce(has_pdf, F.lit(False)), "stored").when(trusted, url).when(file_name.rlike(f"^(?:{pattern})$"), F.concat(F.lit(base), file_name))


def in_app_return(c: Column, path: str) -> Column:
    """A return address: only ``path`` itself with its query is accepted, else ``path``."""
    fine = c.rlike(rf"^{path}(?:\?[^#]*)?(?:#.*)?$")
    return F.concat(F.lit(path), F.when(fine, F.regexp_extract(c, r"(\?[^#]+)", 1)).otherwise(F.lit("")), F.lit("#results"))
