"""License scans by template markup.

A template is wording with marks: ``<<beginOptional>> .. <<endOptional>>`` may be absent (marks nest), and ``<<var;name="..";original="..";match="..">>``
may be replaced by other words. ``match=".+"`` accepts any words, at least one, ``".*"`` any or none, and any other expression one word or more
that each match it as a whole. All other wording is mandatory and must match word by word. Letters A-Z count as a-z, and whatever is no ASCII
letter or digit and no other character beyond ASCII parts words.

Templates are compiled into one automaton over words, whose states are sets of places in templates; they are made when a text first
leads there. A text is read once, whole. Where a template ends, its automaton is run backwards to tell where it began.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import private, small_batches, table

#: Words of a replaceable region at most.
VAR_WORDS = 16
#: States and known words of an automaton that are kept at most before they are made anew.
MOST_STATES, MOST_WORDS = 20_000, 500_000
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_MARK = re.compile(r"<<(.*?)>>", re.DOTALL)
_MATCH = re.compile(r'match="(.*?)"(?:;|$)', re.DOTALL)


@dataclass(frozen=True)
class Template:
    """Wording with marks, and the label that a text gets by it; ``base`` templates are plain phrases, reported apart."""

    label: str
    markup: str
    base: bool = False


#: The phrases that every scan of the query looks for.
PHRASES = (
    Template("mit", "mit license", base=True),
    Template("apache", "apache license", base=True),
    Template("gpl", "general public license", base=True),
)

#: Wording of public licenses and of usual notices.
TEMPLATES = (
    Template("apache-2.0", "licensed under <<beginOptional>>the<<endOptional>> apache license <<beginOptional>>version<<endOptional>> 2.0"),
    Template("bsd", "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("cc-by-nc", 'licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>creative commons<<endOptional>> cc by nc <<var;name="version";original="4.0";match="[0-9]+">>'),
    Template("copyright", 'copyright <<beginOptional>>(c)<<endOptional>> <<var;name="years";original="2024";match="(19|20)[0-9]{2}">> <<beginOptional>>by<<endOptional>> <<var;name="holder";original="the authors";match=".+">> all rights reserved'),
    Template("gpl-3.0", "licensed under the <<beginOptional>>terms of the<<endOptional>> <<beginOptional>>gnu<<endOptional>> general public license <<beginOptional>>as published by the free software foundation<<endOptional>> <<beginOptional>>either<<endOptional>> version 3"),
    Template("isc", "permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    Template("mit", '<<beginOptional>>this work is<<endOptional>> released under the <<var;name="kind";original="";match=".*">> mit license'),
    Template(
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of <<var;name="software";original="this software and associated documentation files";match=".+">>
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,
        sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or
        substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
        WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;name="holders";original="the authors or copyright holders";match=".+">>
        BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
        SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    Template("spdx", 'spdx license identifier <<var;name="identifier";original="mit";match=".+">>'),
)


def words_of(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))


class _Places:
    """The places of all templates: what leads from each to the next, with or without a word, forwards and backwards."""

    def __init__(self, templates: Sequence[Template], var_words: int):
        self.free: list[list[int]] = []
        self.edges: list[list[tuple]] = []
        self.patterns: list[re.Pattern] = []
        self.ends = [self._template(t, var_words) for t in templates]
        self.back_free: list[list[int]] = [[] for _ in self.free]
        self.back_edges: list[list[tuple]] = [[] for _ in self.free]
        for place, following in enumerate(self.free):
            for to in following:
                self.back_free[to].append(place)
        for place, following in enumerate(self.edges):
            for accepts, to in following:
                self.back_edges[to].append((accepts, place))

    def _new(self) -> int:
        self.free.append([])
        self.edges.append([])
        return len(self.free) - 1

    def _step(self, place: int, accepts: object) -> int:
        to = self._new()
        self.edges[place].append((accepts, to))
        return to

    def _template(self, template: Template, var_words: int) -> tuple[int, int]:
        """(first, last) place of a template."""
        first = place = self._new()
        open_: list[int] = []
        for i, part in enumerate(_MARK.split(template.markup)):
            if i % 2 == 0:
                for word in words_of(part):
                    place = self._step(place, word)
            elif part == "beginOptional":
                open_.append(place)
            elif part == "endOptional":
                if not open_:
                    raise ValueError(f"template {template.label}: endOptional without beginOptional")
                after = self._new()
                self.free[place].append(after)
                self.free[open_.pop()].append(after)
                place = after
            elif part.startswith("var") and (match := _MATCH.search(part)):
                place = self._var(place, match[1], var_words)
            else:
                raise ValueError(f"template {template.label}: unknown mark {part!r}")
        if open_:
            raise ValueError(f"template {template.label}: beginOptional without endOptional")
        if self._reaches(first, place):
            raise ValueError(f"template {template.label} has no mandatory wording")
        return first, place

    def _var(self, place: int, match: str, var_words: int) -> int:
        after = self._new()
        if match == ".*":
            self.free[place].append(after)
        if match in (".*", ".+"):
            accepts: object = None
        else:
            self.patterns.append(re.compile(match.encode()))
            accepts = len(self.patterns) - 1
        for _ in range(var_words):
            place = self._step(place, accepts)
            self.free[place].append(after)
        return after

    def _reaches(self, place: int, wanted: int) -> bool:
        return wanted in closure({place}, self.free)


def closure(places: set[int], free: list[list[int]]) -> frozenset[int]:
    """The places, and all that they lead to without a word."""
    found, todo = set(places), list(places)
    while todo:
        for to in free[todo.pop()]:
            if to not in found:
                found.add(to)
                todo.append(to)
    return frozenset(found)


class Scanner:
    """The automaton of some templates. A word's kind is the literal that it is (or none) and the expressions that it matches."""

    def __init__(self, templates: Sequence[Template], var_words: int = VAR_WORDS):
        self.templates = tuple(templates)
        self.places = _Places(self.templates, var_words)
        self.starts = closure({a for a, _ in self.places.ends}, self.places.free)
        self.literals = {accepts for edges in self.places.edges for accepts, _ in edges if isinstance(accepts, bytes)}
        self.kinds: list[tuple[bytes | None, frozenset[int]]] = []
        self.kind_numbers: dict[tuple, int] = {}
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.states: list[frozenset[int]] = []
        self.numbers: dict[frozenset[int], int] = {}
        self.next: list[dict[int, int]] = []
        self.done: list[tuple[int, ...]] = []
        self._state(self.starts)

    def _state(self, places: frozenset[int]) -> int:
        if places not in self.numbers:
            self.numbers[places] = len(self.states)
            self.states.append(places)
            self.next.append({})
            self.done.append(tuple(k for k, (_, last) in enumerate(self.places.ends) if last in places))
        return self.numbers[places]

    def kind(self, word: bytes) -> int:
        found = (word if word in self.literals else None, frozenset(i for i, p in enumerate(self.places.patterns) if p.fullmatch(word)))
        if found not in self.kind_numbers:
            self.kind_numbers[found] = len(self.kinds)
            self.kinds.append(found)
        return self.kind_numbers[found]

    def _accepts(self, accepts: object, kind: int) -> bool:
        literal, matched = self.kinds[kind]
        return accepts is None or (accepts in matched if isinstance(accepts, int) else accepts == literal)

    def _after(self, places: frozenset[int], kind: int, edges: list[list[tuple]], free: list[list[int]]) -> frozenset[int]:
        return closure({to for p in places for accepts, to in edges[p] if self._accepts(accepts, kind)}, free)

    def find(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(template, first word, last word), sorted: of the matches of a template that begin at one word the longest, from its earliest possible beginning."""
        if len(self.states) > MOST_STATES or len(self.known) > MOST_WORDS:
            self._forget()
        known, kind = self.known, self.kind
        kinds = []
        for word in words:
            if (k := known.get(word)) is None:
                k = known[word] = kind(word)
            kinds.append(k)
        at, longest = 0, {}
        following, done = self.next, self.done
        for i, k in enumerate(kinds):
            to = following[at].get(k)
            if to is None:
                to = following[at][k] = self._state(self._after(self.states[at], k, self.places.edges, self.places.free) | self.starts)
            at = to
            for template in done[at]:
                longest[template, self._first(template, kinds, i)] = i
        return sorted((template, first, last) for (template, first), last in longest.items())

    def _first(self, template: int, kinds: list[int], last: int) -> int:
        """The earliest word at which the template's match that ends with ``last`` can begin."""
        begin, end = self.places.ends[template]
        now, at, found = closure({end}, self.places.back_free), last, last
        while now and at >= 0:
            now = self._after(now, kinds[at], self.places.back_edges, self.places.back_free)
            if begin in now:
                found = at
            at -= 1
        return found


_FOUND = "n_words long, places array<struct<label:string,base:boolean,first:long,last:long>>"


def _scan(templates: Sequence[Template], var_words: int):
    made: list[Scanner] = []

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if not made:
            made.append(Scanner(templates, var_words))
        kind = pa.struct([("n_words", pa.int64()), ("places", pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("first", pa.int64()), ("last", pa.int64())])))])
        for batch in texts:
            rows = []
            for text in batch:
                words = words_of(text.as_py())
                rows.append({"n_words": len(words), "places": [{"label": templates[t].label, "base": templates[t].base, "first": a, "last": b} for t, a, b in made[0].find(words)]})
            yield pa.array(rows, kind)

    return run


def scan_licenses(df: DataFrame, templates: Sequence[Template] = PHRASES + TEMPLATES, text: str = "text", var_words: int = VAR_WORDS) -> DataFrame:
    """Add n_words and places (label, base, first and last word, from 0) of every template found in the whole text; places come by template, then word.

    Input columns of these names are replaced; all others, whatever their names, and repeated rows stay. Null and empty texts have no words and no places.
    Matches may overlap, those of one template, too; of those that begin at one word the longest counts. Of beginnings for one end the earliest counts.
    A template without mandatory wording is an error. An empty table gives an empty one.
    """
    small_batches(df.sparkSession)
    found = private(df, "_found")
    scan = F.arrow_udf(_scan(tuple(templates), var_words), _FOUND)
    names = [c for c in df.columns if c.lower() not in ("n_words", "places")]
    return df.withColumn(found, scan(F.col(text))).select(*[F.col(f"`{c}`") for c in names], F.col(found)["n_words"].alias("n_words"), F.col(found)["places"].alias("places"))


def joined_labels(places: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: words, places of the base phrases and their labels, all labels, and a score: 1 if a template is found, else 0.5 if a base phrase is, else 0."""
    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base, places = F.filter("places", lambda p: p["base"]), F.col("places")
    first = F.transform(base, lambda p: p["first"])
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(first).alias("first_word"),
        F.array_max(first).alias("last_word"),
        joined_labels(base).alias("base_labels"),
        joined_labels(places).alias("labels"),
        F.when(F.exists(places, lambda p: ~p["base"]), 1.0).when(F.size(places) > 0, 0.5).otherwise(0.0).alias("score"),
    )


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS s,
  list_filter(range(1, len(w)), lambda i: w[i] = 'mit' AND w[i + 1] = 'license') AS m,
  list_filter(range(1, len(w)), lambda i: w[i] = 'apache' AND w[i + 1] = 'license') AS a,
  list_filter(range(1, len(w) - 1), lambda i: w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license') AS g FROM w),
t AS (SELECT *, [CASE WHEN len(m) > 0 THEN 'mit' END, CASE WHEN len(a) > 0 THEN 'apache' END, CASE WHEN len(g) > 0 THEN 'gpl' END] AS base, [
  CASE WHEN regexp_matches(s, ' licensed under (the )?apache license (version )?2 0 ') THEN 'apache-2.0' END,
  CASE WHEN contains(s, ' redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met ') THEN 'bsd' END,
  CASE WHEN regexp_matches(s, ' licensed under (a )?(creative commons )?cc by nc [0-9]+ ') THEN 'cc-by-nc' END,
  CASE WHEN regexp_matches(s, ' copyright (c )?((19|20)[0-9]{2} ){1,16}(by )?([^ ]+ ){1,16}all rights reserved ') THEN 'copyright' END,
  CASE WHEN regexp_matches(s, ' licensed under the (terms of the )?(gnu )?general public license (as published by the free software foundation )?(either )?version 3 ') THEN 'gpl-3.0' END,
  CASE WHEN regexp_matches(s, ' permission to use copy modify and (or )?distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies ') THEN 'isc' END,
  CASE WHEN regexp_matches(s, ' released under the ([^ ]+ ){0,16}mit license ') THEN 'mit' END,
  CASE WHEN regexp_matches(s, ' permission is hereby granted free of charge to any person obtaining a copy of ([^ ]+ ){1,16}the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice (including the next paragraph )?shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall ([^ ]+ ){1,16}be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software ') THEN 'mit' END,
  CASE WHEN regexp_matches(s, ' spdx license identifier [^ ]+ ') THEN 'spdx' END] AS own FROM b)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(m) + len(a) + len(g))::BIGINT AS n_base,
  list_min(m || a || g) - 1 AS first_word, list_max(m || a || g) - 1 AS last_word,
  array_to_string(list_sort(list_filter(base, lambda x: x IS NOT NULL)), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_filter(base || own, lambda x: x IS NOT NULL))), ',') AS labels,
  CASE WHEN len(list_filter(own, lambda x: x IS NOT NULL)) > 0 THEN 1.0 WHEN len(m || a || g) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score
FROM t
"""
