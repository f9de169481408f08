"""Phrase collocations by suffix-sigma.

Every word begins a suffix, which ends after ``max_words`` words or with its piece of text. A worker takes half a million words at a time, sorts
their suffixes, adds up equal ones and sends them, packed, by language and first word. Whoever gets them sorts them in reverse
lexicographic order and counts all their prefixes, that is all phrases, with one stack. Parts of a phrase are at least as frequent as the phrase,
so they are joined to it from the same table of frequent phrases.

A frequent first word would be too much for one task. So suffixes are dealt by ranges of (language, words) in order, of about equal size, whose
borders come from a sample of suffixes; a range holds many rare first words or a part of a frequent one. The phrases that begin a border may
have suffixes on both sides. Those, ten for each border at most, are returned whatever their counts, and counts are summed.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, partitions, release_memory, small_batches, table

MAX_WORDS, LEAST, TOP = 5, 100, 2000
#: Words sorted at once: their numbers, doubled, fit in 21 bits.
CHUNK = 500_000
#: Bytes of text of a range, ranges at most (beyond 1 TB of text ranges grow, and their tasks' memory with them), sampled suffixes for each.
RANGE_BYTES, MAX_RANGES, SAMPLES = 8_000_000, 131_072, 24
#: Bytes of a border's word; borders need not be words.
BORDER_BYTES = 48
#: What ends a piece, what parts words.
UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
ENDS, BLANKS = b".,;:!?\x0a\x0b\x0c\x0d", b"\x20\x09"
_CLEAN = bytes.maketrans(UPPER + ENDS + BLANKS, LOWER + b"\n" * len(ENDS) + b" " * len(BLANKS))
_BITS = 21

Border = tuple[str, tuple[bytes, ...]]


def cleaned(text: str | None) -> bytes:
    """Lower case, with a line feed for every end of a piece and a blank between words; a null is empty."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_CLEAN)


def words_of(data: bytes) -> tuple[list[bytes], np.ndarray]:
    """The words of cleaned bytes, and the number of each one's piece."""
    raw = np.frombuffer(data, np.uint8)
    inside = np.concatenate([[False], (raw != 0x20) & (raw != 0x0A)])
    starts = np.flatnonzero(inside[1:] & ~inside[:-1])
    return data.split(), np.cumsum(raw == 0x0A)[starts]


def suffixes(words: list[bytes], piece: np.ndarray, own: int, width: int) -> tuple[list[bytes], list[np.ndarray], np.ndarray]:
    """(vocabulary, keys, counts) of the distinct suffixes of the first ``own`` words, in order.

    A suffix's words are numbers of 21 bits, three to a key: word i of the sorted vocabulary is 2 i + 2, and 0 stands behind the end.
    """
    vocabulary = sorted(set(words))
    number = {w: 2 * i + 2 for i, w in enumerate(vocabulary)}
    ids = np.fromiter(map(number.__getitem__, words), np.uint64, len(words))
    keys = [np.zeros(own, np.uint64) for _ in range(-(-width // 3))]
    for k in range(width):
        column = np.zeros(own, np.uint64)
        n = min(own, len(ids) - k)
        if n > 0:
            column[:n] = np.where(piece[k : k + n] == piece[:n], ids[k : k + n], 0)
        keys[k // 3] |= column << np.uint64(_BITS * (2 - k % 3))
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    new = np.concatenate([np.ones(min(1, own), bool), np.logical_or.reduce([k[1:] != k[:-1] for k in keys])])
    begin = np.flatnonzero(new)
    return vocabulary, [k[begin] for k in keys], np.diff(np.concatenate([begin, [own]]))


def place(border: Sequence[bytes], vocabulary: list[bytes], keys: list[np.ndarray]) -> int:
    """How many of the sorted suffixes come before the border."""
    wanted = [0] * len(keys)
    for k, word in enumerate(border):
        i = bisect_left(vocabulary, word)
        known = i < len(vocabulary) and vocabulary[i] == word
        wanted[k // 3] |= (2 * i + 2 if known else 2 * i + 1) << _BITS * (2 - k % 3)
        if not known:  # between two words: nothing begins so
            break
    lo, hi = 0, len(keys[0])
    for key, value in zip(keys, wanted, strict=True):
        part = key[lo:hi]
        lo, hi = lo + int(np.searchsorted(part, np.uint64(value))), lo + int(np.searchsorted(part, np.uint64(value), side="right"))
    return lo


def _columns(keys: list[np.ndarray], width: int) -> np.ndarray:
    """The words of suffixes as rows of a matrix with a row for each place: i + 1 for word i, 0 behind the end."""
    return np.stack([(keys[k // 3] >> np.uint64(_BITS * (2 - k % 3)) & np.uint64((1 << _BITS) - 1)) // np.uint64(2) for k in range(width)], dtype=np.int32, casting="unsafe")


def _sent(borders: list[Border], width: int):
    """(range, lang, words, codes, counts): a worker's distinct suffixes, packed by range, each with the words it needs."""
    langs = [b[0] for b in borders]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                data = cleaned(text.as_py())
                held.setdefault(lang, []).append(data)
                size[lang] = size.get(lang, 0) + len(data)
                if sum(size.values()) >= 6 * CHUNK:
                    lang = max(size, key=size.get)
                    yield from pack(lang, held.pop(lang))
                    del size[lang]
        for lang, parts in held.items():
            yield from pack(lang, parts)
        release_memory()

    def pack(lang: str, parts: list[bytes]) -> Iterator[pa.RecordBatch]:
        words, piece = words_of(b"\n".join(parts))
        step = CHUNK - width
        first, last = bisect_left(langs, lang), bisect_right(langs, lang)
        for at in range(0, len(words), step):
            upto = min(at + step, len(words))
            vocabulary, keys, counts = suffixes(words[at : upto + width - 1], piece[at : upto + width - 1], upto - at, width)
            cuts = [0, *(place(b, vocabulary, keys) for _, b in borders[first:last]), len(counts)]
            columns = _columns(keys, width)
            rows = [(first + r, lang, *_packed(vocabulary, columns[:, lo:hi], counts[lo:hi])) for r, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if lo < hi]
            kinds = (pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["range", "lang", "words", "codes", "counts"])

    return run


def _packed(vocabulary: list[bytes], columns: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes, bytes]:
    used = np.zeros(len(vocabulary) + 1, bool)
    used[columns] = True
    used[0] = False
    mine = np.flatnonzero(used)
    renamed = np.cumsum(used)
    renamed[0] = 0
    codes = renamed[columns].astype("<u2" if len(mine) < 1 << 16 else "<u4")
    return b"\n".join([vocabulary[i - 1] for i in mine]), codes.tobytes(), counts.astype("<u4").tobytes()


def _merged(rows: list[tuple[bytes, bytes, bytes]], width: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(vocabulary, columns, counts): the packed suffixes together, equal ones added up, in reverse lexicographic order."""
    lists = [words.split(b"\n") if words else [] for words, _, _ in rows]
    vocabulary = sorted(set().union(*lists))
    number = {w: i + 1 for i, w in enumerate(vocabulary)}
    columns, counts = [], []
    for words, (_, codes, n) in zip(lists, rows, strict=True):
        n = np.frombuffer(n, "<u4").astype(np.int64)
        named = np.fromiter([0, *map(number.__getitem__, words)], np.int32, len(words) + 1)
        columns.append(named[np.frombuffer(codes, "<u2" if len(codes) == 2 * width * len(n) else "<u4").reshape(width, -1)])
        counts.append(n)
    c, n = np.concatenate(columns, axis=1), np.concatenate(counts)
    keys = [c[k].astype(np.int64) << 32 | (c[k + 1] if k + 1 < width else 0) for k in range(0, width, 2)]
    order = np.lexsort(keys[::-1])[::-1]
    keys = [k[order] for k in keys]
    begin = np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys])]))
    return vocabulary, c[:, order[begin]], np.add.reduceat(n[order], begin)


def prefix_counts(columns: np.ndarray, counts: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(suffix, length, count) of every prefix that comes ``least`` times or more, and of the empty one; suffixes come in reverse lexicographic order.

    One stack holds the counts of the prefixes of the suffix at hand. A prefix that the next suffix doesn't share is complete, and its count goes to the next shorter one.
    """
    equal = (columns[:, 1:] == columns[:, :-1]) & (columns[:, 1:] > 0)
    common = np.concatenate([[0], np.logical_and.accumulate(equal, axis=0).sum(axis=0)])
    stack, depth, out, i = [0] * (len(columns) + 1), 0, [], 0
    for i, (shared, length, n) in enumerate(zip(common.tolist(), (columns > 0).sum(axis=0).tolist(), counts.tolist(), strict=True)):
        while depth > shared:
            done = stack[depth]
            if done >= least:
                out.append((i - 1, depth, done))
            stack[depth] = 0
            depth -= 1
            stack[depth] += done
        depth = length
        stack[depth] += n
    while depth:
        done = stack[depth]
        if done >= least:
            out.append((i, depth, done))
        depth -= 1
        stack[depth] += done
    return [*out, (i, 0, stack[0])]


def _counted(borders: list[Border], least: int, width: int):
    """(lang, phrase, n) of the phrases of each range that are frequent or begin one of its borders; the empty phrase has all words."""

    def run(rows: pa.Table) -> pa.Table:
        number = rows.column("range")[0].as_py()
        found: list[tuple[str, str, int]] = []
        for lang in sorted(set(rows.column("lang").to_pylist())):  # a range may end one language and begin the next
            part = rows.filter(pc.equal(rows.column("lang"), lang))
            vocabulary, columns, counts = _merged(list(zip(*(part.column(c).to_pylist() for c in ("words", "codes", "counts")), strict=True)), width)
            open_ = {b[:k] for of, b in borders[max(0, number - 1) : number + 1] if of == lang for k in range(1, len(b) + 1)}
            for row, length, n in prefix_counts(columns, counts, least):
                phrase = tuple(vocabulary[c - 1] for c in columns[:length, row].tolist())
                if phrase not in open_:
                    found.append((lang, b" ".join(phrase).decode("utf-8", "surrogatepass"), n))
            for phrase in sorted(open_):
                at = [bisect_left(vocabulary, w) for w in phrase]
                if all(i < len(vocabulary) and vocabulary[i] == w for i, w in zip(at, phrase, strict=True)):
                    n = int(counts[np.logical_and.reduce([columns[k] == i + 1 for k, i in enumerate(at)])].sum())
                    if n:
                        found.append((lang, b" ".join(phrase).decode("utf-8", "surrogatepass"), n))
        release_memory()
        return pa.table([pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "phrase", "n"])

    return run


def _sampled(step: float, width: int):
    """(lang, words): suffixes at random places of the texts, about one in ``step`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, found = [], []
            for i, (lang, text) in enumerate(zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True)):
                data = cleaned(text.as_py())
                draw = np.random.default_rng([zlib.crc32(data), i])
                for at in draw.integers(0, max(1, len(data)), int(len(data) / step + draw.random())).tolist():
                    while at < len(data) and data[at] not in b" \n":  # to the end of a word
                        at += 1
                    while at < len(data) and data[at] in b" \n":  # to the next one
                        at += 1
                    end = data.find(b"\n", at)
                    if at < len(data):
                        langs.append(lang)
                        found.append([w[:BORDER_BYTES] for w in data[at : end if end >= 0 else len(data)].split(None, width)[:width]])
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(found, pa.list_(pa.binary()))], ["lang", "words"])

    return run


def range_borders(rows: DataFrame, width: int = MAX_WORDS, range_bytes: int = RANGE_BYTES) -> list[Border]:
    """Sorted borders that cut the suffixes of (lang, text) into ranges of about ``range_bytes`` of text each, from at most SAMPLES x MAX_RANGES sampled ones."""
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    ranges = min(MAX_RANGES, -(-size // range_bytes))
    if ranges < 2:
        return []
    drawn = rows.mapInArrow(_sampled(size / (ranges * SAMPLES), width), "lang string, words array<binary>").collect()
    keys = sorted((r["lang"], tuple(map(bytes, r["words"]))) for r in drawn)
    return sorted({keys[len(keys) * k // ranges] for k in range(1, ranges)}) if keys else []


def phrase_counts(df: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, max_words: int = MAX_WORDS, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(lang, phrase, n): every phrase of at most ``max_words`` words that comes ``least`` times or more in its language's texts, and the empty phrase with the number of all words."""
    small_batches(df.sparkSession)
    rows = df.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text")).where(F.length("text") > 0)
    borders = range_borders(rows, max_words, range_bytes)
    sent = rows.mapInArrow(_sent(borders, max_words), "range int, lang string, words binary, codes binary, counts binary")
    tasks = max(partitions(df.sparkSession), (len(borders) + 1) // 2)
    found = sent.repartition(tasks, "range").groupBy("range").applyInArrow(_counted(borders, least, max_words), "lang string, phrase string, n long")
    return found.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("phrase") == ""))


def collocations(df: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, max_words: int = MAX_WORDS, top: int = TOP, subsumed: int = 100, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of 2 to ``max_words`` words that come a >= ``least`` times.

    A phrase's score is the least, over its cuts in two, of floor(1000 a n / (l r)): l and r are the counts of the parts (those of the lowest cut, then the
    first, are returned), n that of all words of the language. Phrases inside a longer one that comes at least ``subsumed`` percent as often are left out.
    Ranks go by score, then count, descending, then by the phrase's bytes.

    A null language is ``und``. Null and empty texts have no words. Repeated rows count each. Extra columns don't matter, whatever their names; an
    empty table gives an empty one. Arithmetic is exact while a n stays under 10^34.
    """
    known = materialize(phrase_counts(df, text, lang, least, max_words, range_bytes))
    totals = known.where("phrase = ''").select("lang", F.col("n").alias("all"))
    split = F.split("phrase", " ")
    wide = known.where("phrase <> ''").select("lang", "phrase", F.col("n").alias("a"), split.alias("words")).where(F.size("words") > 1)
    cuts = wide.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("words", F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice("words", F.col("k") + 1, F.size("words")), " ").alias("rest"))
    left, right = known.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), known.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    met = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(totals, "lang")
    wide_numbers = {c: f"cast({c} as decimal(19,0))" for c in ("a", "all", "l", "r")}
    score = F.expr("(cast(1000 as decimal(4,0)) * {a} * {all}) div ({l} * {r})".format(**wide_numbers))
    lowest = met.withColumn("score", score).groupBy("lang", "phrase", "a", "all").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    spans = [(at, n) for n in range(2, max_words) for at in range(1, max_words - n + 2)]
    inner = F.array(*[F.when((F.size("words") > n) & (F.size("words") >= at + n - 1), F.array_join(F.slice("words", at, n), " ")) for at, n in spans])
    longer = wide.select("lang", "a", F.explode(F.array_compact(inner)).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    kept = lowest.join(longer, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * F.col("most") < subsumed * F.col("a")))
    ranked = kept.select("lang", "phrase", "a", "cut.l", "cut.r", F.col("all").alias("n"), "cut.score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 collocations of each language of all documents."""
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


ORACLE_SQL = rf"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER.decode()}', '{LOWER.decode()}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM t),
g AS (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM p, range(1, {MAX_WORDS + 1}) x(k) WHERE len(w) >= k),
f AS (SELECT lang, w[i:i + k - 1] AS words, count(*) AS n FROM g GROUP BY 1, 2 HAVING count(*) >= {LEAST}),
s AS (SELECT lang, sum(len(w)) AS n FROM p GROUP BY 1),
c AS (SELECT f.lang, words, f.n AS a, s.n FROM f JOIN s USING (lang) WHERE len(words) > 1),
k AS (SELECT *, unnest(range(1, len(words))) AS k FROM c),
x AS (SELECT k.lang, k.words, k, a, k.n, l.n AS l, r.n AS r, ((1000::HUGEINT * a * k.n) // (l.n::HUGEINT * r.n))::BIGINT AS score FROM k
  JOIN f l ON l.lang = k.lang AND l.words = k.words[:k] JOIN f r ON r.lang = k.lang AND r.words = k.words[k + 1:]
  QUALIFY row_number() OVER (PARTITION BY k.lang, k.words ORDER BY score, k) = 1),
i AS (SELECT DISTINCT lang, words[j:j + m - 1] AS words, a FROM c, range(1, {MAX_WORDS}) y(j), range(2, {MAX_WORDS}) z(m) WHERE m < len(words) AND j + m - 1 <= len(words)),
o AS (SELECT lang, words, max(a) AS most FROM i GROUP BY 1, 2),
e AS (SELECT x.lang, array_to_string(x.words, ' ') AS phrase, a, l, r, n::BIGINT AS n, score FROM x LEFT JOIN o USING (lang, words) WHERE most IS NULL OR 100 * most < 100 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM e QUALIFY rank <= {TOP}
"""
