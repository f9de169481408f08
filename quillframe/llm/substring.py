"""Substring dedup: Rabin-Karp hashes of every window of ``width`` words find candidates, digests of the words decide.

Words become 64-bit polynomial hashes, and windows rolling polynomial hashes of their words. Two rounds:

1. Each worker takes some thousand documents at a time and sends every hash it has once, as BYTES bytes of it in packed arrays by
   hash bucket. A bucket answers with the windows whose hash came more than once; windows that meet inside a worker's chunk are answered
   there. This is a filter: it may name windows that are not repeated, and names all that are.
2. Of the named windows only, a 96-bit BLAKE2 digest of the words themselves is sent, in the same way. Of the windows of one digest those
   in other documents than the smallest are repeated. So a collision of window hashes removes nothing.

In both rounds a passage in a third of all documents costs one entry for each chunk of documents. The repeated windows of a document
merge into maximal intervals to remove. The number of buckets follows the bytes of text, so a bucket's size doesn't.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import partitions, release_memory, small_batches, splitmix, table

WIDTH = 13
#: Words of a chunk that a worker holds at once (a longer document is a chunk of its own), bytes of text of a bucket, and the least number of buckets.
CHUNK_WORDS, BUCKET_BYTES, LEAST_BUCKETS = 1_000_000, 16_000_000, 64
#: Bytes of a window's hash that are sent beside its bucket: of n windows in a bucket (2 million at any size of the table), n / 2^32 are named
#: without need. Bytes of a digest: of 10^12 named windows no two different ones are expected to agree (10^24 / 2^97).
BYTES, DIGEST = 4, 12
#: Bytes hashed at once: about 30 bytes of memory for each.
BLOCK = 1 << 18
#: Fixed values of the hash: odd multipliers for bytes, words and word lengths.
BYTE_BASE, WORD_BASE, LENGTH_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0x94D049BB133111EB


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_BYTE_POWERS = _powers(BYTE_BASE, BLOCK + 1)
_BYTE_INVERSE = _powers(pow(BYTE_BASE, -1, 1 << 64), BLOCK + 1)
_WORD_POWERS = _powers(WORD_BASE, BLOCK + 1)
_WORD_INVERSE = _powers(pow(WORD_BASE, -1, 1 << 64), BLOCK + 1)


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last byte of every word of UTF-8 bytes; white space is 0x20 and 0x09 to 0x0D."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = (data != 0x20) & (data - np.uint8(0x09) > 4)
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def words_of(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts one after the other, first and past-the-last byte of every word (white space follows each), and the number of words of each text."""
    data = np.frombuffer(b"".join(x for raw in raws for x in (raw, b"\n")), np.uint8)
    starts, ends = word_bounds(data)
    texts = np.cumsum(np.fromiter(map(len, raws), np.int64, len(raws)) + 1)
    return data, starts, ends, np.diff(np.searchsorted(starts, texts), prepend=0)


def _before(count: np.ndarray) -> np.ndarray:
    """What comes before each group, of groups one after the other."""
    return np.cumsum(count) - count


def _windows(count: np.ndarray, width: int) -> np.ndarray:
    """How many windows texts of so many words have."""
    return np.maximum(0, count - (width - 1))


def joined_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words' bytes, each with a blank behind it, and where each begins."""
    change = np.zeros(len(data) + 2, np.int8)
    change[starts] = 1
    change[ends + 1] -= 1
    out = data[np.cumsum(change[: len(data)], dtype=np.int8).view(bool)]
    length = ends - starts + 1
    at = _before(length)
    out[at + length - 1] = 0x20
    return out, at


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A mixed 64-bit hash of each word, from prefix sums of byte x power (mod 2^64), block by block."""
    out, at = np.empty(len(starts), np.uint64), 0
    while at < len(starts):
        base = starts[at]
        to = max(at + 1, np.searchsorted(ends, base + BLOCK, side="right"))
        if ends[to - 1] - base > BLOCK:  # one word longer than a block
            digest = hashlib.blake2b(data[base : ends[at]].tobytes(), digest_size=8).digest()
            out[at] = int.from_bytes(digest, "little")
        else:
            part = data[base : ends[to - 1]]
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _BYTE_POWERS[: len(part)], out=sums[1:])
            s, e = starts[at:to] - base, ends[at:to] - base
            out[at:to] = splitmix((sums[e] - sums[s]) * _BYTE_INVERSE[s] + (e - s).astype(np.uint64) * np.uint64(LENGTH_BASE))
        at = to
    return out


def window_hashes(words: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The hash of every window of ``width`` words, at its first word: what rolls from window to window is a prefix sum, block by block."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, step = np.empty(n, np.uint64), BLOCK - width + 1
    for at in range(0, n, step):
        part = words[at : at + step + width - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * _WORD_POWERS[: len(part)], out=sums[1:])
        out[at : at + step] = (sums[width:] - sums[:-width]) * _WORD_INVERSE[: len(part) - width + 1]
    return splitmix(out)


def _raws(texts: pa.Array) -> list[bytes]:
    return [raw or b"" for raw in texts.cast(pa.large_binary()).to_pylist()]


def _joined(bodies: pa.Array) -> list[bytes | None]:
    """The bodies of each list as one."""
    kind = bodies.type.value_type
    return pc.binary_join(bodies.cast(pa.list_(kind)), pa.scalar(b"", kind)).to_pylist()  # the cast: Spark's lists say that they hold no nulls, which no kernel takes


def _chunks(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Rows of (.., bytes) in chunks of about CHUNK_WORDS words."""
    chunk, size = [], 0
    for row in rows:
        chunk.append(row)
        size += len(row[-1])
        if size > 6 * CHUNK_WORDS:
            yield chunk
            chunk, size = [], 0
    if chunk:
        yield chunk


def _runs(bodies: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first, past the last) of the runs of windows in the packed positions of each text; what lies behind a text's end is not there."""
    pairs = np.frombuffer(b"".join(bodies), "<u4").astype(np.int64).reshape(-1, 2)
    text = np.repeat(np.arange(len(bodies)), np.fromiter(map(len, bodies), np.int64, len(bodies)) // 8)
    first, past = pairs[:, 0], np.minimum(pairs.sum(1), sizes[text])
    there = first < past
    return text[there], first[there], past[there]


def _inside(first: np.ndarray, past: np.ndarray, size: int) -> np.ndarray:
    """Which of ``size`` places lie in one of the ranges."""
    return np.cumsum(np.bincount(first, minlength=size + 1) - np.bincount(past, minlength=size + 1))[:size] > 0


def marked(bodies: list[bytes], sizes: np.ndarray) -> np.ndarray:
    """Which windows the packed positions of each text name, over the windows of all texts."""
    text, first, past = _runs(bodies, sizes)
    base = _before(sizes)[text]
    return _inside(base + first, base + past, int(sizes.sum()))


def covered(bodies: list[bytes], count: np.ndarray, width: int) -> np.ndarray:
    """Which words the windows cover that the packed positions of each text name, over the words of all texts."""
    text, first, past = _runs(bodies, _windows(count, width))
    base = _before(count)[text]
    return _inside(base + first, base + past + (width - 1), int(count.sum()))


def _answers(taken: np.ndarray, doc: np.ndarray, which: np.ndarray, position: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(doc_id, which, packed positions) of the taken entries. Entries come by text and position; ``which`` tells the texts of one doc_id apart.

    Positions are packed as runs of neighbours, each its first place and its length, so packed positions of one text may be joined.
    """
    chosen = np.zeros(len(doc), bool)
    chosen[taken] = True
    at = np.flatnonzero(chosen)
    doc, which, position = doc[at], which[at], position[at].astype(np.int64)
    text = np.ones(len(at), bool)
    text[1:] = (doc[1:] != doc[:-1]) | (which[1:] != which[:-1])
    run = text.copy()
    run[1:] |= np.diff(position) != 1
    first, texts = np.flatnonzero(run), np.flatnonzero(text)
    pairs = np.stack([position[first], np.diff(first, append=len(at))], 1).astype("<u4")
    ends = 8 * np.append(np.searchsorted(first, texts), len(first)).astype(np.int32)
    return doc[texts], which[texts], pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(ends), pa.py_buffer(pairs)])


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A sorting order of the keys (the first counts most), where in it each distinct key begins, and how often each comes."""
    order = np.argsort(keys[0])
    s = keys[0][order]
    same = s[1:] == s[:-1]
    if any((k[order[1:]][same] != k[order[:-1]][same]).any() for k in keys[1:]):  # keys that agree in their first part only
        order = np.lexsort(keys[::-1])
        same = np.logical_and.reduce([k[order[1:]] == k[order[:-1]] for k in keys])
    begin = np.flatnonzero(np.concatenate([np.ones(min(1, len(order)), bool), ~same]))
    return order, begin, np.diff(np.concatenate([begin, [len(order)]]))


_SENT = "bucket int, answer boolean, doc_id long, which long, body binary"
_NAMES = ["bucket", "answer", "doc_id", "which", "body"]
_ANSWERS = "doc_id long, which long, body binary"


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"bucket": pa.int32(), "answer": pa.bool_(), "doc_id": pa.int64(), "which": pa.int64(), "body": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[n]) for i, n in enumerate(names)], names)


def _sent(buckets: int, answers: tuple, entries: tuple) -> Iterator[pa.RecordBatch]:
    """Rows of _SENT: answers go by their document, packed entries by their bucket."""
    doc, which, body = answers
    yield pa.RecordBatch.from_arrays([pa.array((doc % buckets).astype(np.int32)), pa.array(np.ones(len(doc), bool)), pa.array(doc), pa.array(which), body], _NAMES)
    yield _batch(list(_pack(*entries)), _NAMES)


def _pack(bucket: np.ndarray, key: np.ndarray, doc: np.ndarray, which: np.ndarray, position: np.ndarray) -> Iterator[tuple]:
    """Rows of _SENT with the entries of each bucket: ``key`` is a row of bytes for each; entries come by document."""
    order = np.argsort(bucket.astype(np.uint16) if len(bucket) and bucket.max() < 1 << 16 else bucket, kind="stable")
    bucket, key, doc, which, position = (np.take(x, order, axis=0) for x in (bucket, key, doc, which, position))
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
    new = np.ones(len(bucket), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (which[1:] != which[:-1])
    new[cuts[:-1]] = True
    at = np.flatnonzero(new)
    count = np.diff(at, append=len(bucket)).astype("<u4")
    step = np.diff(position.astype(np.int64), prepend=0)
    step[at] = position[at]
    step = step.astype("<i4").view(np.uint8).reshape(-1, 4)
    texts = np.searchsorted(at, cuts)
    gaps = np.diff(doc[at], prepend=0).astype("<i8")
    gaps[texts[:-1]] = doc[cuts[:-1]]
    which = which[at].astype("<i8")
    for lo, hi, a, b, n in zip(cuts[:-1].tolist(), cuts[1:].tolist(), texts[:-1].tolist(), texts[1:].tolist(), bucket[cuts[:-1]].tolist(), strict=True):
        small = zlib.compress(gaps[a:b].tobytes() + which[a:b].tobytes() + count[a:b].tobytes() + step[lo:hi].T.tobytes(), 1)
        yield n, False, hi - lo, 0, (b - a).to_bytes(4, "little") + len(small).to_bytes(4, "little") + small + key[lo:hi].tobytes()


def _open(n: int, body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The (key, doc_id, which, position) entries of one packed row of n entries."""
    texts, size = int.from_bytes(body[:4], "little"), int.from_bytes(body[4:8], "little")
    small = zlib.decompress(body[8 : 8 + size])
    doc, which = np.cumsum(np.frombuffer(small, "<i8", texts)), np.frombuffer(small, "<i8", texts, 8 * texts)
    count = np.frombuffer(small, "<u4", texts, 16 * texts)
    step = np.ascontiguousarray(np.frombuffer(small, np.uint8, 4 * n, 20 * texts).reshape(4, n).T).view("<i4")[:, 0].astype(np.int64)
    at = np.concatenate([[0], np.cumsum(count)[:-1]]).astype(np.int64)
    sums = np.cumsum(step)
    position = sums - np.repeat(sums[at] - step[at], count)
    return np.frombuffer(body, np.uint8, offset=8 + size).reshape(n, -1), np.repeat(doc, count), np.repeat(which, count), position


def _send_hashes(width: int, buckets: int):
    """First round, over (id, text): each distinct hash of a chunk once, and answers to all windows whose hash comes twice in the chunk."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for key, raw in zip(batch.column("id").to_pylist(), _raws(batch.column("text")), strict=True):
                if key is not None:
                    yield key, raw

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(texts(batches)):
            data, starts, ends, count = words_of([raw for _, raw in chunk])
            sizes = _windows(count, width)
            if not sizes.any():
                continue
            d = np.repeat(np.fromiter((key for key, _ in chunk), np.int64, len(chunk)), sizes)
            p = np.arange(len(d)) - np.repeat(_before(sizes), sizes)
            h = window_hashes(word_hashes(data, starts, ends), width)[p + np.repeat(_before(count), sizes)]
            w = np.zeros(len(d), np.int64)
            order, begin, n = _groups(h)
            answers = _answers(order[np.repeat(n > 1, n)], d, w, p)
            first = np.sort(order[begin])
            h, d, w, p = h[first], d[first], w[: len(first)], p[first]
            key = (h // np.uint64(buckets)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :BYTES]
            yield from _sent(buckets, answers, ((h % np.uint64(buckets)).astype(np.int64), key, d, w, p))
        release_memory()

    return run


def _send_digests(width: int, buckets: int):
    """Second round, over (id, which, text, bodies): the digests of the named windows of each chunk's smallest document, and answers to its others."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for row in zip(batch.column("id").to_pylist(), batch.column("which").to_pylist(), _joined(batch.column("bodies")), _raws(batch.column("text")), strict=True):
                if row[0] is not None and row[2]:
                    yield row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(texts(batches)):
            keys, whiches, bodies, raws = zip(*chunk, strict=True)
            data, starts, ends, count = words_of(raws)
            sizes = _windows(count, width)
            at = np.flatnonzero(marked(bodies, sizes))
            if not len(at):
                continue
            text = np.repeat(np.arange(len(chunk)), sizes)[at]
            d, w, p = np.array(keys, np.int64)[text], np.array(whiches, np.int64)[text], at - _before(sizes)[text]
            words, begin = joined_words(data, starts, ends)
            clean, first = words.tobytes(), p + _before(count)[text]
            past = np.append(begin, len(clean))[first + width] - 1
            digests = [hashlib.blake2b(clean[s:e], digest_size=DIGEST).digest() for s, e in zip(begin[first].tolist(), past.tolist(), strict=True)]
            key = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, DIGEST)
            order, other = _later(key, d)
            answers = _answers(order[other], d, w, p)
            least = np.sort(order[~other])
            yield from _sent(buckets, answers, ((_halves(key[least])[0] % np.uint64(buckets)).astype(np.int64), key[least], d[least], w[least], p[least]))
        release_memory()

    return run


def _halves(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first eight bytes of each digest and the rest, as integers."""
    return np.ascontiguousarray(key[:, :8]).view("<u8")[:, 0], np.ascontiguousarray(key[:, 8:]).view("<u4")[:, 0]


def _later(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A sorting order of entries by key, and which entries in it have a smaller document beside them."""
    order, begin, n = _groups(*_halves(key))
    s = doc[order]
    return order, s > np.repeat(np.minimum.reduceat(s, begin), n) if len(s) else np.empty(0, bool)


def _met(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """First round: the entries whose hash comes more than once."""
    wide = np.zeros((len(key), 8), np.uint8)
    wide[:, : key.shape[1]] = key
    order, _, n = _groups(wide.view("<u8")[:, 0])
    return order[np.repeat(n > 1, n)]


def _after_the_least(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Second round: the entries of a digest that a smaller document has, too."""
    order, other = _later(key, doc)
    return order[other]


def _answer(choose: Callable[[np.ndarray, np.ndarray], np.ndarray]):
    """For each bucket (rows come sorted by it): the windows that ``choose`` takes from its entries."""

    def solve(parts: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        key, doc, which, position = map(np.concatenate, zip(*(_open(*x) for x in parts), strict=True))
        taken = choose(key, doc)
        if len(taken):
            doc, which, body = _answers(taken, doc, which, position)
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(which), body], ["doc_id", "which", "body"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, at = [], None
        for batch in batches:
            kept = batch.column("answer").to_pylist()
            if any(kept):
                yield batch.filter(batch.column("answer")).select(["doc_id", "which", "body"])
            for bucket, answer, n, body in zip(batch.column("bucket").to_pylist(), kept, batch.column("doc_id").to_pylist(), batch.column("body"), strict=True):
                if answer:
                    continue
                if bucket != at and parts:
                    yield from solve(parts)
                    parts = []
                at = bucket
                parts.append((n, body.as_py()))
        if parts:
            yield from solve(parts)
        release_memory()

    return run


def kept_texts(raws: list[bytes], bodies: list[bytes], width: int = WIDTH) -> Iterator[tuple[int, int, memoryview]]:
    """Of each text: number of words, of removed words, and the kept words joined by one blank."""
    data, starts, ends, count = words_of(raws)
    kept = np.flatnonzero(~covered(bodies, count, width))
    words, begin = joined_words(data, starts[kept], ends[kept])
    last = np.searchsorted(kept, np.cumsum(count))
    left, bound = np.diff(last, prepend=0), np.append(begin, len(words))[last]
    view, at = memoryview(words), 0
    for n, k, to in zip(count.tolist(), left.tolist(), bound.tolist(), strict=True):
        yield n, n - k, view[at : max(at, to - 1)]
        at = to


def kept_words(raw: bytes, bodies: list[bytes], width: int = WIDTH) -> tuple[int, int, bytes]:
    """Number of words, of removed words, and the kept words joined by one blank."""
    words, gone, kept = next(kept_texts([raw], [b"".join(bodies)], width))
    return words, gone, bytes(kept)


def cut_text(raw: bytes, body: bytes, width: int = WIDTH) -> bytes:
    """The text without its removed words; each maximal interval goes with the white space after it."""
    if not body:
        return raw
    _, starts, _, count = words_of([raw])
    edges = np.diff(np.concatenate([[False], covered([body], count, width), [False]]).astype(np.int8))
    out, at = [], 0
    for lo, hi in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1), strict=True):
        out.append(raw[at : starts[lo]])
        at = starts[hi] if hi < len(starts) else len(raw)
    return b"".join([*out, raw[at:]])


def repeated_windows(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(id, which, text, rest, repeats): every row, its other columns as one struct, and packed positions of its repeated windows.

    ``repeats`` holds (which, body) of all texts that share the row's id, or is null; ``which`` tells whose they are.
    """
    spark = docs.sparkSession
    small_batches(spark)
    others = [F.col(f"`{c}`") for c in docs.columns if c != text]
    rows = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("which"), F.col(text).alias("text"), F.struct(*others).alias("rest"))
    size = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    tasks = partitions(spark)
    buckets = max(LEAST_BUCKETS, tasks, -(-size // BUCKET_BYTES))
    dealt = max(tasks, buckets // 4)

    def answered(sent: DataFrame, choose: Callable) -> DataFrame:
        return sent.repartition(dealt, "bucket").sortWithinPartitions("bucket").mapInArrow(_answer(choose), _ANSWERS)

    named = answered(rows.select("id", "text").mapInArrow(_send_hashes(width, buckets), _SENT), _met)
    named = named.groupBy(F.col("doc_id").alias("named_id")).agg(F.collect_list("body").alias("bodies"))
    # Both joins take the same exchange of the texts: a left join, and all columns.
    asked = rows.join(named, F.col("id") == F.col("named_id"), "left").mapInArrow(_send_digests(width, buckets), _SENT)
    found = answered(asked, _after_the_least).groupBy(F.col("doc_id").alias("found_id")).agg(F.collect_list(F.struct("which", "body")).alias("repeats"))
    return rows.join(found, F.col("id") == F.col("found_id"), "left").select("id", "which", "text", "rest", "repeats")


def _own(which: pa.Array, repeats: pa.Array) -> list[bytes]:
    """The packed positions of each row's own text."""
    rows = np.repeat(np.arange(len(repeats)), pc.fill_null(pc.list_value_length(repeats), 0).to_numpy(zero_copy_only=False))
    values = repeats.flatten()
    mine = values.field("which").to_numpy() == which.to_numpy()[rows]
    ends = np.concatenate([[0], np.cumsum(np.bincount(rows[mine], minlength=len(repeats)))]).astype(np.int32)
    return _joined(pa.ListArray.from_arrays(pa.array(ends), values.field("body").filter(pa.array(mine))))


def dedup_substrings(docs: DataFrame, width: int = WIDTH, key: str = "doc_id") -> DataFrame:
    """The same rows and columns with repeated passages cut out of ``text``, and ``n_chars`` (if there) set to what is left.

    Of documents that share a window of ``width`` words, the one of the smallest key keeps it; a window repeated only inside one document,
    or only in rows of one key, stays. Rows of one key are judged each by its own text. Null and short texts, and rows without a key,
    stay as they are. Other columns stay, whatever their names. An empty table gives an empty one.
    """
    fields = {f.name: f for f in docs.schema.fields}
    kinds = [T.StructField("text", fields["text"].dataType), T.StructField("n", T.LongType()), T.StructField("rest", T.StructType([f for f in docs.schema.fields if f.name != "text"]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = []
            for text, body in zip(batch.column("text").to_pylist(), _own(batch.column("which"), batch.column("repeats")), strict=True):
                new.append(cut_text(text.encode("utf-8", "surrogatepass"), body, width).decode("utf-8", "surrogatepass") if body else text)
            texts = pa.array(new, batch.column("text").type)
            yield pa.RecordBatch.from_arrays([texts, pa.array([None if t is None else len(t) for t in new], pa.int64()), batch.column("rest")], ["text", "n", "rest"])

    cut = repeated_windows(docs, key, "text", width).mapInArrow(run, T.StructType(kinds))
    given = {"text": F.col("text")}
    if "n_chars" in fields:
        given["n_chars"] = F.col("n").cast(fields["n_chars"].dataType)
    return cut.select(*[given.get(c, F.col("rest")[c]).alias(c) for c in docs.columns])


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: words, removed words, and a digest of what is kept. A null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(n, gone, hashlib.sha256(kept).hexdigest()) for n, gone, kept in kept_texts(_raws(batch.column("text")), _own(batch.column("which"), batch.column("repeats")))]
            yield pa.RecordBatch.from_arrays([batch.column("rest").field("doc_id"), *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.string())))], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return repeated_windows(docs).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


ORACLE_SQL = rf"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(words) - {WIDTH - 2})) AS pos, words FROM w WHERE len(words) >= {WIDTH}),
g AS (SELECT doc_id, pos, md5(array_to_string(words[pos:pos + {WIDTH - 1}], ' ')) AS h FROM p),
r AS (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY h) < doc_id AS hit FROM g),
c AS (SELECT DISTINCT doc_id, pos + k AS pos FROM r, range({WIDTH}) t(k) WHERE hit),
e AS (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS pos FROM w WHERE len(words) > 0),
k AS (SELECT e.doc_id, count(*) AS n_removed FROM e JOIN c USING (doc_id, pos) GROUP BY 1),
s AS (SELECT e.doc_id, string_agg(words[pos], ' ' ORDER BY pos) AS kept FROM e ANTI JOIN c USING (doc_id, pos) GROUP BY 1)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id) LEFT JOIN s USING (doc_id)
"""
