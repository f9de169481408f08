"""BPE encoding and decoding with a public vocabulary file.

A piece of text is merged with a priority queue of (merge rank, position) over a doubly linked list of symbols; queue
entries whose symbols have changed since are stale and skipped. Decoding concatenates the vocabulary's strings.
Pieces repeat, so each worker keeps the ids of those it has met in a bounded table; that changes no result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import small_batches, table

#: Entries of a worker's table of pieces; a full one becomes the old table, whose pieces return when met. Longer pieces are not kept.
TABLE_ENTRIES, TABLE_PIECE = 350_000, 64
#: Rows in an Arrow batch that a worker gets, so that very long texts don't meet in one.
BATCH_ROWS = 256
#: Fixed value: the pattern that byte-level vocabularies split text by.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(256 + rest.index(b)) for b in range(256)]


def latin_pattern(pattern: str) -> str:
    r"""The same pattern for texts without characters above U+00FF, in the syntax of ``re``: \p{L}, \p{N}, \s and \S spelled out."""
    members = {name: "".join(re.escape(chr(c)) for c in range(256) if regex.match(name, chr(c))) for name in (r"\p{L}", r"\p{N}", r"\s")}
    out, inside = [], False
    for part in re.split(r"(\\p\{[LN]\}|\\[sS]|[\[\]])", pattern):
        if part in "[]":
            inside = part == "[" if part else inside
            out.append(part)
        elif part == r"\S":
            out.append(f"[^{members[chr(92) + 's']}]")
        elif part in members:
            out.append(members[part] if inside else f"[{members[part]}]")
        else:
            out.append(part)
    return "".join(out)


def merge(symbols: list[int], pairs: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Apply the merges (pair -> rank, id) to a list of ids, lowest rank first and leftmost first among equals."""
    n = len(symbols)
    if n < 2:
        return symbols
    ids, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    queue = []
    for i in range(n - 1):
        found = pairs.get((ids[i], ids[i + 1]))
        if found:
            queue.append((found[0], i, ids[i], ids[i + 1], found[1]))
    heapq.heapify(queue)
    while queue:
        _, i, left, right, new = heapq.heappop(queue)
        j = after[i]
        if ids[i] != left or j >= n or ids[j] != right:
            continue  # stale: one of the two has been merged since
        ids[i], ids[j] = new, -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            found = pairs.get((new, ids[k]))
            if found:
                heapq.heappush(queue, (found[0], i, new, ids[k], found[1]))
        h = before[i]
        if h >= 0:
            found = pairs.get((ids[h], new))
            if found:
                heapq.heappush(queue, (found[0], h, ids[h], new, found[1]))
    return [x for x in ids if x >= 0]


class Bpe:
    """A tokenizer read from a ``tokenizers`` JSON file of one of two kinds: byte-level, or words with an end mark."""

    def __init__(self, path: str, library: bool = False) -> None:
        """``library``: pieces that aren't in the table go to the ``tokenizers`` library together (only for words with an end mark)."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs[self.vocab[a], self.vocab[b]] = rank, self.vocab[a + b]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        steps = (spec.get("normalizer") or {}).get("normalizers", [])
        self.lower = any(x["type"] == "Lowercase" for x in steps)
        self.composed = any(x["type"] == "NFC" for x in steps)
        kinds = spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]])
        pattern = next((x["pattern"]["Regex"] for x in kinds if x["type"] == "Split"), BYTE_LEVEL_PATTERN)
        self._pieces = regex.compile(pattern).findall
        self._latin_pieces = re.compile(latin_pattern(pattern)).findall
        self._symbols = byte_symbols()
        back = {c: b for b, c in enumerate(self._symbols)}
        size = 1 + max([*self.vocab.values(), *self.special.values()])
        self._bytes = [b""] * size
        for s, i in self.vocab.items():
            word = bool(self.suffix) and s.endswith(self.suffix)
            self._bytes[i] = bytes(back[c] for c in s.removesuffix(self.suffix if word else "")) + (b" " if word else b"")
        for s, i in self.special.items():
            self._bytes[i] = s.encode()
        self._table: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        self._library = None
        if library and self.suffix:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(path)
            self._ends = {i for s, i in self.vocab.items() if s.endswith(self.suffix)}

    def normalize(self, text: str) -> str:
        if self.composed and not text.isascii():
            text = unicodedata.normalize("NFC", text)
        if self.lower:
            text = text.replace("Σ", "σ").lower()  # letter by letter: no final sigma
        return text

    def pieces(self, text: str) -> list[str]:
        """The pieces of a normalized text that are merged on their own."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self._pieces(text)
        return self._latin_pieces(text)

    def _keep(self, piece: str, ids: bytes) -> bytes:
        if len(piece) <= TABLE_PIECE:
            if len(self._table) >= TABLE_ENTRIES:
                self._old, self._table = self._table, {}
            self._table[piece] = ids
        return ids

    def _piece(self, piece: str) -> bytes:
        """The ids of one piece as little-endian 32-bit integers."""
        ids = self._table.get(piece) or self._old.get(piece)
        if ids is None:
            symbols = [self._symbols[b] for b in piece.encode("utf-8", "surrogatepass")]
            symbols[-1] += self.suffix
            merged = merge([self.vocab[s] for s in symbols], self.pairs)
            ids = pack(f"<{len(merged)}I", *merged)
        return self._keep(piece, ids)

    def _from_library(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of new pieces: blanks part them, and each ends at its first id with the end mark."""
        new = list(dict.fromkeys(p for p in pieces if p not in self._old))
        found, ids = {p: self._old[p] for p in pieces if p in self._old}, []
        at = iter(new)
        for i in self._library.encode(" ".join(new), add_special_tokens=False).ids if new else ():
            ids.append(i)
            if i in self._ends:
                found[next(at)] = pack(f"<{len(ids)}I", *ids)
                ids = []
        for piece, value in found.items():
            self._keep(piece, value)
        return found

    def encode(self, text: str) -> bytes:
        """All ids of a text as little-endian 32-bit integers."""
        if self._cut and any(s in text for s in self.special):
            parts = self._cut.split(text)
        else:
            parts = [text]
        out = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(self.special[part].to_bytes(4, "little"))
            elif part:
                pieces = self.pieces(self.normalize(part))
                ids = list(map(self._table.get, pieces))
                if None in ids:
                    if self._library:
                        found = self._from_library([p for x, p in zip(ids, pieces, strict=True) if x is None])
                        ids = [x or found[p] for x, p in zip(ids, pieces, strict=True)]
                    else:
                        ids = [x or self._piece(p) for x, p in zip(ids, pieces, strict=True)]
                out += ids
        return b"".join(out)

    def decode(self, ids: Iterable[int]) -> str:
        """The vocabulary's strings of the ids, one after the other; broken UTF-8 becomes U+FFFD. Words of the second kind end in a blank."""
        text = b"".join(map(self._bytes.__getitem__, ids))
        return text.decode("utf-8", "replace").removesuffix(" " if self.suffix else "")


@lru_cache(maxsize=4)
def load(path: str, library: bool = False) -> Bpe:
    """One tokenizer for each worker process and file."""
    return Bpe(path, library)


def digest_rows(batch: pa.RecordBatch, path: str) -> pa.RecordBatch:
    tokenizer = load(path)
    counts, ids_hex, text_hex = [], [], []
    for text in batch.column("text"):
        ids = tokenizer.encode(text.as_py() or "")
        counts.append(len(ids) // 4)
        ids_hex.append(hashlib.sha256(ids).hexdigest())
        text_hex.append(hashlib.sha256(tokenizer.decode(np.frombuffer(ids, "<u4").tolist()).encode("utf-8", "surrogatepass")).hexdigest())
    keep = [n for n in batch.schema.names if n != "text"]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(counts, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())], [*keep, "n_tokens", "ids_sha256", "decoded_sha256"])


def encode_documents(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Add ``ids`` (array of int) to every row. A null text counts as empty; an input column ``ids`` is replaced."""
    small_batches(docs.sparkSession)
    columns = [f for f in docs.schema.fields if f.name != "ids"]
    docs = docs.select(*[f.name for f in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(at, BATCH_ROWS)
                tokenizer = load(path)
                ids = [np.frombuffer(tokenizer.encode(t.as_py() or ""), "<u4").astype("i4") for t in batch.column(text)]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype("i4")
                values = np.concatenate([np.empty(0, "i4"), *ids])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], [*batch.schema.names, "ids"])

    return docs.mapInArrow(run, T.StructType([*columns, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def op7_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Token count and digests of ids and decoded text of every document. A null text is the empty one."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                yield digest_rows(whole.slice(at, BATCH_ROWS), path)

    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
