"""Packing: whole documents, tokenised and cut, into sequences of a fixed length with little padding."""

from __future__ import annotations

import re
import zlib
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut_lineage, documents

END = np.array([1], dtype="<u4").tobytes()
#: Simple words that a worker holds with their ids, twice as many as others. When half of them are filled, the half before is forgotten.
CACHE = 600_000
#: Bytes of text whose words are looked up together; a row stays whole.
TOGETHER = 4 << 20
#: Words of these are one unit of the vocabulary each; no composition or case changes them.
_SIMPLE = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+\Z")
#: What the vocabulary's alphabet of bytes has for those bytes of simple words that are no letters by themselves.
_ALPHABET = {chr(b): chr(256 + k) for b, k in ((0x9F, 65), (0xA0, 66), (0xAD, 67))}
_LETTER, _DIGIT, _MARK, _APOSTROPHE = 1, 2, 3, 4
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[33:127] = _MARK
_KIND[[c for c in range(128) if chr(c).isalpha()]] = _LETTER
_KIND[[c for c in range(128) if chr(c).isdigit()]] = _DIGIT
_KIND[ord("'")] = _APOSTROPHE
#: Kinds between which units always end. An apostrophe may begin a unit with the letters behind it, and joins the marks before it.
_ENDS = np.zeros((5, 5), dtype=bool)
_ENDS[[_LETTER, _LETTER, _LETTER, _DIGIT, _DIGIT, _DIGIT, _MARK, _MARK], [_DIGIT, _MARK, _APOSTROPHE, _LETTER, _MARK, _APOSTROPHE, _LETTER, _DIGIT]] = True
_ENDS = _ENDS.ravel()
_tokens: dict[str, Tokens] = {}


def apart(data: bytes) -> bytes:
    """The text in lower case, A-Z and the letters of Latin-1, with a space wherever one of these or an ASCII character ends a unit of the
    vocabulary. Others stay as they are: they may be composed or lower-cased to a mark, which joins the marks behind it."""
    values = np.frombuffer(data.lower(), dtype=np.uint8)
    kind = _KIND[values]
    lead = np.flatnonzero(values == 0xC3)
    if len(lead):
        after = values[lead + 1]
        letter = (after != 0x97) & (after != 0xB7)  # the signs of multiplication and division
        kind[lead[letter]] = kind[lead[letter] + 1] = _LETTER
        values = values.copy()
        values[lead[letter & (after < 0x9F)] + 1] += 0x20
    return np.insert(values, np.flatnonzero(_ENDS[kind[:-1] * 5 + kind[1:]]) + 1, 32).tobytes()


def _odd(word: bytes) -> bool:
    """Whether the word may hold a special token, which has case, or a mark (U+0300 to U+037F), which the vocabulary composes first: T with
    a diaeresis has no composed capital, t has."""
    return b"<" in word or b"\xcc" in word or b"\xcd" in word


def _simple(word: bytes) -> bool:
    return word.isalpha() and word.islower() or _SIMPLE.match(word) is not None


class Recent:
    """A bounded cache of two halves: what is asked for moves to the new one, so words that come again and again are never encoded anew."""

    def __init__(self, share: int = 1):
        self.share = share
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def lacking(self, words: list[bytes]) -> list[bytes]:
        """Those of ``words``, all different, that aren't known; the others stand in ``new`` from now on."""
        left = [w for w in words if w not in self.new]
        if len(self.new) + len(left) > CACHE // self.share // 2:
            self.new, self.old, left = {}, self.new, words
        old = self.old
        again = {w: old[w] for w in left if w in old}
        self.new |= again
        return [w for w in left if w not in again] if again else left


class Tokens:
    """Ids of texts. The vocabulary drops white space and never joins across it, so words are looked up one by one, cut where its
    units end (:func:`apart`). Simple words (``known``) and others (``parts``) are kept apart."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(vocabulary)
        # simple words are composed, lower-case and one unit each already, so white space alone parts them
        self.plain = Tokenizer.from_file(vocabulary)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max(names.values()) + 1, dtype=bool)  # ids that end a unit
        self.closes[[i for name, i in names.items() if name.endswith("</w>")]] = True
        self.known, self.parts = Recent(), Recent(2)

    @staticmethod
    def words(text: str | None) -> bytes:
        """The text with all its words cut by :func:`apart`, but for the odd ones."""
        data = (text or "").encode()
        if not _odd(data):
            return apart(data)
        return b" ".join(b" ".join(some) if odd else apart(b" ".join(some)) for odd, some in groupby(data.split(), _odd))

    def encode(self, words: list[bytes]) -> None:
        """Adds words to the new halves. Simple ones go through the tokenizer many at a time, told apart by the ids that close them."""
        simple = [w for w in words if _simple(w)]
        for at in range(0, len(simple), 200):
            some = simple[at : at + 200]
            line = b" ".join(some).decode("latin-1")
            for byte, letter in _ALPHABET.items():
                line = line.replace(byte, letter)
            ids = np.array(self.plain.encode_batch_fast([line], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = 4 * (np.flatnonzero(self.closes[ids]) + 1)
            raw, begin = ids.tobytes(), 0
            for w, end in zip(some, ends.tolist(), strict=True):
                self.known.new[w] = raw[begin:end]
                begin = end
        rest = list(set(words).difference(simple)) if len(simple) < len(words) else []
        encoded = self.tokenizer.encode_batch_fast([w.decode() for w in rest], add_special_tokens=False)
        self.parts.new.update((w, np.array(e.ids, dtype="<u4").tobytes()) for w, e in zip(rest, encoded, strict=True))

    def ids(self, words: list[bytes]) -> list[bytes]:
        """Ids of different words."""
        left = self.known.lacking(words)
        others = [w for w in left if not _simple(w)]
        rest = set(others)
        self.encode([w for w in left if w not in rest] + self.parts.lacking(others))
        known, parts = self.known.new, self.parts.new
        return [known[w] if w in known else parts[w] for w in words]

    def of(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text, with the closing id."""
        split = pc.ascii_split_whitespace(pa.array([self.words(t) for t in texts], pa.large_binary()).cast(pa.large_string()))
        words = split.flatten().dictionary_encode()
        ids = pa.array(self.ids(words.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(words.indices)
        if not len(ids):
            return [END for _ in texts]
        _, ends, data = ids.buffers()
        data = data or pa.py_buffer(b"")
        ends = np.frombuffer(ends, dtype=np.int64)[ids.offset :]
        at = ends[np.asarray(split.offsets) - split.offsets[0].as_py()].tolist()
        return [data[a:b].to_pybytes() + END for a, b in zip(at, at[1:], strict=False)]


def tokens_of(vocabulary: str) -> Tokens:
    """One instance a worker, so that tasks share its caches."""
    if vocabulary not in _tokens:
        _tokens[vocabulary] = Tokens(vocabulary)
    return _tokens[vocabulary]


def together(batch: pa.RecordBatch):
    """Slices of ``batch`` (ids and texts) with about :data:`TOGETHER` bytes of text; a row stays whole."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0)), dtype=np.int64)
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOGETHER, side="right")))
        yield batch.slice(at, to - at)
        at = to


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """``start, length`` of the pieces of ``n`` ids: full ones, then the rest."""
    return [(at, min(size, n - at)) for at in range(0, n, size)]


def pieces(docs: DataFrame, vocabulary: str, size: int = 2048, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens`` (and ``ids``) per piece."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]

    def per_batch(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokens = tokens_of(vocabulary)
        for b in (part for whole in batches for part in together(whole)):
            rows = []
            for doc, ids in zip(b.column(0).to_pylist(), tokens.of(b.column(1).to_pylist()), strict=True):
                for start, n in cut(len(ids) // 4, size):
                    part = ids[4 * start : 4 * (start + n)]
                    rows.append((doc, start, n, zlib.crc32(part), len(ids) // 4, *[np.frombuffer(part, "<u4").tolist()] * with_ids))
            columns = [pa.array(c, pa.list_(pa.int64()) if i == 5 else pa.int64()) for i, c in enumerate(zip(*rows, strict=True))]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<long>" * with_ids
    return documents(docs).mapInArrow(per_batch, schema)


def pack_histogram(counts: np.ndarray) -> list[tuple[int, tuple[int, ...]]]:
    """Patterns ``(count, lengths)`` that hold ``counts[n]`` pieces of each length ``n``; the last index is the size.

    Lengths are placed longest first. Each goes to the pack with the most room, if it fits there, else opens new packs.
    Packs with the same room are handled together, so the work follows the number of different lengths and not of pieces.
    """
    size = len(counts) - 1
    by_room: list[list[tuple[int, tuple[int, ...]]]] = [[] for _ in range(size + 1)]
    widest = 0
    for length in range(size, 0, -1):
        left = int(counts[length])
        room = widest
        widest = 0
        while left:
            while room >= length and not by_room[room]:
                room -= 1
            if room < length:
                # no pack has room: new ones, each with as many of this length as fit
                for each in (size // length, left % (size // length)):
                    n = left // each if each else 0
                    if n:
                        by_room[size - each * length].append((n, (length,) * each))
                        widest = max(widest, size - each * length)
                        left -= n * each
                break
            n, pattern = by_room[room].pop()
            used = min(n, left)
            by_room[room - length].append((used, (*pattern, length)))
            if n > used:
                by_room[room].append((n - used, pattern))
            left -= used
        widest = max(widest, room)
        while widest > 0 and not by_room[widest]:
            widest -= 1
    return [p for packs in by_room for p in packs]


def plan(counts: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: from which rank a slot takes its pieces, the slot's first sequence, and its offset there."""
    slots: dict[int, list[tuple[int, int, int]]] = {}
    ranks = np.zeros(len(counts), dtype=np.int64)
    sequence = 0
    for n, pattern in pack_histogram(counts):
        offset = 0
        for length in pattern:
            slots.setdefault(length, []).append((int(ranks[length]), sequence, offset))
            ranks[length] += n
            offset += length
        sequence += n
    return {length: tuple(np.array(x, dtype=np.int64) for x in zip(*rows, strict=True)) for length, rows in slots.items()}


def pack(docs: DataFrame, vocabulary: str, size: int = 2048, per_bucket: int = 100_000, with_ids: bool = False) -> DataFrame:
    """Per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` (and ``ids``).

    Documents are tokenised once, closed by id 1 and cut at multiples of ``size``; the pieces go to the checkpoint folder.
    The driver sees only the number of pieces of each length (``size`` numbers, whatever the input) and packs that
    histogram. A piece finds its slot by its rank among pieces of its length: the rank in its hash bucket plus the pieces
    of earlier buckets. There are so many buckets that one holds about ``per_bucket`` pieces of the most frequent length,
    so a length with a third of all pieces is ranked in many tasks.

    Null and empty texts have only the closing id. Repeated rows are packed each. An empty table gives an empty result.
    """
    found = cut_lineage(pieces(docs, vocabulary, size, with_ids))
    counts = np.zeros(size + 1, dtype=np.int64)
    for length, n in found.groupBy("length").count().collect():
        counts[length] = n
    slots = plan(counts)
    buckets = int(counts.max()) // per_bucket + 1
    found = found.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)).cast("int"))
    ranked = found.withColumn("nth", F.row_number().over(W.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")).cast("long"))
    if buckets > 1:
        before = F.sum("count").over(W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
        sizes = found.groupBy("length", "bucket").count().select("length", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
        ranked = ranked.join(sizes, ["length", "bucket"]).withColumn("nth", F.col("nth") + F.col("before")).select(*found.columns, "nth")

    def per_batch(batches):
        for b in batches:
            length, rank = (np.asarray(b.column(b.schema.get_field_index(c))) for c in ("length", "nth"))
            rank = rank - 1
            sequence, offset = np.zeros(len(rank), dtype=np.int64), np.zeros(len(rank), dtype=np.int64)
            for one in np.unique(length).tolist():
                here = np.flatnonzero(length == one)
                first, base, inside = slots[one]
                k = np.searchsorted(first, rank[here], side="right") - 1
                sequence[here] = base[k] + rank[here] - first[k]
                offset[here] = inside[k]
            keep = [i for i, c in enumerate(b.schema.names) if c not in ("bucket", "nth")]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in keep] + [pa.array(sequence), pa.array(offset)], [b.schema.names[i] for i in keep] + ["sequence_id", "offset"])

    out = found.drop("bucket").schema.add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(per_batch, out)
