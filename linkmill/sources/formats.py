"""What data files hold, and their records one after another from a bounded buffer. No Spark here: these run inside tasks."""

from __future__ import annotations

import ast
import codecs
import json
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

#: Bytes by which a file is judged, characters that are read at once, and characters after which an unfinished value is tried.
HEAD = 4096
CHUNK = 1 << 20
LONG = 1 << 26
ITEM = re.compile(r"^(?:https?://(?:www\.)?wikidata\.org/(?:wiki|entity)/)?(Q\d+)$")
TAG = re.compile(r"^(?:O|[BIES]-.+)$")
_TAGGED = re.compile(rb"(?:^|\s)[BIES]-[A-Za-z]")


class Format(NamedTuple):
    """A format, how the first bytes show it (whole, and without a byte order mark and white space), and why it is no data, if so."""

    name: str
    fits: Callable[[bytes, bytes], bool]
    refused: str | None = None


#: The first that fits counts.
FORMATS = (
    Format("gzip", lambda raw, text: raw.startswith(b"\x1f\x8b")),
    Format("zip", lambda raw, text: raw.startswith(b"PK\x03\x04"), "holds packed files: unpack it and read those (ZIP archive)"),
    Format("empty", lambda raw, text: not text, "has nothing but white space (empty)"),
    Format("json", lambda raw, text: text[:1] in (b"[", b"{")),
    Format("html", lambda raw, text: text.startswith(b"<"), "holds markup, as a page for logging in saved in place of the data does (HTML web page)"),
    Format("conll", lambda raw, text: b"\t" in text or _TAGGED.search(text) is not None),
    Format("unknown", lambda raw, text: True, "begins like none of the known forms of data (unknown format)"),
)


def format_of(head: bytes) -> Format:
    raw = head[:HEAD]
    text = raw.lstrip(b"\xef\xbb\xbf \t\r\n")
    return next(f for f in FORMATS if f.fits(raw, text))


def unpacked(parts: Iterable[bytes]) -> Iterator[bytes]:
    """The content of gzip members one after another, as far as it goes."""
    member = zlib.decompressobj(31)
    for part in parts:
        while part:
            try:
                yield member.decompress(part, CHUNK)
            except zlib.error:
                return
            part = member.unconsumed_tail
            if member.eof:
                part, member = member.unused_data.lstrip(b"\0"), zlib.decompressobj(31)


def decoded(parts: Iterable[bytes]) -> Iterator[str]:
    decoder = codecs.getincrementaldecoder("utf-8-sig")()
    for part in parts:
        if text := decoder.decode(part):
            yield text
    if text := decoder.decode(b"", True):
        yield text


# --- JSON ------------------------------------------------------------------------------------------------------------

_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*(")?|[{}\[\]]', re.DOTALL)
_BETWEEN = re.compile(r"(?:[\s,]|null|true|false|-?\d[\d.eE+-]*)*")


class Broken(ValueError):
    """Text that is no JSON: what is wrong, and the place in the file."""

    def __init__(self, what: str, at: int, line: int, column: int, around: str):
        super().__init__(what)
        self.what, self.at, self.line, self.column, self.around = what, at, line, column, around


class Values:
    """Cuts text that comes in parts into the objects and lists at its top, or in the lists at its top.

    Only strings and brackets are told apart. ``held`` is the text from the value that isn't complete yet; what lies before is
    forgotten but for its length and lines. Scalars between values are passed over.
    """

    def __init__(self):
        self.held, self.at, self.free = "", 0, 0  # free: where the text after the last value begins
        self.begin: int | None = None
        self.depth, self.listed = 0, False
        self.gone, self.lines, self.last_line, self.tried = 0, 0, 0, LONG

    def broken(self, what: str, at: int) -> Broken:
        before = self.held[:at]
        line = self.lines + before.count("\n") + 1
        start = before.rfind("\n") + 1
        return Broken(what, self.gone + at, line, at - start + 1 if start else self.gone + at - self.last_line + 1, self.held[max(0, at - 80) : at + 80])

    def _between(self, to: int) -> None:
        fit = _BETWEEN.match(self.held, self.free, to).end()
        if fit < to:
            raise self.broken("no value may stand here", fit)

    def parsed(self, start: int, end: int | None = None) -> object:
        try:
            return json.loads(self.held[start:end])
        except json.JSONDecodeError as e:
            raise self.broken(e.msg, start + e.pos) from None

    def feed(self, more: str) -> Iterator[tuple[object, bool]]:
        """The values that are complete now, and whether each stood in a list."""
        self.held += more
        for token in _TOKEN.finditer(self.held, self.at):
            mark, start = token[0][0], token.start()
            if mark == '"' and token[1] is None:
                self.at = start  # goes on in the next part
                break
            self.at = token.end()
            if self.begin is not None:
                self.depth += {"{": 1, "[": 1, "}": -1, "]": -1}.get(mark, 0)
                if not self.depth:
                    yield self.parsed(self.begin, self.at), self.listed
                    self.begin, self.free = None, self.at
                continue
            self._between(start)
            if mark == "[" and not self.listed:
                self.listed = True
            elif mark in "[{":
                self.begin, self.depth = start, 1
            elif mark == "]" and self.listed:
                self.listed = False
            elif mark != '"':
                raise self.broken(f"{mark} closes nothing", start)
            self.free = self.at
        else:
            self.at = len(self.held)
        if self.begin is not None and len(self.held) - self.begin > self.tried:
            self._try()
        self._forget(self.begin if self.begin is not None else min(self.free, self.at))

    def _try(self) -> None:
        """Raises if a very long value went wrong long ago; else looks again when it is twice as long."""
        try:
            json.loads(self.held[self.begin :])
        except json.JSONDecodeError as e:
            if e.pos < (len(self.held) - self.begin) // 2 and not e.msg.startswith("Unterminated"):
                raise self.broken(e.msg, self.begin + e.pos) from None
        self.tried *= 2

    def _forget(self, keep: int) -> None:
        if keep < CHUNK // 2:
            return
        lost = self.held[:keep]
        if "\n" in lost:
            self.last_line = self.gone + lost.rfind("\n") + 1
        self.lines += lost.count("\n")
        self.gone += keep
        self.held, self.at, self.free = self.held[keep:], self.at - keep, max(0, self.free - keep)
        self.begin = self.begin - keep if self.begin is not None else None

    def end(self) -> None:
        """Raises if the text ends inside a value, with the place from which on it can't be read."""
        if self.begin is None and self.at == len(self.held):
            return self._between(len(self.held))
        self.parsed(self.begin if self.begin is not None else self.at)


def _record_lists(value: dict) -> list[list]:
    return [x for x in value.values() if isinstance(x, list) and x and all(isinstance(y, dict) for y in x)]


#: What an object that stands alone in its file holds: the first rule that fits says which records.
LONE = (
    ("a long text makes it a record", lambda v: any(isinstance(x, str) and len(x) > 20 for x in v.values()), lambda v: [v]),
    ("lists of objects: the longest", _record_lists, lambda v: max(_record_lists(v), key=len)),
    ("nothing but objects: records by name", lambda v: all(isinstance(x, dict) for x in v.values()), lambda v: v.values()),
    ("anything else is a record", lambda v: True, lambda v: [v]),
)


def _of_lone(value: object) -> Iterable[dict]:
    if isinstance(value, dict):
        return next(records(value) for _, fits, records in LONE if fits(value))
    return [x for x in value if isinstance(x, dict)] if isinstance(value, list) else []


def json_records(parts: Callable[[], Iterable[str]], name: str) -> Iterator[dict]:
    """The records of JSON text (``parts`` opens it anew): values one after another, with commas or not, alone or in lists.

    Lists give their objects; an object alone in its file may wrap its records (:data:`LONE`), of several each is one. If the text
    breaks off in its last fiftieth, the records before count; anything else that can't be read raises, with the place. A text
    of which not even a first value can be read is tried as one Python literal.
    """
    values, n, first = Values(), 0, None
    try:
        for part in parts():
            for value, listed in values.feed(part):
                if first is not None:
                    yield first
                    first, n = None, n + 1
                if listed or not isinstance(value, dict):
                    for record in [value] if isinstance(value, dict) else _of_lone(value):
                        yield record
                        n += 1
                elif n:
                    yield value
                    n += 1
                else:
                    first = value  # alone, unless something follows
        broken = None
        try:
            values.end()
        except Broken as e:
            broken = e
        if first is not None:
            found = _of_lone(first) if broken is None else [first]
            yield from found
            n += 1
        if broken is not None and not (n and broken.at > 0.98 * (values.gone + len(values.held))):
            raise broken
    except Broken as e:
        if not n and first is None:
            try:
                value = ast.literal_eval("".join(parts()).strip())
            except (ValueError, SyntaxError, MemoryError, RecursionError):
                pass
            else:
                yield from _of_lone(value)
                return
        raise ValueError(f"{name}: can't be read as JSON from line {e.line}, column {e.column} on ({e.what}); {n} records were read before; there it says {e.around!r}") from None


# --- token files -----------------------------------------------------------------------------------------------------


def sentence(lines: list[str]) -> dict | None:
    """A sentence of token lines as ``tokens``, ``tags`` and ``qids``; None if there are only comments.

    Rows are padded to the longest. The tags are the first column behind the tokens in which every cell is one, the items the first
    other one in which any cell is one; without tags all tokens are outside, and cells that are no item are null.
    """
    rows = [line.split("\t") if "\t" in line else line.split() for line in lines if not line.startswith("#")]
    if not rows:
        return None
    width = max(map(len, rows))
    columns = list(zip(*(r + [""] * (width - len(r)) for r in rows), strict=True))
    others = range(1, len(columns))
    tags = next((c for c in others if all(map(TAG.match, columns[c]))), None)
    qids = next((c for c in others if c != tags and any(ITEM.match(x.strip()) for x in columns[c])), None)
    items = [None] * len(rows) if qids is None else [x if ITEM.match(x.strip()) else None for x in columns[qids]]
    return {"tokens": list(columns[0]), "tags": ["O"] * len(rows) if tags is None else list(columns[tags]), "qids": items}


_BREAK = re.compile(r"\r\n|\r|\n")


def sentences(parts: Iterable[str]) -> Iterator[dict]:
    """The sentences of token lines, which blank lines part."""
    rest, lines = "", []

    def ended(new: list[str]) -> Iterator[dict]:
        for line in new:
            if line.strip():
                lines.append(line)
            elif lines:
                if (found := sentence(lines)) is not None:
                    yield found
                lines.clear()

    for part in parts:
        text = rest + part
        if text.endswith("\r"):  # the line's end may go on in the next part
            rest = text
            continue
        *whole, rest = _BREAK.split(text)
        yield from ended(whole)
    yield from ended([*_BREAK.split(rest), ""])


def records(parts: Callable[[], Iterable[bytes]], name: str) -> Iterator[dict]:
    """The records of a file (``parts`` opens it anew), packed or not, by what it holds; raises for what is no data, naming the file."""

    def head(opened: Iterable[bytes]) -> bytes:
        found = b""
        for part in opened:
            found += part
            if len(found) >= HEAD:
                break
        return found

    kind, opened = format_of(head(parts())), parts
    if kind.name == "gzip":
        opened = lambda: unpacked(parts())
        kind = format_of(head(opened()))
        if kind.name == "gzip":
            raise ValueError(f"{name} is packed twice")
    if kind.refused:
        raise ValueError(f"{name} {kind.refused}")
    if kind.name == "json":
        yield from json_records(lambda: decoded(opened()), name)
    else:
        yield from sentences(decoded(opened()))
