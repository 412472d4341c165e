"""Conversation structure repair: the cheapest edits that make a conversation alternate, found by a streaming Viterbi."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import WHITE

#: Costs of the edits; a truncated row that stays costs ``UNFINISHED`` more.
KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 1, 2, 5, 5
ENDS = ".!?"
#: States of the grammar (s?(ua)+)?: nothing yet, after s, after u, after a; what each state may be followed by, and where the end may be.
STATES = "-sua"
NEXT = {("-", "s"): "s", ("-", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
#: The role that a new or renamed row takes after each state.
TURN = {"-": "user", "s": "user", "u": "assistant", "a": "user"}
#: What it costs at most to go on from the first state as from the second: edits put in, and an s that must go after all.
AS_FROM = {
    ("-", "s"): 0, ("-", "u"): 5, ("-", "a"): 0, ("s", "-"): 12, ("s", "u"): 5, ("s", "a"): 10,
    ("u", "-"): 7, ("u", "s"): 5, ("u", "a"): 5, ("a", "-"): 2, ("a", "s"): 0, ("a", "u"): 5,
}


def damage(conversations: DataFrame) -> DataFrame:
    """``conversations`` with faults by crc32 of ``conv_id:turn`` modulo 20, for testing a repair.

    0 drops a row (it stays, with ``lost`` true, so that its conversation is known), 1 empties its text, 2 takes its full stops and
    the like, 3 repeats it, 4 makes its role user. A null role, text, or id or turn in the hashed key, is one space.
    """
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), or_space("role").alias("role"), or_space("text").alias("text"),
                                (F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn")).cast("binary")) % 20).alias("_f"))
    f = F.col("_f")
    text = F.when(f == 1, "").when(f == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(f == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (f == 0).alias("lost"), "_f")
    twice = F.explode(F.when(f == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.withColumn("_again", twice).drop("_f", "_again")


class _Node:
    """An edit in the tree of backpointers: its parent, its children, and how many states end here."""

    __slots__ = ("parent", "kids", "states", "edit", "role", "text", "depth")

    def __init__(self, parent, edit: str = "", role: str | None = None, text: str | None = None):
        self.parent, self.kids, self.states, self.edit, self.role, self.text = parent, set(), 0, edit, role, text
        self.depth = parent.depth + 1 if parent else 0

    def release(self) -> None:
        """Takes dead ends out of the tree, from here upwards."""
        node = self
        while node.parent is not None and not node.states and not node.kids:
            node.parent.kids.discard(node)
            node.parent, node = None, node.parent


def _smaller(a: tuple, b: tuple) -> bool:
    """Is path a's string of edits less than b's? Both are (node, edit to come), walked back to where they part."""
    (x, e), (y, f) = a, b
    left, right = [e], [f]
    while x is not y:
        if x.depth >= y.depth:
            left.append(x.edit)
            x = x.parent
        else:
            right.append(y.edit)
            y = y.parent
    return "".join(reversed(left)) < "".join(reversed(right))


class Survivors:
    """The cheapest ways to reach each state, row by row; edits leave as soon as all ways share them.

    ``emit(edit, role, text)`` gets each settled edit. Of ways of the same cost that with the least string of edits counts, by
    whole strings: two of them reach a state with the same rows behind them, so neither string begins with the other.
    Held are the rows since the last edit that all survivors share, and no more. A state that can't win any more is no survivor
    (:data:`AS_FROM`); else the way that deletes all rows would share nothing with the others, ever.
    """

    def __init__(self, emit):
        self.emit, self.root = emit, _Node(None)
        self.root.states = 1
        self.best: dict[str, tuple[int, _Node]] = {"-": (0, self.root)}
        self.held = 0

    def _move(self, ways: list, stay: bool) -> None:
        """Replaces the survivors by the best of ``ways`` (state, cost, node, edit, role, text); with ``stay`` the old ones compete unchanged."""
        found: dict[str, tuple] = {s: (c, node, "", None, None) for s, (c, node) in self.best.items()} if stay else {}
        for state, cost, *way in ways:
            old = found.get(state)
            if old is None or cost < old[0] or cost == old[0] and _smaller((way[0], way[1]), (old[1], old[2])):
                found[state] = (cost, *way)
        new = {}
        for state, (cost, node, edit, role, text) in found.items():
            if edit:
                parent, node = node, _Node(node, edit, role, text)
                parent.kids.add(node)
            node.states += 1
            new[state] = (cost, node)
        for _, node in self.best.values():
            node.states -= 1
        for _, node in self.best.values():
            node.release()
        self.best = new

    def _insert(self) -> None:
        for _ in range(2):  # two in a row lead from nothing to a whole exchange; more only go round
            self._move([(NEXT[s, TURN[s][0]], c + INSERT, node, "I", TURN[s], "") for s, (c, node) in self.best.items()], True)

    def row(self, role: str, text: str, must_go: bool, unfinished: bool) -> None:
        self._insert()
        ways = []
        for s, (c, node) in self.best.items():
            ways.append((s, c + DELETE, node, "D", None, None))
            if must_go:
                continue
            more = UNFINISHED if unfinished else 0
            if (s, role[:1]) in NEXT:
                ways.append((NEXT[s, role[:1]], c + KEEP + more, node, "K", role, text))
            ways.append((NEXT[s, TURN[s][0]], c + REROLE + more, node, "R", TURN[s], text))
        self._move(ways, False)
        self._drop_hopeless()
        self._settle()

    def _drop_hopeless(self) -> None:
        """Takes out states that cost more than to reach another one and go on from there as from them; they would hold the tree open."""
        for s, (c, node) in list(self.best.items()):
            if any(c > other + AS_FROM[x, s] for x, (other, _) in self.best.items() if x != s):
                del self.best[s]
                node.states -= 1
                node.release()

    def _settle(self) -> None:
        while not self.root.states and len(self.root.kids) == 1:
            (self.root,) = self.root.kids
            self.root.parent = None
            self.emit(self.root.edit, self.root.role, self.root.text)
        self.held = max(node.depth for _, node in self.best.values()) - self.root.depth

    def end(self) -> int:
        """Settles the rest and returns the cost."""
        self._insert()
        ends = [self.best[s] for s in "-a" if s in self.best]
        cost, node = ends[0]
        for c, other in ends[1:]:
            if c < cost or c == cost and _smaller((other, ""), (node, "")):
                cost, node = c, other
        path = []
        while node is not self.root:
            path.append(node)
            node = node.parent
        for x in reversed(path):
            self.emit(x.edit, x.role, x.text)
        return cost


class _Conversation:
    """What is told of a conversation as its rows go by in order."""

    def __init__(self, conv_id, write):
        self.conv_id, self.audit, self.digest, self.n_out, self.write = conv_id, [], hashlib.sha256(), 0, write
        self.faults = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.illegal, self.last, self.first_turn, self.turn, self.n_turns = 0, None, None, None, 0
        self.survivors = Survivors(self._emit)

    def _emit(self, edit: str, role: str | None, text: str | None) -> None:
        self.audit.append(edit)
        if role is not None:
            self.digest.update((("\n" if self.n_out else "") + f"{role}:{text}").encode())
            if self.write is not None:
                self.write((self.conv_id, self.n_out, edit, role, text))
            self.n_out += 1

    def row(self, turn: int | None, role: str, text: str, fault: str | None) -> None:
        if turn is not None and turn != self.turn:
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.turn, self.n_turns = turn, self.n_turns + 1
        if fault:
            self.faults[fault] += 1
        if self.last is not None and self.last + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.last = role[:1]
        self.survivors.row(role, text, fault in ("blank", "duplicate"), fault == "truncated")

    def end(self) -> tuple:
        cost = self.survivors.end()
        gaps = self.turn - self.first_turn + 1 - self.n_turns if self.n_turns else 0
        return (self.conv_id, gaps, *self.faults.values(), self.illegal, cost, "".join(self.audit), self.digest.hexdigest())


def _judged(rows: DataFrame) -> DataFrame:
    """Rows dealt out by conversation, in order inside it, each with its first ``fault``."""
    lost = F.coalesce("lost", F.lit(False)) if "lost" in rows.columns else F.lit(False)
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), lost.alias("lost"))
    order = [F.col("turn").asc_nulls_first(), "role", "text"]
    words = F.btrim("text", F.lit(WHITE))
    # the window asks for no exchange beyond that by conversation
    again = F.row_number().over(W.partitionBy("conv_id", "lost", "role", "text").orderBy(order[0])) > 1
    fault = F.when(words == "", "blank").when(again, "duplicate").when(~F.right(words, F.lit(1)).isin(*ENDS), "truncated")
    return rows.repartition("conv_id").withColumn("fault", fault).sortWithinPartitions("conv_id", *order)


_FOUND = [("gaps", T.LongType(), pa.int64()), *((c, T.LongType(), pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "cost")), ("audit", T.StringType(), pa.string()), ("repaired_sha256", T.StringType(), pa.string())]
_ROWS = [("place", T.LongType(), pa.int64()), *((c, T.StringType(), pa.string()) for c in ("edit", "role", "text"))]


def _stream(rows: DataFrame, columns: list, repaired: bool) -> DataFrame:
    field = rows.schema["conv_id"]
    schema = T.StructType([T.StructField("conv_id", field.dataType), *(T.StructField(c, t) for c, t, _ in columns)])
    names = schema.names

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        write = out.append if repaired else None
        conversation, kind = None, None

        def flush(least: int) -> Iterator[pa.RecordBatch]:
            if len(out) >= least:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), [kind, *(k for *_, k in columns)], strict=True)], names)
                out.clear()

        for batch in batches:
            kind = batch.column(0).type
            for conv_id, turn, role, text, lost, fault in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if conversation is None or conversation.conv_id != conv_id:
                    if conversation is not None:
                        found = conversation.end()
                        if not repaired:
                            out.append(found)
                        yield from flush(5000)
                    conversation = _Conversation(conv_id, write)
                if not lost:
                    conversation.row(turn, role, text, fault)
            yield from flush(5000)
        if conversation is not None:
            found = conversation.end()
            if not repaired:
                out.append(found)
            yield from flush(1)

    return _judged(rows).mapInArrow(per_batch, schema)


def conversation_audits(rows: DataFrame) -> DataFrame:
    """Per conversation of ``rows`` (``conv_id, turn, role, text`` and perhaps ``lost``): its faults, and the cheapest edits that mend it.

    ``gaps`` are turns missing between the first and the last; ``blank``, ``duplicate`` and ``truncated`` count rows by their first
    fault; ``illegal`` counts neighbours that may not follow each other. Edits keep (K), rename the role of (R) or delete (D)
    each row, or insert (I) one, so that the roles' initials read ``(s?(ua)+)?``; ``cost`` is their sum and ``audit`` their initials,
    of equally cheap ones the least. ``repaired_sha256`` is the digest of the repaired ``role:text`` lines.

    Rows are dealt out once, by conversation, and stream by in order of turn (nulls first; ties by role and text), so a
    conversation isn't held: :class:`Survivors` keeps the rows whose edits are still open. One conversation is one
    sequence, which one task reads, however long it is. Null roles and texts are one space; a null id is a
    conversation; repeated rows are duplicates; rows with ``lost`` true only name their conversation. An empty table gives
    an empty result; extra columns take no part.
    """
    return _stream(rows, _FOUND, False)


def repaired_rows(rows: DataFrame) -> DataFrame:
    """``conv_id, place, edit, role, text``: the rows of the repaired conversations (:func:`conversation_audits`), in order of ``place``."""
    return _stream(rows, _ROWS, True)


_WHITE_SQL = "' '||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"


def _sql() -> str:
    """The damage, the faults and the cheapest edits in DuckDB SQL: a recursive walk over each conversation's rows that keeps, for each
    state, the least (cost, edits, repaired text); what may come before a row, at most two new ones, is written out."""
    way = lambda x, cost, edit, out: f"{{'c': {x}.c + {cost}, 'e': concat({x}.e, '{edit}'), 'o': concat({x}.o, {out})}}"
    line = lambda role, text: f"chr(10), {role}, ':', {text}"
    least = lambda *ways: f"list_min(list_filter([{', '.join(ways)}], lambda x: x IS NOT NULL))"
    some = lambda x, w, when="true": f"CASE WHEN {x} IS NOT NULL AND {when} THEN {w} END"
    new = {s: line(f"'{TURN[s]}'", "''") for s in STATES}
    name = dict(zip(STATES, ("n", "s", "u", "a"), strict=True))

    def inserted(source: str, prefix: str) -> str:
        """Each state's best with up to two rows put in, in two steps."""
        one = {"n": "n", "s": "s"}
        one["u"] = least("u", some("n", way("n", INSERT, "I", new["-"])), some("s", way("s", INSERT, "I", new["s"])), some("a", way("a", INSERT, "I", new["a"])))
        one["a"] = least("a", some("u", way("u", INSERT, "I", new["u"])))
        columns = lambda d: ", ".join(f"{e} AS {c}" for c, e in d.items())
        first = f"(SELECT * EXCLUDE (n, s, u, a), {columns(one)} FROM {source})"
        return f"(SELECT * EXCLUDE (n, s, u, a), {columns(one)} FROM {first} {prefix})"

    keep = lambda s, i: some(name[s], way(name[s], f"{KEEP} + unfinished", "K", line("role", "text")), f"NOT must_go AND i = '{i}'")
    call = lambda s: some(name[s], way(name[s], f"{REROLE} + unfinished", "R", line(f"'{TURN[s]}'", "text")), "NOT must_go")
    gone = lambda s: some(name[s], way(name[s], DELETE, "D", "''"))
    step = {
        "n": gone("-"), "s": least(gone("s"), keep("-", "s")),
        "u": least(gone("u"), keep("-", "u"), keep("s", "u"), keep("a", "u"), call("-"), call("s"), call("a")),
        "a": least(gone("a"), keep("u", "a"), call("u")),
    }
    kind = "STRUCT(c BIGINT, e VARCHAR, o VARCHAR)"
    return f"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(range(9), lambda c, k: CASE WHEN k = 0 THEN c WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' ')) AS k FROM conversations),
hashed AS (SELECT raw.*, xor(list_reduce(list_transform(range(1, length(k) + 1), lambda i: ascii(substring(k, i, 1))::BIGINT), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295), 4294967295) % 20 AS f FROM raw, crc),
hurt AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN translate(text, '{ENDS}', '') ELSE text END AS text
  FROM hashed, range(2) r(again) WHERE f <> 0 AND (again = 0 OR f = 3)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, trim(text, {_WHITE_SQL}) AS words, left(role, 1) AS i FROM hurt),
judged AS (SELECT *, CASE WHEN words = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 'duplicate' WHEN right(words, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
  coalesce(concat(lag(i) OVER (PARTITION BY conv_id ORDER BY pos), i) NOT IN ('su', 'ua', 'au') AND pos > 1, false) AS bad FROM placed),
line AS (SELECT *, coalesce(fault IN ('blank', 'duplicate'), false) AS must_go, CASE WHEN fault = 'truncated' THEN {UNFINISHED} ELSE 0 END AS unfinished FROM judged),
told AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, {', '.join(f"count(*) FILTER (fault = '{x}') AS {x}" for x in ('blank', 'duplicate', 'truncated'))}, count(*) FILTER (bad) AS illegal, count(*) AS n_rows FROM line GROUP BY conv_id),
walk AS (SELECT conv_id, 0::BIGINT AS at, {{'c': 0, 'e': '', 'o': ''}}::{kind} AS n, NULL::{kind} AS s, NULL::{kind} AS u, NULL::{kind} AS a FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL SELECT conv_id, pos, {', '.join(f"({e})::{kind} AS {c}" for c, e in step.items())} FROM (SELECT w.*, l.pos, l.role, l.text, l.i, l.must_go, l.unfinished FROM {inserted("walk", "")} w JOIN line l ON l.conv_id IS NOT DISTINCT FROM w.conv_id AND l.pos = w.at + 1)),
final AS (SELECT w.conv_id, {least("w.n", "w.a")} AS best FROM {inserted("walk", "")} w LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM w.conv_id WHERE w.at = coalesce(t.n_rows, 0))
SELECT f.conv_id, {', '.join(f"coalesce({x}, 0)::BIGINT AS {x}" for x in ('gaps', 'blank', 'duplicate', 'truncated', 'illegal'))}, best.c AS cost, best.e AS audit, sha256(substring(best.o, 2)) AS repaired_sha256
FROM final f LEFT JOIN told t ON t.conv_id IS NOT DISTINCT FROM f.conv_id
"""


SQL = _sql()
