"""Fill-in-the-middle, conversation repair and source mixing against brute force, with nulls, repeats, ties and clashing names."""

import hashlib
import itertools
import random
import re
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from linkmill.llm import conversations, fill_in_middle, mixing
from linkmill.llm.conversations import Survivors

CLASH = ("row", "row2", "pos", "data", "n", "form", "a.b", "key", "size", "rate", "target", "lost_", "fault", "s")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- fill in the middle ----------------------------------------------------------------------------------------------


def texts():
    rng = random.Random(8)
    rows = [(1, None), (2, ""), (3, "\n"), (4, "one line"), (5, "a\nb\n"), (6, "holds <P> itself\nand more"), (7, "\n\n\n"), (None, "no\nid"), (None, None)]
    rows += [(i, "".join(rng.choice(["wörd ", "x", "日本", "\n", "\n\n", "<", "P>"]) for _ in range(rng.randint(1, 60)))) for i in range(10, 60)]
    rows += [(60, "ä" * 20000 + "\n" + "line\n" * 5000 + "z" * 8192), (61, "same\ntext\nhere"), (61, "same\ntext\nhere"), (61, "same\ntext\nhere"), (61, "another\ntext")]
    return rows


def rearranged(i, text, rate=100, spm=50, seed=7):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    draw = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(draw[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    p, m, s = ("".join(units[x:y]) for x, y in ((0, a), (a, b), (b, None)))
    form = "spm" if h[3] % 100 < spm else "psm"
    return len(units), form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(texts(), "doc_id long, text string").withColumns({c: F.lit("x") for c in CLASH}).repartition(4)


def by_all(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize(("rate", "spm"), [(100, 50), (60, 0), (0, 50)])
def test_rearranged_texts(docs, rate, spm):
    want = [(i, *rearranged(i, t, rate, spm)) for i, t in texts()]
    assert by_all(fill_in_middle.fill_in_middle(docs, rate, spm).collect()) == by_all(want)
    got = fill_in_middle.digests(fill_in_middle.pieces(docs, rate, spm))
    assert by_all(got.collect()) == by_all((i, *rearranged(i, t, rate, spm)[:4], sha(rearranged(i, t, rate, spm)[4]), sha(t or "")) for i, t in texts())
    assert rate < 100 or {"plain", "psm", "spm"} == {r.form for r in got.collect()}


def test_pieces_are_bounded_and_sorted(docs):
    rows = fill_in_middle.pieces(docs.filter("doc_id = 60")).collect()
    assert max(len(r.data) for r in rows) <= fill_in_middle.CHUNK and [r.pos for r in rows] == sorted(r.pos for r in rows)
    assert b"".join(r.data for r in rows).decode() == rearranged(*texts()[59])[4]


def test_nothing_to_rearrange(docs):
    assert fill_in_middle.fill_in_middle(docs.limit(0)).count() == 0
    assert fill_in_middle.digests(fill_in_middle.pieces(docs.limit(0))).count() == 0


# --- conversations ---------------------------------------------------------------------------------------------------

LEGAL = re.compile(r"(s?(ua)+)?\Z")


def cheapest(rows):
    """(cost, edits, roles) of the cheapest repair by going through all edits; rows are (role, must go, unfinished)."""
    best = None
    puts = [x for n in range(3) for x in itertools.product("ua", repeat=n)]

    def go(k, roles, cost, edits):
        nonlocal best
        for put in puts:
            seq, c, e = roles + "".join(put), cost + 5 * len(put), edits + "I" * len(put)
            if best is not None and c > best[0]:
                continue
            if k == len(rows):
                if LEGAL.match(seq) and (best is None or (c, e) < best[:2]):
                    best = (c, e, seq)
                continue
            role, must, unfinished = rows[k]
            go(k + 1, seq, c + 2, e + "D")
            if not must:
                go(k + 1, seq + role, c + 5 * unfinished, e + "K")
                for r in "ua":
                    go(k + 1, seq + r, c + 1 + 5 * unfinished, e + "R")

    go(0, "", 0, "")
    return best


def test_cheapest_edits():
    rng = random.Random(2)
    for n in [0, 1, 2, 3, 4] * 40 + [5] * 8:
        rows = [(rng.choice("suuaax"), rng.random() < 0.15, rng.random() < 0.15) for _ in range(n)]
        out = []
        ways = Survivors(lambda edit, role, text, out=out: out.append((edit, role)))
        for role, must, unfinished in rows:
            ways.row(role, "t", must, unfinished)
        assert (ways.end(), "".join(e for e, _ in out), "".join(r[0] for _, r in out if r)) == cheapest(rows), rows


def test_settled_edits_leave_memory():
    held, out = 0, []
    ways = Survivors(lambda *x: out.append(x))
    for k in range(20000):
        ways.row("ua"[k % 2] if k % 7 else "x", "t", k % 11 == 0, k % 13 == 0)
        held = max(held, ways.held)
    ways.end()
    assert held < 100 and sum(e != "I" for e, *_ in out) == 20000


def talk():
    rng = random.Random(4)
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hello."), (1, 2, "assistant", "Hi!"), (2, 5, "user", None), (2, None, None, "x."), (2, 5, "user", "Late?"), (None, 1, "user", "No id."), (None, None, "assistant", "no turn")]
    rows += [(3, 1, "user", "Same."), (3, 1, "user", "Same."), (3, 2, "assistant", "Yes."), (4, None, "user", "Only."), (5, 3, "assistant", " \t\n"), (6, 0, "user", "x" * 100000 + ".")]
    for c in range(10, 60):
        rows += [(c, t, rng.choice(["system", "user", "assistant", "tool", ""]), rng.choice(["Yes.", "No!", "cut off", "", "Why?", f"text {t}."])) for t in rng.sample(range(12), rng.randint(1, 9))]
    return rows


def mended(rows):
    """Per conversation what :func:`conversations.conversation_audits` should say, from the given rows."""
    whole = {}
    for c, turn, role, text in rows:
        whole.setdefault(c, []).append((turn, " " if role is None else role, " " if text is None else text))
    for c, lines in whole.items():
        lines.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        seen, faults = set(), []
        for _, role, text in lines:
            words = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else None)
            seen.add((role, text))
        turns = [t for t, *_ in lines if t is not None]
        out = []
        ways = Survivors(lambda edit, role, text, out=out: out.append((edit, role, text)))
        for (_, role, text), f in zip(lines, faults, strict=True):
            ways.row(role, text, f in ("blank", "duplicate"), f == "truncated")
        cost, count = ways.end(), Counter(faults)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(lines))
        kept = [f"{r}:{t}" for _, r, t in out if r is not None]
        yield (c, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, count["blank"], count["duplicate"], count["truncated"], illegal, cost, "".join(e for e, *_ in out), sha("\n".join(kept))), kept


def test_conversations(spark):
    df = spark.createDataFrame(talk(), "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in CLASH}).repartition(5)
    want = list(mended(talk()))
    assert by_all(conversations.conversation_audits(df).collect()) == by_all(w for w, _ in want)
    rows = conversations.repaired_rows(df).collect()
    for w, kept in want:
        assert [f"{r.role}:{r.text}" for r in sorted((r for r in rows if r.conv_id == w[0]), key=lambda r: r.place)] == kept
    assert conversations.conversation_audits(df.limit(0)).count() == 0 and conversations.repaired_rows(df.limit(0)).count() == 0


def test_conversations_that_lose_all_rows(spark):
    df = spark.createDataFrame([("a", 1, "user", "Hi."), ("b", 1, "user", "Hi.")], "conv_id string, turn int, role string, text string").withColumn("lost", F.col("conv_id") == "a")
    got = {r.conv_id: r for r in conversations.conversation_audits(df).collect()}
    assert tuple(got["a"]) == ("a", 0, 0, 0, 0, 0, 0, "", sha("")) and got["b"].audit == "D" and got["b"].cost == 2


def test_damage(spark):
    from zlib import crc32

    rows = [(c, t, "assistant" if t % 2 else None, "What? Yes. No!" if t % 3 else None) for c in range(40) for t in range(8)] + [(None, None, "user", "x.")]
    got = conversations.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    want = []
    for c, t, role, text in rows:
        f = crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if f == 1 else re.sub("[.!?]", "", text) if f == 2 else text
        want += [(c, t, "user" if f == 4 else role, text, f == 0)] * (2 if f == 3 else 1)
    assert by_all(got) == by_all(want)


# --- mixing ----------------------------------------------------------------------------------------------------------


def shares(sizes, weights=(5, 2, 1), most=3):
    """Targets by sharing the excess anew until none is above, in fractions."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        left = total - sum(most * sizes[s] for s in full)
        price = Fraction(left, sum(weight[s] for s in names if s not in full)) if len(full) < len(names) else 0
        new = {s for s in names if s not in full and most * sizes[s] <= weight[s] * price}
        if not new:
            return {s: most * sizes[s] if s in full else float(weight[s] * price) for s in names}
        full |= new


def collection(n=400):
    rng = random.Random(6)
    rows = [(k, " ".join(["w"] * rng.choice([0, 1, 5, 20, 60, 300])), rng.choice(["a", "a", "a", "b", "Ü", None, "c", "z"])) for k in range(n)]
    return rows + [(n, None, "a"), (n + 1, "tiny one", "tiny"), (None, "no id here", "b"), (7000, "same text again", "c"), (7000, "same text again", "c"), (7001, "", "empty"), (7002, " \t ", "empty")]


def test_mix(spark):
    df = spark.createDataFrame(collection(), "doc_id long, text string, source string").withColumns({c: F.lit("x") for c in CLASH if c != "source"}).repartition(6)
    result = mixing.mix(df)
    rows = result.collect()
    assert len(rows) == len(collection()) and Counter(r.doc_id for r in rows) == Counter(i for i, *_ in collection())
    size = Counter()
    for _, text, source in collection():
        size[source] += len((text or "").split())
    want = shares(size)
    assert want["tiny"] == 6 and want["empty"] == 0
    taken = Counter()
    for r in rows:
        assert r.source_size == size[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(5, 0.01 * t)
    again = mixing.mix(df.repartition(3)).collect()
    assert by_all((r.doc_id, r.source, r.size, r.copies) for r in rows) == by_all((r.doc_id, r.source, r.size, r.copies) for r in again)
    assert set(mixing.digest(result).columns) == {"doc_id", "size", "source_size", "target", "taken"}


def test_rates_solve_the_dual(spark):
    """Rates of one source are exp of one multiplier times the size, at most 3, and give the target."""
    rows = mixing.mix(spark.createDataFrame(collection(), "doc_id long, text string, source string")).filter("source = 'a'").collect()
    assert sum(r.rate * r.size for r in rows) == pytest.approx(rows[0].target, rel=1e-5)
    from math import log

    tilts = {round(log(r.rate) / r.size, 7) for r in rows if r.size and r.rate < 3}
    assert len(tilts) == 1 and all(r.rate == 1 for r in rows if not r.size)


def test_nothing_to_mix(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(empty).count() == 0
    blank = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.copies * r.size) for r in mixing.mix(blank).collect()] == [(0, 0.0, 0)] * 2


def test_one_source_of_one_document(spark):
    got = mixing.mix(spark.createDataFrame([(1, "a b c", "x")], "doc_id long, text string, source string")).first()
    assert (got.target, got.copies) == (3.0, 1)
