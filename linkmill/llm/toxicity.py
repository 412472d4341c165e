"""Toxicity: a support vector machine over a subsequence string kernel, with Nystroem landmarks.

The kernel of two strings counts the runs of three letters, in order but with gaps, that both have; a run that spans ``s`` letters
weighs ``DECAY ** s``, however long the span, and each string's kernel vector has length one. Strings are the letters of words:
marks between letters, and letters that are drawn out or all doubled, are folded away before and leave no gap at all; letters
that are put in leave one. An insult with inserted characters so stays close to the insult.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from itertools import combinations, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, give_back, in_fold
from .learning import fit_dense, sample, sigmoid

DECAY = 0.5
#: Kinds of letters: a to z, digits, others by their code, and a string's begin and end; a feature is a run of three kinds.
KINDS, BEGIN, END = 64, 62, 63
FEATURE_SPACE = KINDS**3
#: Letters up to which all runs of a string are written out; those of a longer one are summed letter by letter.
SHORT = 20
#: Strings of a length that are taken together, and strings whose kernel vectors stand in memory at once (up to 1,540 runs each).
TOGETHER, AT_ONCE = 256, 512
#: A word near the border (margins between these, letters up to so many) is also read without each one of its letters, at a cost.
NEAR, SURE, READ, COST = -0.8, 1.2, 24, 0.3
#: Margins over which a text's units are counted.
STEPS = (0.3, 0.6, 1.0)
#: Entries of a worker's cache from unit to margin, after which it starts anew.
CACHE = 400_000
FEATURES = 6


@lru_cache(maxsize=1 << 16)
def fold(word: str) -> str:
    """The letters and digits of a word in lower case; a letter three or more times in a row, or a word of letters all doubled, counts them once."""
    out = word.lower()
    if not out.isalnum():
        out = _MARKS.sub("", out)
    if not _TWICE.search(out):
        return out
    runs = [(c, sum(1 for _ in same)) for c, same in groupby(out)]
    drawn = len(runs) > 1 and all(n > 1 for _, n in runs)
    return "".join(c if drawn or n > 2 else c * n for c, n in runs)


_MARKS, _TWICE = re.compile(r"[\W_]+"), re.compile(r"(.)\1")


def units(text: str | None) -> list[str]:
    """The folded words; three or more single letters in a row are also read as one word, up to the end of a sentence."""
    out, run = [], []

    def spelled() -> None:
        if len(run) > 2:
            out.append(fold("".join(run)))
        run.clear()

    for raw in (text or "").split():
        word = fold(raw) if len(raw) < 1000 else fold.__wrapped__(raw)
        if len(word) == 1:
            run.append(word)
        elif word:
            spelled()
            out.append(word)
        if raw[-1] in ".!?":
            spelled()
    spelled()
    return out


_KIND = np.array([{c: k for k, c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789")}.get(chr(c), 36 + c % 26) for c in range(128)], dtype=np.int32)


def kinds(strings: list[str]) -> np.ndarray:
    """The kinds of letters of strings of one length, a row each, with begin and end."""
    code = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(strings), -1)
    out = np.empty((code.shape[0], code.shape[1] + 2), dtype=np.int32)
    out[:, 0], out[:, -1] = BEGIN, END
    out[:, 1:-1] = np.where(code < 128, _KIND[np.minimum(code, 127)], 36 + code % 26)
    return out


@lru_cache(maxsize=SHORT + 3)
def _runs(n: int) -> tuple[np.ndarray, np.ndarray]:
    """All places of three in ``n``, and their weights."""
    at = np.array(list(combinations(range(n), 3)), dtype=np.int32)
    return at, DECAY ** (at[:, 2] - at[:, 0] + 1)


def _long(string: str) -> np.ndarray:
    """The kernel vector of a long string: sums over its letters of what came before, each step weaker by one."""
    one, two, three = np.zeros(KINDS), np.zeros((KINDS, KINDS)), np.zeros((KINDS, KINDS, KINDS))
    for c in kinds([string])[0].tolist():
        three[c] += DECAY * two
        two *= DECAY
        two[:, c] += DECAY * one
        one[c] += 1
        one *= DECAY
    return three.transpose(1, 2, 0).ravel()


def subsequences(strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, features and values of the unit kernel vectors of strings, flat, by row; begin and end of a string are letters."""
    found = []
    lengths = np.fromiter(map(len, strings), dtype=np.int64, count=len(strings))
    for n in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == n)
        if n > SHORT:
            for r in rows.tolist():
                vector = _long(strings[r])
                feature = np.flatnonzero(vector)
                found.append((np.full(len(feature), r), feature, vector[feature]))
        elif n:
            at, weight = _runs(n + 2)
            for begin in range(0, len(rows), TOGETHER):
                part = rows[begin : begin + TOGETHER]
                codes = kinds([strings[r] for r in part.tolist()])
                feature = (codes[:, at[:, 0]] * KINDS + codes[:, at[:, 1]]) * KINDS + codes[:, at[:, 2]]
                key = np.sort(feature << 11 | np.arange(len(at), dtype=np.int32), axis=1)  # at most 1,540 runs
                feature, order = key >> 11, key & 2047
                new = np.ones(feature.shape, dtype=bool)
                new[:, 1:] = feature[:, 1:] != feature[:, :-1]
                first = np.flatnonzero(new)
                found.append((np.repeat(part, new.sum(1)), feature.ravel()[first].astype(np.int64), np.add.reduceat(weight[order].ravel(), first)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    row, feature, value = (np.concatenate(x) for x in zip(*found, strict=True))
    norm = np.sqrt(np.bincount(row, value**2, minlength=len(strings)))
    return row, feature, value / np.maximum(norm[row], 1e-12)


def kernel(strings: list[str], landmarks: np.ndarray, columns: np.ndarray | None = None) -> np.ndarray:
    """Kernel values with landmarks given as a dense matrix (landmark by feature, or by those of ``columns``, sorted)."""
    row, feature, value = subsequences(strings)
    if columns is not None:
        at = np.minimum(np.searchsorted(columns, feature), len(columns) - 1)
        known = columns[at] == feature
        row, feature, value = row[known], at[known], value[known]
    out = np.zeros((len(strings), len(landmarks)))
    for k, landmark in enumerate(landmarks):
        out[:, k] = np.bincount(row, value * landmark[feature], minlength=len(strings))
    return out


def dense(strings: list[str]) -> np.ndarray:
    row, feature, value = subsequences(strings)
    out = np.zeros((len(strings), FEATURE_SPACE), dtype=np.float32)
    out[row, feature] = value
    return out


def fit_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1e-5, rounds: int = 600) -> tuple[np.ndarray, float]:
    """Squared-hinge linear machine by Nesterov steps; ``y`` is +1 or -1."""
    x = np.hstack([x, np.ones((len(x), 1))])
    step = 1 / (2 * np.linalg.norm((x * weight[:, None]).T @ x, 2) / weight.sum() + l2)
    w = ahead = np.zeros(x.shape[1])
    for t in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ ahead)) * weight
        new = ahead - step * (-2 * (x.T @ (slack * y)) / weight.sum() + l2 * np.append(ahead[:-1], 0))
        ahead, w = new + t / (t + 3) * (new - w), new
    return w[:-1], float(w[-1])


class Model:
    """Margins of units, folded to one weight per feature, and the logistic scale from a document's margins to its score."""

    def __init__(self, weights: np.ndarray, bias: float, top: np.ndarray):
        self.weights, self.bias, self.top = weights, bias, top
        self.known: dict[str, float] = {}

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def margins(self, strings: list[str]) -> np.ndarray:
        """Each string's margin; near the border the best of its own and, less :data:`COST`, of those without one letter."""
        out = self.plain_margins(strings)
        near = [k for k in np.flatnonzero((out > NEAR) & (out < SURE)).tolist() if 4 <= len(strings[k]) <= READ]
        shorter = [(k, strings[k][:j] + strings[k][j + 1 :]) for k in near for j in range(1, len(strings[k]) - 1)]
        if shorter:
            np.maximum.at(out, np.array([k for k, _ in shorter]), self.plain_margins([s for _, s in shorter]) - COST)
        return out

    def plain_margins(self, strings: list[str]) -> np.ndarray:
        out = np.full(len(strings), self.bias)
        order = np.argsort(np.fromiter(map(len, strings), dtype=np.int64, count=len(strings)), kind="stable")  # few lengths in each part
        for at in range(0, len(strings), AT_ONCE):
            part = order[at : at + AT_ONCE]
            row, feature, value = subsequences([strings[k] for k in part.tolist()])
            out[part] += np.bincount(row, value * self.weights[feature], minlength=len(part))
        return out

    def describe(self, texts: list[str | None]) -> np.ndarray:
        """Per text: the largest margin, how many different units are over each of :data:`STEPS` (as logs), and of all units the share over the first two."""
        split = [set(units(t)) for t in texts]
        known = self.known
        new = list(set().union(*split) - known.keys())
        if len(known) + len(new) > CACHE:
            known.clear()
            new = list(set().union(*split))
        known.update(zip(new, self.margins(new).tolist(), strict=True))
        out = np.zeros((len(texts), FEATURES))
        for i, us in enumerate(split):
            m = np.fromiter((known[u] for u in us), dtype=float, count=len(us))
            over = [(m > step).sum() for step in STEPS]
            out[i] = (m.max(), *np.log1p(over), *np.log1p([100 * over[1] / len(m), 100 * over[0] / len(m)])) if len(m) else (-3, 0, 0, 0, 0, 0)
        out[:, 0] = np.clip(out[:, 0], -3, 3)
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return sigmoid(self.describe(texts) @ self.top[:-1] + self.top[-1])


def seeds(toxic: list[set[str]], clean: list[set[str]], most: int, ratio: float = 5.0, share: float = 0.06) -> list[str]:
    """Strings that mark toxic texts: words and word beginnings (ended by ``*``) that far more toxic than clean texts have.

    At least four toxic texts, and ``share`` of them, must have a string, so that none is learned from a few copies of one text.
    """
    least = max(4, int(share * len(toxic)))

    def forms(words: set[str], n: int) -> set[str]:
        return {w[: n + 4] + "*" for w in words if len(w) > n + 4} if n else words

    bad: Counter[str] = Counter()
    for n in range(5):  # one kind of form at a time, as most are found once
        some = Counter(f for words in toxic for f in forms(words, n))
        bad.update({f: k for f, k in some.items() if k >= least})
    good = Counter(f for words in clean for n in range(5) for f in forms(words, n) if f in bad)
    rate = lambda f: (bad[f] / len(toxic)) / ((good[f] + 0.5) / len(clean))
    found = sorted((f for f in bad if rate(f) >= ratio), key=lambda f: (-bad[f] * np.log(rate(f)), f))
    out: list[str] = []
    for f in found:  # a form adds nothing to a more telling one that begins alike
        if not any(f.startswith(o.rstrip("*")) or o.startswith(f.rstrip("*")) for o in out):
            out.append(f)
    return out[:most]


def train_units(toxic: list[set[str]], clean: list[set[str]], most: int = 24, n_clean: int = 4000, rounds: int = 2, seed: int = 1, gaps: float = 0.5) -> tuple[np.ndarray, float]:
    """Feature weights and bias of the unit machine.

    Labels belong to texts, so it learns as for multiple instances: units that contain a seed string stand for toxic texts,
    units of clean texts are negative; then each toxic text's best unit joins if it has a positive margin and more than one toxic
    text has it, and the clean units nearest the border are added, and it learns again. Copies with a letter put in, at
    every place, teach it gaps, together ``gaps`` times as much as the unit itself.
    """
    rng = np.random.default_rng(seed)
    marks = seeds(toxic, clean, most) if toxic and clean else []
    if not marks:
        return np.zeros(FEATURE_SPACE, dtype=np.float32), -1.0
    all_bad = sorted(set().union(*toxic))
    often = Counter(u for words in clean for u in words)
    good = set(often)
    pool = sorted(good)
    pool = [pool[i] for i in rng.permutation(len(pool))]
    # each seed teaches as much as any other, however many words begin with it
    group = {m: [u for u in all_bad if u == m or m[-1] == "*" and u.startswith(m[:-1]) and u not in good] for m in marks}
    share = {u: 1 / len(us) for us in group.values() for u in us}
    common = sorted(good, key=lambda u: (-often[u], u))[: n_clean // 4]
    negative = common + pool[:n_clean]
    base = [m.rstrip("*") for m in marks] + pool[: 2 * most]
    row, feature, value = subsequences(base)
    columns, back = np.unique(feature, return_inverse=True)  # only features of landmarks matter
    landmarks = np.zeros((len(base), len(columns)))
    landmarks[row, back] = value
    gram = landmarks @ landmarks.T
    value, vector = np.linalg.eigh(gram + 1e-6 * np.eye(len(base)))
    half = vector / np.sqrt(np.maximum(value, 1e-6))

    def gapped(u: str) -> list[str]:
        """One letter put in at each place, as a fold would not take away."""
        letters = ["abcdefghijklmnopqrstuvwxyz"[int(k)] for k in rng.integers(26, size=len(u))]
        return [u[:k] + c + u[k:] for k, c in enumerate(letters) if k and c not in (u[k - 1], u[k])]

    held_by = Counter(u for words in toxic for u in words)
    weights, bias = np.zeros(FEATURE_SPACE), -1.0
    for r in range(rounds + 1):
        positive = sorted(share)
        copies = [gapped(u) for u in positive]
        strings = positive + [c for some in copies for c in some] + negative
        y = np.concatenate((np.ones(len(strings) - len(negative)), -np.ones(len(negative))))
        weight = np.array([share[u] for u in positive] + [gaps * share[u] / len(some) for u, some in zip(positive, copies, strict=True) for _ in some] + [0.0] * len(negative))
        weight *= 0.5 / weight.sum()
        clean_weight = np.sqrt([often[u] for u in negative])
        weight[len(y) - len(negative) :] = 0.5 * clean_weight / max(1.0, clean_weight.sum())
        w, bias = fit_svm(kernel(strings, landmarks, columns) @ half, y, weight)
        weights[columns] = (half @ w) @ landmarks
        if r == rounds:
            break
        model = Model(weights, bias, np.zeros(FEATURES + 1))
        margin = dict(zip(all_bad, model.plain_margins(all_bad).tolist(), strict=True))
        for u in {max(t, key=lambda u: (margin[u], u)) for t in toxic if t}:
            if margin[u] > 0 and u not in good and held_by[u] > 1:
                share.setdefault(u, 0.2)
        negative = common + pool[:n_clean] + [pool[i] for i in np.argsort(-model.plain_margins(pool), kind="stable")[: n_clean // 2]]
    return weights.astype(np.float32), float(bias)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 800) -> Model:
    """Learns ``toxic`` from at most ``per_class`` labelled documents of each class (the bound on what reaches the driver).

    Two thirds of them, as sets of different words, teach the unit machine; the rest, which it has not seen, sets the scale of
    scores (all of them, if the rest lacks a class).
    """
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("toxic IN (0, 1)")
    rows = sample(documents(docs), labels, "toxic", per_class)

    def per_batch(batches):
        for b in batches:
            words = [sorted(set(units(t))) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.list_(pa.string())), b.column(1), b.column(2)], ["u", "y", "h"])

    found = rows.select("text", "toxic", F.xxhash64("doc_id").alias("h")).mapInArrow(per_batch, "u array<string>, y int, h long")
    prior = labels.agg(F.avg("toxic")).first()[0] or 0.0
    model = learned([(r["y"], set(r["u"])) for r in found.toArrow().sort_by("h").to_pylist()], prior)
    model.known.clear()
    fold.cache_clear()
    give_back()  # the driver goes on to other jobs
    return model


def learned(rows: list[tuple[int, set[str]]], prior: float) -> Model:
    """The model of labels and words of documents, in an order of their own; ``prior`` is the share of toxic labels."""
    learn = [r for k, r in enumerate(rows) if k % 3 < 2]
    weights, bias = train_units([u for y, u in learn if y], [u for y, u in learn if not y])
    model = Model(weights, bias, np.append(np.zeros(FEATURES), np.log((prior + 1e-3) / (1 - prior + 1e-3))))
    for scale in ([r for k, r in enumerate(rows) if k % 3 == 2], rows):
        y = np.array([y for y, _ in scale], dtype=float)
        if len(set(y.tolist())) == 2:
            model.top = fit_dense(model.describe([" ".join(sorted(u)) for _, u in scale]), y, l2=1e-3, prior=prior)
            break
    return model


def score(docs: DataFrame, model: Model, name: str = "score", text_col: str = "text") -> DataFrame:
    """``docs`` with a column ``name`` from 0 to 1 for each row, from its whole text.

    All columns keep their names, whatever these are, and their types; ids take no part, repeated rows get the same score, and an
    empty table gives an empty one.
    """
    names = docs.columns
    flat = docs.toDF(*(f"c{i}" for i in range(len(names))))  # whatever the names, dots and case
    schema = T.StructType([*flat.schema.fields, T.StructField("score", T.DoubleType())])
    at_text = [c.lower() for c in names].index(text_col.lower())

    def per_batch(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.scores(b.column(at_text).to_pylist()), pa.float64())], schema.names)
        model.known.clear()
        fold.cache_clear()
        give_back()

    return flat.mapInArrow(per_batch, schema).toDF(*names, name)


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 800) -> DataFrame:
    """Per row of ``docs``: ``doc_id, held_out, score, predicted``.

    Learns only from labels whose crc32 of the id as text is not divisible by 5. Null and empty texts get the score of a
    text without units. Null labels and labels without a document are ignored; without both classes the score is the share
    of toxic labels. Repeated rows get the same score; an empty table gives an empty result.
    """
    model = fit(docs, labels.filter(~in_fold(5, 0)), per_class)
    rows = documents(docs).withColumn("held_out", in_fold(5, 0))
    return score(rows, model).select("doc_id", "held_out", "score").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
