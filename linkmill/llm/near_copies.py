"""Near copies: texts whose sets of word shingles have a Jaccard similarity of at least 0.8, and their components.

SimHash links (:mod:`.simhash`) bring the nearest copies together. At a similarity of 0.8 fingerprints differ by ten bits
and more, where no index of one-wildcard segments tells copies from others, so what they leave apart is found by an
exact prefix filter over the same shingles. Every candidate is compared by its whole sets.
"""

from __future__ import annotations

import gc

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ASCII_LOWER, cut_lineage, documents, window_hashes, word_hashes, word_spans
from .components import apart, connected_components
from .simhash import joining_links, majority

#: Least similarity as a fraction, so that all bounds are whole numbers.
SHARE = (4, 5)
#: Texts asked for by candidates are broadcast as ids up to this number (24 bytes each), and joined by shuffle beyond it.
FEW = 100_000
#: Tokens with more sets than this have them compared in blocks of about so many.
HOT_TOKEN, BLOCK = 64, 256
#: Rows of a batch that are held as Python objects at once.
SLICE = 2000


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes (64 bits, signed) of the runs of ``words`` words; of all words together if there are fewer; none without words."""
    hashes = word_hashes(*word_spans((text or "").encode().translate(ASCII_LOWER)))
    return np.unique(window_hashes(hashes, min(words, len(hashes))).view(np.int64)) if len(hashes) else np.zeros(0, dtype=np.int64)


def prefix_size(n: int, share: tuple[int, int] = SHARE) -> int:
    """So many of a set's ``n`` members that any set similar enough shares one of them, whatever order ranks both."""
    return n - -(-share[0] * n // share[1]) + 1 if n else 0


def similar(a: np.ndarray, b: np.ndarray, share: tuple[int, int] = SHARE) -> bool:
    if share[1] * min(len(a), len(b)) < share[0] * max(len(a), len(b)):
        return False
    same = len(np.intersect1d(a, b, assume_unique=True))
    return share[1] * same >= share[0] * (len(a) + len(b) - same)


def frequent(docs: DataFrame, words: int, least: int = 8, most: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, sorted, and how often they repeat: counted over all documents wherever a batch holds one twice.

    They only rank shingles, so that a passage of many documents comes last in every set; no result depends on them.
    """

    def per_batch(batches):
        for b in (whole.slice(at, SLICE) for whole in batches for at in range(0, whole.num_rows, SLICE)):
            found = [shingles(t, words) for t in b.column(0).to_pylist()]
            values, n = np.unique(np.concatenate(found) if found else np.zeros(0, dtype=np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values[n > 1]), pa.array(n[n > 1])], ["token", "n"])

    counted = documents(docs).select("text").mapInArrow(per_batch, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = counted.filter(F.col("n") >= least).orderBy(F.desc("n"), "token").limit(most).toArrow()
    values, n = np.asarray(top["token"]), np.asarray(top["n"])
    order = np.argsort(values)
    return values[order], n[order]


def _settled(df: DataFrame) -> DataFrame:
    """``df`` in the checkpoint folder; a collection lets Spark's cleaner delete the shuffles behind it."""
    df = cut_lineage(df)
    gc.collect()
    df.sparkSession._jvm.System.gc()
    return df


def sets(docs: DataFrame, words: int, share: tuple[int, int]) -> DataFrame:
    """Per row: ``doc_id``, hashes of its text (``key``) and of its set (``sid``), the set's size ``n``, its SimHash ``fp``, its
    rarest members in order (``prefix``), and the place of the last of these in the order of all shingles (``often, last``)."""
    known, counts = frequent(docs, words)

    def per_batch(batches):
        for b in (whole.slice(at, SLICE) for whole in batches for at in range(0, whole.num_rows, SLICE)):
            sid, n, fp, prefix, ends = [], [], [], [], []
            for t in b.column(2).to_pylist():
                s = shingles(t, words)
                often = np.zeros(len(s), dtype=np.int64)
                if len(known) and len(s):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    often = np.where(known[at] == s, counts[at], 0)
                order = np.argsort(often, kind="stable")[: prefix_size(len(s), share)]
                sid.append(xxhash.xxh3_64_intdigest(s.tobytes()))
                n.append(len(s))
                fp.append(majority(s.view(np.uint64)))
                prefix.append(s[order])
                ends.append((often[order[-1]], s[order[-1]]) if len(s) else (0, 0))
            columns = [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (sid, fp)]
            columns += [pa.array(n, pa.int64()), pa.array(prefix, pa.list_(pa.int64())), *(pa.array([e[i] for e in ends], pa.int64()) for i in (0, 1))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], ["doc_id", "key", "sid", "fp", "n", "prefix", "often", "last"])

    rows = documents(docs).select("doc_id", F.xxhash64("text").alias("key"), "text")
    return rows.mapInArrow(per_batch, "doc_id long, key long, sid long, fp long, n long, prefix array<long>, often long, last long")


def shared_tokens(folded: DataFrame) -> DataFrame:
    """``token, sid``: members of prefixes that at least two sets have in theirs. Similar sets always share one."""
    tokens = folded.select("sid", F.explode("prefix").alias("token"))
    shared = tokens.groupBy("token").count().filter("count > 1").select("token")
    return tokens.join(shared, "token", "left_semi").select("token", "sid")


def possible(counted: DataFrame, folded: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Those of ``a, b, same`` (how many tokens their prefixes share) that sizes and counts leave possible.

    Whichever prefix ends first in the common order, behind its end only the rest of its set can be shared too.
    """
    p, q = share
    facts = folded.select("sid", "n", "often", "last")
    side = lambda s: facts.select(*(F.col(c).alias(f"{s}_{c}") for c in facts.columns))
    both = counted.join(side("a"), F.col("a") == F.col("a_sid")).join(side("b"), F.col("b") == F.col("b_sid"))
    rest = lambda s: F.floor((F.col(f"{s}_n") * p + (q - 1)) / q) - 1  # noqa: E731  # the set without its prefix
    behind = F.when(F.struct("a_often", "a_last") <= F.struct("b_often", "b_last"), rest("a")).otherwise(rest("b"))
    sizes = F.least("a_n", "b_n") * q >= F.greatest("a_n", "b_n") * p
    return both.filter(sizes & ((F.col("same") + behind) * (p + q) >= (F.col("a_n") + F.col("b_n")) * p)).select("a", "b")


def _pairs(x: DataFrame, y: DataFrame, on: Column) -> DataFrame:
    """``a, b, same``: in how many tokens sets of ``x`` and ``y`` meet."""
    met = x.alias("x").join(y.alias("y"), (F.col("x.token") == F.col("y.token")) & on)
    return met.groupBy(F.least("x.sid", "y.sid").alias("a"), F.greatest("x.sid", "y.sid").alias("b")).agg(F.count("*").alias("same"))


def led_pairs(tokens: DataFrame, leaders: int) -> DataFrame:
    """``a, b, same`` of sets with the ``leaders`` first sets of each token: a bounded number of partners in any group."""
    first = tokens.withColumn("nth", F.row_number().over(W.partitionBy("token").orderBy("sid"))).filter(F.col("nth") <= leaders)
    return _pairs(first.select("token", "sid"), tokens, F.col("x.sid") < F.col("y.sid"))


def left_pairs(tokens: DataFrame, parts: DataFrame, folded: DataFrame, share: tuple[int, int], hot: int = HOT_TOKEN, block: int = BLOCK) -> DataFrame:
    """``a, b``: the possible pairs among all sets that share a token and lie in different components.

    Tokens with up to ``hot`` members pair them in a join: those outside the token's largest component with the rest. Members
    of the others, which are dense groups just under the threshold, meet in blocks by that component: blocks of its own
    members with blocks of the others, and the latter among themselves. A block pair counts whole prefixes in one task
    and returns possible pairs only, so the rows made are about ``block`` times fewer than the pairs compared. A pair that
    shares any token of the second kind is counted there in full, any other in the join.
    """
    rest = apart(tokens, parts, "sid", ["token"])
    cold = rest.filter(F.col("members") <= hot)
    once = (F.col("y.component") == F.col("y.largest")) | (F.col("x.sid") < F.col("y.sid"))
    few = _pairs(cold.filter("component <> largest"), cold, (F.col("x.component") != F.col("y.component")) & once)
    few = possible(few, folded, share)
    group = cut_lineage(rest.filter(F.col("members") > hot).select("largest", "sid", "component").distinct())
    if group.isEmpty():
        return few
    inner = F.col("component") == F.col("largest")
    sizes = group.groupBy("largest").agg(F.ceil(F.count_if(inner) / block).cast("int").alias("inside"), F.ceil(F.count_if(~inner) / block).cast("int").alias("outside"))
    dealt = group.join(sizes, "largest").filter("outside > 0").withColumn("at", F.pmod(F.xxhash64("sid"), F.when(inner, F.col("inside")).otherwise(F.col("outside"))).cast("int"))
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    mixed = F.transform(upto("outside"), lambda i: F.struct(F.lit(0).alias("kind"), i.alias("i"), F.col("at").alias("j")))
    across = F.transform(F.when(F.col("inside") > 0, upto("inside")).otherwise(F.array().cast("array<int>")), lambda j: F.struct(F.lit(0).alias("kind"), F.col("at").alias("i"), j.alias("j")))
    among = F.transform(upto("outside"), lambda j: F.struct(F.lit(1).alias("kind"), F.least("at", j).alias("i"), F.greatest("at", j).alias("j")))
    facts = folded.select("sid", "n", "often", "last", "prefix")
    rows = dealt.select("largest", "sid", "component", F.explode(F.when(inner, mixed).otherwise(F.concat(across, among))).alias("meet")).join(facts, "sid")
    met = rows.groupBy("largest", "meet").applyInPandas(_met(share), "a long, b long")
    return few.unionByName(met).distinct()


def _met(share: tuple[int, int]):
    """The possible pairs of different components among the sets of one block pair, by counts of shared prefix members."""
    p, q = share

    def compare(pdf):
        prefix, n, component, sid = pdf["prefix"].tolist(), pdf["n"].to_numpy(), pdf["component"].to_numpy(), pdf["sid"].to_numpy()
        owner = np.repeat(np.arange(len(pdf)), [len(x) for x in prefix])
        _, token, times = np.unique(np.concatenate(prefix), return_inverse=True, return_counts=True)
        shared = times[token] > 1
        owner, token = owner[shared], np.unique(token[shared], return_inverse=True)[1]
        same = np.zeros((len(pdf), len(pdf)), dtype=np.float32)
        for at in range(0, int(token.max(initial=-1)) + 1, 4096):
            here = (token >= at) & (token < at + 4096)
            has = np.zeros((len(pdf), 4096), dtype=np.float32)
            has[owner[here], token[here] - at] = 1
            same += has @ has.T
        _, rank = np.unique(np.stack([pdf["often"].to_numpy(), pdf["last"].to_numpy()], 1), axis=0, return_inverse=True)
        rank, rest = rank.ravel(), -(-p * n // q) - 1
        behind = np.where(rank[:, None] <= rank[None, :], rest[:, None], rest[None, :])
        total = n[:, None] + n[None, :]
        good = (component[:, None] != component[None, :]) & (same > 0) & ((same + behind) * (p + q) >= total * p)
        good &= np.minimum(n[:, None], n[None, :]) * q >= np.maximum(n[:, None], n[None, :]) * p
        x, y = np.nonzero(np.triu(good, 1))
        return pd.DataFrame({"a": np.minimum(sid[x], sid[y]), "b": np.maximum(sid[x], sid[y])})

    return compare


def simhash_pairs(folded: DataFrame, tokens: DataFrame) -> DataFrame:
    """``a, b``: sets with equal or linked fingerprints, by way of one set for each fingerprint.

    Only sets that share a token of their prefixes are indexed; no other can be similar to any.
    """
    rows = folded.join(tokens.select("sid").distinct(), "sid", "left_semi").select("sid", "fp")
    heads = cut_lineage(rows.groupBy("fp").agg(F.min("sid").alias("head")))
    equal = rows.join(heads, "fp").filter("sid <> head").select(F.col("head").alias("a"), F.col("sid").alias("b"))
    linked = _settled(joining_links(heads.select("fp")))
    of = lambda s: heads.select(F.col("fp").alias(s), F.col("head").alias(f"{s}_head"))
    linked = linked.join(of("a"), "a").join(of("b"), "b").select(F.least("a_head", "b_head").alias("a"), F.greatest("a_head", "b_head").alias("b"))
    return equal.unionByName(linked)


def links(docs: DataFrame, folded: DataFrame, pairs: DataFrame, words: int, share: tuple[int, int]) -> DataFrame:
    """``u, v``: those of ``pairs`` (``a, b``) whose texts are similar, each compared by its whole sets."""
    pairs = _settled(pairs.distinct())
    asked = folded.join(pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct(), "sid", "left_semi")
    asked = cut_lineage(asked.select("sid", F.col("least.doc_id").alias("i"), F.col("least.key").alias("k")))
    asked = F.broadcast(asked) if asked.count() <= FEW else asked
    rows = documents(docs).withColumn("k", F.xxhash64("text"))
    texts = rows.join(asked, rows["doc_id"].eqNullSafe(asked["i"]) & (rows["k"] == asked["k"])).select("sid", "text").dropDuplicates(["sid"])
    texts = _settled(texts)
    of = lambda s, t: texts.select(F.col("sid").alias(s), F.col("text").alias(t))
    both = pairs.join(of("a", "s"), "a").join(of("b", "t"), "b")

    def per_batch(batches):
        for b in (whole.slice(at, SLICE // 4) for whole in batches for at in range(0, whole.num_rows, SLICE // 4)):
            seen: dict[int, np.ndarray] = {}
            keep = []
            for a, c, s, t in zip(*[b.column(i).to_pylist() for i in range(4)], strict=True):
                for sid, text in ((a, s), (c, t)):
                    if sid not in seen:
                        seen[sid] = shingles(text, words)
                keep.append(similar(seen[a], seen[c], share))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return _settled(both.select("a", "b", "s", "t").mapInArrow(per_batch, "u long, v long"))


def near_copies(docs: DataFrame, words: int = 5, share: tuple[int, int] = SHARE, leaders: int = 16, hot: int = HOT_TOKEN, block: int = BLOCK) -> DataFrame:
    """Per row of ``docs``: ``doc_id, key, component_id`` (the smallest ``doc_id`` reachable over links, itself included), ``head``.

    Texts are linked if the Jaccard similarity of their sets of word shingles (A-Z in lower case) is at least ``share``;
    shorter texts are one shingle. Rows of equal sets are folded first, so exact copies are never paired.

    1. Candidates are SimHash links, and sets that share rare shingles with the ``leaders`` first sets that have them. Those
       that hold by their whole sets join most of each group, at a bounded number of partners for each set.
    2. Then all sets that share a rare shingle and still lie in different components meet (:func:`left_pairs`). Every
       pair similar enough shares one (:func:`prefix_size`), so no link between components is lost.

    Sets and shingles are told apart by 64-bit hashes. ``key`` is the 64-bit hash of the text; ``head`` marks the row with the
    smallest (``doc_id``, ``key``) of its group, repeated rows alike. Null and empty texts have the empty set and are copies of each
    other. Rows with a null ``doc_id`` link too but never name a component, whose id is null only if all its ids are. An
    empty table gives an empty result.
    """
    found = _settled(sets(docs, words, share))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("least")
    facts = [F.any_value(c).alias(c) for c in ("n", "fp", "prefix", "often", "last")]
    folded = _settled(found.groupBy("sid").agg(*facts, least))
    tokens = _settled(shared_tokens(folded))
    # each by itself: of one plan for all the driver would hold every step, planned anew after each exchange
    near = _settled(possible(led_pairs(tokens, leaders), folded, share)).unionByName(simhash_pairs(folded, tokens))
    joined = links(docs, folded, near, words, share)
    parts = cut_lineage(connected_components(joined))
    left = cut_lineage(left_pairs(tokens, parts, folded, share, hot, block))
    if not left.isEmpty():
        parts = connected_components(joined.unionByName(links(docs, folded, left, words, share)))
    grouped = folded.join(parts, folded.sid == parts.node, "left").select("sid", "least", F.coalesce("component", "sid").alias("component"))
    named = grouped.groupBy("component").agg(F.min("least").alias("first"))
    named = grouped.join(named, "component").select("sid", "first")
    head = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key"))
    return found.join(named, "sid").select("doc_id", "key", F.col("first.doc_id").alias("component_id"), head.alias("head"))
