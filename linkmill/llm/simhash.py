"""SimHash near-duplicates: fingerprints, links at few differing bits, and their components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ASCII_LOWER, cut_lineage, documents
from .components import apart, connected_components

KEYS = ["segment", "wild", "rest"]
#: A key with more members than this is split again by the bits outside its segment.
HOT_KEY = 512
#: A key with more members than this is first joined to a few leaders, where only groups are asked for.
LIGHT_KEY = 64


def majority(hashes: np.ndarray) -> int:
    """64 bits, each 1 if over half of the hashes have it; 0 for none."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, words: int = 4) -> int:
    """64 bits, each 1 if over half of the text's shingle hashes have it; 0 for no words."""
    parts = (text or "").encode().translate(ASCII_LOWER).split()
    if not parts:
        return 0
    line = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = min(words, len(parts)) - 1
    spans = zip(starts[: len(parts) - last].tolist(), ends[last:].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(line[a:b], 42) for a, b in spans], dtype=np.uint64))


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed long) per row."""

    def per_batch(batches):
        for b in batches:
            values = np.array([fingerprint(t, words) for t in b.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(values.view(np.int64))], ["doc_id", "fp"])

    return documents(docs).mapInArrow(per_batch, "doc_id long, fp long")


def segments(distance: int) -> list[tuple[int, int]]:
    """Offset and width of the segments: so few that one of them differs by at most one bit."""
    n = (distance + 2) // 2
    widths = [64 // n + (i >= n - 64 % n) for i in range(n)]
    return [(sum(widths[:i]), w) for i, w in enumerate(widths)]


def _bits(fp: Column, at: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1))


def variants(prints: DataFrame, distance: int) -> DataFrame:
    """``fp, segment, wild, rest``: for each segment and each bit of it, the segment without that bit."""
    rows = []
    for k, (at, width) in enumerate(segments(distance)):
        value = _bits(F.col("fp"), at, width)
        rows += [F.struct(F.lit(k).alias("segment"), F.lit(i).alias("wild"), value.bitwiseAND(F.lit(((1 << width) - 1) & ~(1 << i))).alias("rest")) for i in range(width)]
    return prints.select("fp", F.inline(F.array(*rows)))


def _outside(fp: Column, segment: Column, distance: int) -> Column:
    """The bits outside the segment in ``distance + 1`` pieces, one of which is equal in any two linked prints."""
    out = F.array()
    for k, (at, width) in enumerate(segments(distance)):
        low = fp.bitwiseAND(F.lit((1 << at) - 1)) if at else F.lit(0).cast("long")
        high = F.shiftrightunsigned(fp, at + width) if at + width < 64 else F.lit(0).cast("long")
        rest, n = F.shiftleft(high, at).bitwiseOR(low), 64 - width
        cuts = [n * i // (distance + 1) for i in range(distance + 2)]
        pieces = F.array(*[_bits(rest, a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)])
        out = pieces if k == 0 else F.when(segment == k, pieces).otherwise(out)
    return out


def _dealt(rows: DataFrame, distance: int, carry: list[str], deal: Column | None = None) -> DataFrame:
    """``rows`` once for each piece of the bits outside their segment; where ``deal`` is not true, once as they are."""
    pieces = F.transform(_outside(F.col("fp"), F.col("segment"), distance), lambda v, i: F.struct(i.cast("int").alias("piece"), v.alias("value")))
    if deal is not None:
        whole = F.array(F.struct(F.lit(-1).alias("piece"), F.lit(0).cast("long").alias("value")))
        pieces = F.coalesce(F.when(deal, pieces), whole)
    return rows.select("fp", *KEYS, *carry, F.inline(pieces))


def _meets_once(distance: int, dealt: bool) -> Column:
    """For rows ``x`` and ``y`` of one key (and piece): they are linked, and no earlier key or piece of the pair has emitted it."""
    diff = F.col("x.fp").bitwiseXOR(F.col("y.fp"))
    part = lambda k: _bits(diff, *segments(distance)[k])
    first = F.lit(False)
    for k in range(len(segments(distance))):
        earlier = F.lit(True)
        for j in range(k):
            earlier = earlier & (F.bit_count(part(j)) > 1)
        here = (part(k) != 0) | (F.col("x.wild") == 0)  # a differing bit is the wildcard; equal segments meet 20 times
        first = first | ((F.col("x.segment") == k) & earlier & here)
    on = (F.bit_count(diff) <= distance) & first
    if not dealt:
        return on
    # of equal pieces the first one emits; both sides of a pair are dealt alike, as they share the heavy key
    pieces_x, pieces_y = (_outside(F.col(f"{s}.fp"), F.col("x.segment"), distance) for s in "xy")
    lead = F.array_position(F.zip_with(pieces_x, pieces_y, lambda a, b: a == b), F.lit(True)) - 1
    return on & ((F.col("x.piece") == -1) | (F.col("x.piece") == lead))


def _same(*names: str) -> Column:
    on = F.lit(True)
    for c in names:
        on = on & (F.col(f"x.{c}") == F.col(f"y.{c}"))
    return on


def links(prints: DataFrame, distance: int = 4, hot: int = HOT_KEY) -> DataFrame:
    """``a, b``: all pairs of distinct fingerprints (column ``fp``) that differ by 1 to ``distance`` bits, each once.

    Prints meet on equal one-wildcard variants of a segment; of all variants (and pieces) that two prints share only the
    first one emits them, and the distance is checked inside the join, so nothing but true links leaves it.
    Keys with more than ``hot`` members are dealt out again by pieces of the other bits, so that a dense group
    meets in many small tasks. For groups alone :func:`joining_links` is cheaper.
    """
    rows = variants(prints, distance)
    heavy = cut_lineage(rows.groupBy(*KEYS).count().filter(F.col("count") > hot).select(*KEYS, F.lit(True).alias("heavy")))
    rows = _dealt(rows.join(heavy, KEYS, "left"), distance, [], F.col("heavy"))
    on = _same(*KEYS, "piece", "value") & (F.col("x.fp") < F.col("y.fp")) & _meets_once(distance, True)
    return rows.alias("x").join(rows.alias("y"), on).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))


def joining_links(prints: DataFrame, distance: int = 4, hot: int = LIGHT_KEY, leaders: int = 16) -> DataFrame:
    """``a, b``: true links (as of :func:`links`) that connect all that the full set of links connects, without a dense group's pairs.

    Keys with up to ``hot`` members emit all their links. In a key with more, the ``leaders`` smallest prints meet all
    members, which joins a dense group to a few components; then only members outside the key's largest component meet
    the rest, dealt out by pieces of the other bits, and only pairs of different components. A pair that is in no
    component together is so compared in full, and no link between components is lost.
    """
    rows = variants(prints, distance)
    heavy = cut_lineage(rows.groupBy(*KEYS).count().filter(F.col("count") > hot).select(*KEYS))
    light = rows.join(heavy, KEYS, "left_anti")
    pair = [F.least("x.fp", "y.fp").alias("a"), F.greatest("x.fp", "y.fp").alias("b")]
    ordered = F.col("x.fp") < F.col("y.fp")
    found = light.alias("x").join(light.alias("y"), _same(*KEYS) & ordered & _meets_once(distance, False)).select(*pair)
    if heavy.isEmpty():
        return found
    dense = cut_lineage(rows.join(heavy, KEYS, "left_semi"))
    first = dense.withColumn("nth", F.row_number().over(W.partitionBy(*KEYS).orderBy("fp"))).filter(F.col("nth") <= leaders)
    near = F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= distance
    star = cut_lineage(first.alias("x").join(dense.alias("y"), _same(*KEYS) & ordered & near).select(*pair).distinct())
    rest = apart(dense, connected_components(star.select(F.col("a").alias("u"), F.col("b").alias("v"))), "fp", KEYS)
    rest = _dealt(rest, distance, ["component", "largest"])
    other = (F.col("y.component") == F.col("y.largest")) | ordered
    on = _same(*KEYS, "piece", "value") & (F.col("x.component") != F.col("y.component")) & other & _meets_once(distance, True)
    late = rest.filter("component <> largest").alias("x").join(rest.alias("y"), on).select(*pair)
    return found.unionByName(star).unionByName(late)


def simhash_groups(docs: DataFrame, words: int = 4, distance: int = 4, hot: int = LIGHT_KEY) -> DataFrame:
    """Per row of ``docs``: ``doc_id, fp, component_id`` (the smallest ``doc_id`` reachable over links, itself included).

    Equal fingerprints are first folded to one row with its smallest id, so exact copies are never paired. Links and
    components then work on distinct fingerprints. Null and empty texts have fingerprint zero and link like any other.
    Rows with a null ``doc_id`` link too but never name a component, whose id is null only if all its ids are.
    Repeated rows get the same result; an empty table gives an empty one.
    """
    prints = cut_lineage(fingerprints(docs, words))
    folded = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = joining_links(folded.select("fp"), distance, hot).select(F.col("a").alias("u"), F.col("b").alias("v"))
    parts = connected_components(linked)  # components over fingerprints; then the smallest id in each
    grouped = folded.join(parts, folded.fp == parts.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    named = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    named = grouped.join(named, "component").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
