"""Mixing sources to target weights: document rates by entropy balancing, rounded into copies."""

from __future__ import annotations

from fractions import Fraction
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut_lineage

WEIGHTS = (5, 2, 1)
#: Times that a document may be taken.
MOST = 3
#: Parts of the unit interval by which a source's documents are counted where copies are rounded.
BINS = 1 << 14
ROUNDS = 200
#: Sources of which a table (under 100 bytes each) is sent to all tasks; more are joined by Spark's choice.
FEW_SOURCES = 50_000


def _beside(rows: DataFrame, small: DataFrame, name: str, few: bool, kind: str = "inner") -> DataFrame:
    """``rows`` with the row of their source in ``small`` (which calls it ``name``)."""
    return rows.join(F.broadcast(small) if few else small, F.col("source").eqNullSafe(F.col(name)), kind)


def sizes(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size`` (words of the whole text) and ``row``, a hash of the text, of each row."""
    text = F.col("text").cast("string")
    size = F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64(text).alias("row"))


def _numbered(sources: DataFrame, parts: int = 200) -> DataFrame:
    """Adds ``nth``, a source's place by code point (from 0, null last): counts of ranges of sources, then places inside each range."""
    dealt = sources.repartitionByRange(parts, F.col("source").asc_nulls_last()).withColumn("_part", F.spark_partition_id())
    dealt = cut_lineage(dealt)
    before = dealt.groupBy("_part").count().select("_part", (F.sum("count").over(W.orderBy("_part")) - F.col("count")).alias("_before"))
    inside = F.row_number().over(W.partitionBy("_part").orderBy(F.col("source").asc_nulls_last())) - 1
    return dealt.withColumn("_inside", inside).join(before, "_part").select("source", "source_size", (F.col("_before") + F.col("_inside")).alias("nth"))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, most: int = MOST) -> DataFrame:
    """``source, source_size, target``: ``sources`` (``source, source_size``) share ``share`` of all words by weight.

    Weights repeat over the sources by code point, null last. No target exceeds ``most`` times its source's size; what is
    above is shared anew by weight among the others. All sources share one price a unit of weight, which rises from round
    to round until no more of them reach their bound: each round is one aggregate of whole numbers. An empty table
    gives an empty one.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") % len(weights) + 1).cast("int")).cast("long")
    rows = cut_lineage(_numbered(sources).select("source", "source_size", weight.alias("weight")))
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    wanted, price = total * Fraction(share).limit_denominator(10**6), Fraction(0)
    full = F.lit(False)
    while True:
        got = rows.agg(F.coalesce(F.sum(F.when(full, F.col("source_size") * most)), F.lit(0)).alias("held"), F.sum(F.when(~full, F.col("weight"))).alias("weights")).first()
        if not got["weights"] or (new := max(Fraction(0), wanted - got["held"]) / got["weights"]) <= price:
            break
        price = new
        # whole numbers: size * most <= weight * price
        full = F.col("source_size").cast("decimal(38,0)") * most * F.lit(price.denominator).cast("decimal(38,0)") <= F.col("weight").cast("decimal(38,0)") * F.lit(price.numerator).cast("decimal(38,0)")
    target = F.when(full, F.col("source_size") * float(most)).otherwise(F.col("weight") * float(price))
    return rows.select("source", "source_size", target.alias("target"))


def _rate(size: Column, tilt: Column, most: int) -> Column:
    """Copies of a document: e to the tilt times its size in mean sizes, at most ``most``."""
    return F.when(tilt * size >= log(most), F.lit(float(most))).otherwise(F.exp(tilt * size))


def tilts(counts: DataFrame, aims: DataFrame, most: int = MOST, near: float = 1e-6) -> DataFrame:
    """``source, mean, tilt``: the multipliers under which the documents' rates give each source its target.

    ``counts`` is ``source, size, n`` (documents of the same source and size have the same rate), ``aims`` the sources' ``source_size`` and
    ``target``. Of all rates from 0 to ``most`` that meet the targets those are meant that differ least in relative entropy from one
    copy each: exp(tilt * size). The multipliers are where the dual's gradient, words given less words asked, is zero. Newton
    steps find them, all sources at once: a round is a join of the counts with the multipliers and one aggregate by
    source. A step that leaves the bracket of signs seen so far is replaced by its middle. Rates are summed as
    decimals, so no order of partitions changes a digit.
    """
    means = counts.groupBy(F.col("source").alias("s")).agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    start = aims.join(means, F.col("source").eqNullSafe(F.col("s"))).select("source", "source_size", "target", "mean",
        F.lit(0.0).alias("tilt"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(False).alias("done"))
    # where all documents are taken most times, or nothing is asked, there is nothing to solve
    top, bottom = F.col("target") >= F.col("source_size") * most, F.col("target") <= 0
    state = cut_lineage(start.withColumns({"tilt": F.when(top, F.lit(float("inf"))).when(bottom, F.lit(float("-inf"))).otherwise(F.col("tilt")), "done": top | bottom}))
    for _ in range(ROUNDS):
        if state.filter("NOT done").isEmpty():
            return state.select("source", "mean", "tilt")
        open_ = state.filter("NOT done").select(F.col("source").alias("s"), F.col("mean").alias("m"), F.col("tilt").alias("t"))
        x = counts.join(open_, F.col("source").eqNullSafe(F.col("s")))
        size = F.col("size") / F.col("m")
        rate = _rate(size, F.col("t"), most)
        exact = lambda c: F.sum(c.cast("decimal(38,9)")).cast("double")
        words = F.col("n") * F.col("size")
        sums = x.groupBy("s").agg(exact(words * rate).alias("given"), exact(F.when(F.col("t") * size < log(most), words * size * rate).otherwise(0.0)).alias("slope"))
        state = cut_lineage(_step(state.join(sums, F.col("source").eqNullSafe(F.col("s")), "left"), near))
    raise RuntimeError(f"rates don't settle in {ROUNDS} rounds")


def _step(x: DataFrame, near: float) -> DataFrame:
    """One Newton step of each open source, inside its bracket."""
    over = F.col("given") - F.col("target")
    done = F.col("done") | (F.abs(over) <= F.col("target") * near)
    low = F.when(over < 0, F.col("tilt")).otherwise(F.col("low"))
    high = F.when(over > 0, F.col("tilt")).otherwise(F.col("high"))
    x = x.withColumns({"_done": done, "_low": low, "_high": high, "_newton": F.try_subtract(F.col("tilt"), F.try_divide(over, F.col("slope")))})
    # narrower brackets than doubles can tell apart are as good as solved
    tight = F.coalesce(F.col("_high") - F.col("_low") <= F.greatest(F.abs("_low"), F.abs("_high")) * 1e-15, F.lit(False))
    wide = F.when(F.col("_low").isNull(), F.least(F.col("_high") * 2, F.col("_high") - 1)).when(F.col("_high").isNull(), F.greatest(F.col("_low") * 2, F.col("_low") + 1)).otherwise((F.col("_low") + F.col("_high")) / 2)
    good = (F.col("_newton") > F.coalesce("_low", F.lit(float("-inf")))) & (F.col("_newton") < F.coalesce("_high", F.lit(float("inf")))) & (F.abs(F.col("_newton") - F.col("tilt")) <= 8)
    tilt = F.when(F.col("_done"), F.col("tilt")).when(F.coalesce(good, F.lit(False)), F.col("_newton")).otherwise(wide)
    return x.select("source", "source_size", "target", "mean", tilt.alias("tilt"), F.col("_low").alias("low"), F.col("_high").alias("high"), (F.col("_done") | tight).alias("done"))


def copies(rows: DataFrame, most: int = MOST, seed: int = 13, few: bool = False) -> DataFrame:
    """``rows`` (``doc_id, source, size, row, rate, target``) with whole ``copies``, whose words come near the source's target.

    Every document gets its rate rounded down. One more goes to those whose hashed place, less the rate's fraction, is
    lowest, until the source's target is met: for a document that is a chance of its fraction. Where the border lies is
    found by counting words in :data:`BINS` parts of these places; only the documents in the border's part are ranked. What is then
    missing is less than a document, and made good by the one whose size comes nearest (:func:`_nearest`).
    """
    whole = F.floor("rate")
    place = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "row"), F.lit(1 << 40)) / float(1 << 40)
    rows = rows.withColumns({"_whole": whole, "_late": place - (F.col("rate") - whole)})
    rows = rows.withColumn("_bin", F.when((F.col("rate") == F.col("_whole")) | (F.col("size") == 0), F.lit(BINS)).otherwise(F.least(F.lit(BINS - 1), F.floor((F.col("_late") + 1) / 2 * BINS))).cast("int"))
    bins = rows.groupBy("source", "_bin").agg(F.sum(F.col("_whole") * F.col("size")).alias("sure"), F.sum(F.when(F.col("_bin") < BINS, F.col("size")).otherwise(0)).alias("more"), F.max("target").alias("target"))
    by = W.partitionBy("source")
    bins = bins.withColumns({"left": F.col("target") - F.sum("sure").over(by), "upto": F.sum("more").over(by.orderBy("_bin"))})
    border = bins.filter("_bin < %d AND upto - more <= left AND upto > left" % BINS).select(F.col("source").alias("s"), F.col("_bin").alias("edge"), (F.col("left") - F.col("upto") + F.col("more")).alias("room"))
    all_in = bins.groupBy(F.col("source").alias("a")).agg(F.max("left").alias("left"), F.max("upto").alias("upto"))
    edge = all_in.join(border, F.col("a").eqNullSafe(F.col("s")), "left").select("a", F.coalesce("edge", F.when(F.col("left") >= F.col("upto"), BINS).otherwise(-1)).alias("edge"), "room")
    found = _beside(rows, edge, "a", few)
    at_edge = found.filter("_bin = edge AND _bin < %d" % BINS)
    order = W.partitionBy("source").orderBy("_late", "doc_id", "row")
    upto = F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0))
    ranked = at_edge.withColumn("_one", (upto <= F.col("room")).cast("long"))
    rest = found.filter("_bin <> edge OR _bin = %d" % BINS).withColumn("_one", ((F.col("_bin") < F.col("edge")) & (F.col("_bin") < BINS)).cast("long"))
    taken = rest.unionByName(ranked).withColumn("copies", F.least(F.lit(most).cast("long"), F.col("_whole").cast("long") + F.col("_one")))
    names = [*(c for c in rows.columns if not c.startswith("_")), "copies"]
    return _nearest(cut_lineage(taken.select(*names, "_late")), most, few).select(*names)


def _nearest(taken: DataFrame, most: int, few: bool) -> DataFrame:
    """One document of each source is taken once more, or less, if that brings the source's words nearer to its target: the one that brings them nearest."""
    miss = taken.groupBy("source").agg((F.max("target") - F.sum(F.col("copies") * F.col("size"))).alias("miss")).select(F.col("source").alias("s"), "miss")
    rows = _beside(taken, cut_lineage(miss), "s", few)
    turn = F.signum("miss").cast("long")
    able = (F.col("size") > 0) & F.when(turn > 0, F.col("copies") < most).otherwise(F.col("copies") > 0)
    off = F.abs(F.abs("miss") - F.col("size"))
    best = rows.filter(able & (off < F.abs("miss"))).groupBy("source").agg(F.min(F.struct(off.alias("off"), F.col("_late"), F.col("doc_id"), F.col("row"), turn.alias("turn"))).alias("b"))
    best = cut_lineage(best.select(F.col("source").alias("s"), F.col("b.doc_id").alias("i"), F.col("b.row").alias("r"), "b.turn"))
    hit = _beside(taken, best, "s", few, "left").withColumn("turn", F.when(F.col("doc_id").eqNullSafe(F.col("i")) & F.col("row").eqNullSafe(F.col("r")), F.col("turn")))
    # of rows that are the same in all, one turns
    first = F.row_number().over(W.partitionBy("source", "doc_id", "row").orderBy("copies")) == 1
    turned = hit.filter("turn IS NOT NULL").withColumn("copies", F.col("copies") + F.when(first & F.when(F.col("turn") > 0, F.col("copies") < most).otherwise(F.col("copies") > 0), F.col("turn")).otherwise(0))
    return hit.filter("turn IS NULL").unionByName(turned)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, most: int = MOST, seed: int = 13) -> DataFrame:
    """Per row of ``docs``: ``doc_id, source, size, source_size, target, rate, copies``.

    Documents are measured once; from then on only ids, sources and sizes are read. What is solved and rounded works on counts
    by source and size or place, summed before they are shuffled, so a source with a third of all rows costs no more than
    others. Null texts have no words, are taken once a copy and count nothing; a null source is a source, the last
    one; a null id is hashed as such. Repeated rows have one rate and stand together where copies are rounded. An empty
    table gives an empty result. Reruns give the same copies: sums are of whole numbers or decimals.
    """
    rows = cut_lineage(sizes(docs))
    counts = cut_lineage(rows.groupBy("source", "size").agg(F.count("*").alias("n")))
    sources = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    aims = cut_lineage(targets(sources, weights, share, most))
    solved = tilts(counts, aims, most)
    both = cut_lineage(aims.join(solved.select(F.col("source").alias("s"), "mean", "tilt"), F.col("source").eqNullSafe(F.col("s"))).select(F.col("source").alias("s"), "source_size", "target", "mean", "tilt"))
    few = both.count() <= FEW_SOURCES
    rated = _beside(rows, both, "s", few)
    scaled = F.when(F.col("mean") > 0, F.col("size") / F.col("mean")).otherwise(0.0)
    rate = F.when(F.col("tilt") == float("inf"), float(most)).when(F.col("tilt") == float("-inf"), 0.0).otherwise(_rate(scaled, F.col("tilt"), most))
    return copies(rated.select("doc_id", "source", "size", "row", "source_size", "target", rate.alias("rate")), most, seed, few).drop("row")


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
