"""Items that were merged into others: redirects closed by pointer doubling, and old ids replaced by current ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut_lineage


def _smaller(a: Column, b: Column) -> Column:
    """The smaller of two ids: the shorter one, or of equal length the first by code point, so that Q9 comes before Q10."""
    return F.least(F.struct(F.char_length(a).alias("n"), a.alias("id")), F.struct(F.char_length(b).alias("n"), b.alias("id")))["id"]


def merged_ids(redirects: DataFrame) -> DataFrame:
    """``old, current``: where each id of ``redirects`` (``old, new``) ends up.

    Of several targets of an id the smallest counts. Every round joins the ids that aren't at an end with the table itself, so
    the steps that an id looks ahead double and a chain of a million links takes twenty rounds; ids that are at an end
    take no further part. Each round leaves fewer ids open as long as any of them leads to an end. Those left then lead
    into circles, and a circle ends at its smallest id: they go on until they have looked ahead as many steps as there
    are such ids, so that each stands on its circle and has seen all of it. Null ids and ids that are
    their own target are no redirects.
    """
    rows = redirects.select(F.col("old").cast("string").alias("old"), F.col("new").cast("string").alias("new")).na.drop().filter("old <> new")
    rows = rows.groupBy("old").agg(F.min(F.struct(F.char_length("new").alias("n"), "new"))["new"].alias("new"))
    # least: the smallest id among the steps so far; open: the step after would lead on
    keys = rows.select(F.col("old").alias("_at"))
    first = cut_lineage(rows.join(keys, F.col("new") == F.col("_at"), "left").select("old", "new", F.col("new").alias("least"), F.col("_at").isNotNull().alias("open")))
    done, now, ahead, circles = [first.filter("NOT open")], first.filter("open"), 1, False
    left = now.count()
    while left and not (circles and ahead >= left):
        # an open id's target is either at an end or open itself, and so a row of one of these tables
        step = reduce(DataFrame.unionByName, [*done, now]).select(F.col("old").alias("_at"), F.col("new").alias("_new"), F.col("least").alias("_least"), F.col("open").alias("_open"))
        met = now.join(step, F.col("new") == F.col("_at"))
        met = cut_lineage(met.select("old", F.col("_new").alias("new"), _smaller(F.col("least"), F.col("_least")).alias("least"), F.col("_open").alias("open")))
        done.append(met.filter("NOT open"))
        now = met.filter("open")
        before, left, ahead = left, now.count(), ahead * 2
        circles = left == before
    found = reduce(DataFrame.unionByName, done).select("old", F.col("new").alias("current"))
    if left:
        whole = now.select(F.col("old").alias("_at"), F.col("least").alias("current"))
        found = found.unionByName(now.join(whole, F.col("new") == F.col("_at")).select("old", "current"))
    return found


def current_ids(rows: DataFrame, merged: DataFrame, *columns: str) -> DataFrame:
    """``rows`` with merged ids in ``columns`` replaced by current ones; other values, NIL among them, stay."""
    for c in columns:
        to = merged.select(F.col("old").alias("_old"), F.col("current").alias("_current"))
        names = rows.columns
        rows = rows.join(to, F.col(c) == F.col("_old"), "left").withColumn(c, F.coalesce("_current", c)).select(*names)
    return rows


def current_run(runs: DataFrame, merged: DataFrame) -> DataFrame:
    """Run rows (``run, id, gold, qid, initial_qid, candidates``) whose labels, answers and candidates are current ids.

    Only rows that hold a merged id leave the table for it: their ids meet the redirects one by one and come back as a map. A
    candidate that two ids led to stands once, at its first place.
    """
    held = F.array_distinct(F.concat(F.array("gold", "qid", "initial_qid"), F.coalesce("candidates", F.array().cast("array<string>"))))
    used = runs.select("run", "id", F.explode(held).alias("_old")).filter("_old IS NOT NULL").distinct()
    to = merged.select(F.col("old").alias("_old"), F.col("current").alias("_current"))
    maps = used.join(to, "_old").groupBy(F.col("run").alias("_run"), F.col("id").alias("_id")).agg(F.map_from_entries(F.collect_list(F.struct("_old", "_current"))).alias("_map"))
    rows = runs.join(maps, F.col("run").eqNullSafe(F.col("_run")) & F.col("id").eqNullSafe(F.col("_id")), "left")
    new = lambda c: F.when(F.col("_map").isNull(), c).otherwise(F.coalesce(F.try_element_at("_map", c), c))
    changed = {c: new(F.col(c)) for c in ("gold", "qid", "initial_qid")}
    changed["candidates"] = F.when(F.col("_map").isNull(), F.col("candidates")).otherwise(F.array_distinct(F.transform("candidates", new)))
    return rows.withColumns(changed).select(*runs.columns)
