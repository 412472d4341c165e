"""Annotated corpora to mention rows, links of articles, samples and profiles."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from html.parser import HTMLParser
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.stats import ratio
from ..functions.text import ARABIC, is_date_mention, mention_script, name_tokens, norm_gold, norm_type
from ..sources.numbering import numbered
from .lineage import cut_lineage

#: Titles of links that are sent to all tasks (some 100 bytes each); more are joined by Spark's choice.
FEW_TITLES = 100_000
ITEM = r"^(?:https?://(?:www\.)?wikidata\.org/(?:wiki|entity)/)?(Q\p{Nd}+)$"


def draw(seed: int, *key: Column | str) -> Column:
    """A place in a random order that depends on the seed and the key alone, whatever the partitions."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *key))


def doc_key(doc: Column, text: Column) -> Column:
    return F.coalesce(F.nullif(doc.cast("string"), F.lit("")), text)


def _field(row: Column | None, roles: dict, name: str) -> Column:
    field = roles.get(name)
    if not field:
        return F.lit(None)
    return row[field] if row is not None else F.col(field)


def with_names(df: DataFrame, roles: dict) -> DataFrame:
    """Adds ``doc_id``: the id field as a string; where it is missing or null, the record's number.

    ``roles["number"]`` names a column of record numbers, as the readers give them; without one they are counted here
    (:func:`linkmill.sources.numbering.numbered`), over all records, with an id or not, if any lacks one.
    """
    if roles.get("id") and (not df.schema[roles["id"]].nullable or df.filter(F.col(roles["id"]).isNull()).isEmpty()):
        return df.withColumn("doc_id", F.col(roles["id"]).cast("string"))
    if not roles.get("number"):
        df, roles = numbered(df, "_record"), roles | {"number": "_record"}
    number = F.col(roles["number"]).cast("string")
    return df.withColumn("doc_id", F.coalesce(F.col(roles["id"]).cast("string"), number) if roles.get("id") else number)


def _row(entity: Column | None, roles: dict, source: str | None) -> list[Column]:
    start, end = (_field(entity, roles, n).cast("int") for n in ("start", "end"))
    mention = F.coalesce(F.nullif(_field(entity, roles, "mention").cast("string"), F.lit("")), F.substring(F.col("text"), start + 1, end - start))
    return [F.concat("doc_id", F.lit("-"), F.col("k")).alias("id"), "doc_id", "text", mention.alias("mention"), _field(entity, roles, "type").cast("string").alias("type"),
            start.alias("start"), end.alias("end"), norm_gold(_field(entity, roles, "qid")).alias("gold"), F.lit(source).cast("string").alias("source")]


def mentions_from_nested(df: DataFrame, roles: dict, source: str | None = None) -> DataFrame:
    """One row per entity of each document; a missing mention is cut out by its offsets; rows without text or mention go.

    A record without an id is named by its number (:func:`with_names`).
    """
    docs = with_names(df, roles).select("doc_id", F.col(roles["text"]).alias("text"), F.posexplode(roles["entities"]).alias("k", "e"))
    return docs.filter(r"text RLIKE '\\S'").select(*_row(F.col("e"), roles, source)).filter("mention <> ''")


def mentions_from_flat(df: DataFrame, roles: dict, source: str | None = None) -> DataFrame:
    """One row per record; a record without an id is named by its number (:func:`with_names`), so records of one sentence keep apart."""
    docs = with_names(df, roles).withColumns({"text": F.col(roles["text"]), "k": F.lit(0)})
    return docs.filter(r"text RLIKE '\\S'").select(*_row(None, roles, source)).filter("mention <> ''")


_SPANS = "array<struct<start: int, end: int, type: string, q: string, mention: string>>"


#: Tokens of a batch whose spans are cut at once; a row stays whole.
TOKENS = 1 << 17


def _spans(tokens: pa.Array) -> pa.Array:
    """The spans of a batch of rows, in slices of about :data:`TOKENS` tokens: a batch has a fixed number of rows, of any length."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(tokens), 0).to_numpy())
    cuts = np.flatnonzero(np.diff((ends - 1) // TOKENS, prepend=0)) if len(ends) else []
    edges = [0, *(int(c) for c in cuts if c), len(tokens)]
    return pa.concat_arrays([_spans_of(tokens.slice(a, z - a)) for a, z in zip(edges, edges[1:], strict=False)])


def _spans_of(tokens: pa.Array) -> pa.Array:
    """The spans of rows of tagged tokens (structs of token ``t``, tag ``g`` and item ``q``), all rows at once.

    Running lengths give every token's place; a span begins where a tag opens one and ends before the next token that opens one,
    is outside or begins a row. Items are looked up in the sorted places of valid ones. Time and memory follow the tokens.
    """
    sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy()
    flat = tokens.flatten()
    t = pc.fill_null(pc.struct_field(flat, [0]), "")
    g, q = pc.fill_null(pc.struct_field(flat, [1]), "O"), pc.struct_field(flat, [2])
    n = len(flat)
    after = np.cumsum(pc.utf8_length(t).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    firsts = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(sizes)), sizes)
    base = np.concatenate([[0], after])[firsts][row] if n else np.zeros(0, np.int64)
    end = after - 1 - base
    start = np.concatenate([[0], after])[:-1] - base
    mark, kind = pc.utf8_slice_codeunits(g, 0, 2), pc.utf8_slice_codeunits(g, 2)
    among = lambda *marks: pc.is_in(mark, pa.array(marks)).to_numpy(zero_copy_only=False).astype(bool)
    inside, begins = among("B-", "S-", "I-", "E-"), among("B-", "S-")
    heads = np.zeros(n, dtype=bool)
    heads[firsts[sizes > 0]] = True
    goes_on = np.zeros(n, dtype=bool)
    if n > 1:
        goes_on[1:] = inside[:-1] & pc.equal(kind[1:], kind[:-1]).to_numpy(zero_copy_only=False).astype(bool)
    opens = inside & (begins | heads | ~goes_on)
    first = np.flatnonzero(opens)
    stops = np.append(np.flatnonzero(opens | ~inside | heads), n)
    last = stops[np.searchsorted(stops, first, side="right")] - 1
    items = np.flatnonzero(pc.fill_null(pc.match_substring_regex(pc.utf8_trim_whitespace(q), ITEM), False).to_numpy(zero_copy_only=False))
    at = np.searchsorted(items, first)
    item = np.append(items, n)[at]
    found = pa.array(item, mask=item > last)
    length = last - first + 1
    order = np.repeat(first - np.cumsum(length) + length, length) + np.arange(length.sum())
    words = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()), t.take(pa.array(order, pa.int64())))
    spans = pa.StructArray.from_arrays(
        [pa.array(start[first], pa.int32()), pa.array(end[last], pa.int32()), kind.take(pa.array(first, pa.int64())).cast(pa.string()), q.take(found).cast(pa.string()), pc.binary_join(words, " ").cast(pa.string())],
        ["start", "end", "type", "q", "mention"])
    per_row = np.bincount(row[first], minlength=len(sizes)) if len(first) else np.zeros(len(sizes), dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_row)]), pa.int32()), spans)


def mentions_from_bio(df: DataFrame, roles: dict, source: str | None = None) -> DataFrame:
    """Spans of tagged tokens, with offsets in the tokens joined by spaces.

    ``B-`` and ``S-`` open a span, as do ``I-`` and ``E-`` after nothing or after another type; the span's item is the
    first item id among its tokens. Spans are cut inside the row, in Arrow batches and in time linear in the tokens
    (:func:`_spans`): nothing is shuffled, the text stays where it is, and rows with the same id don't mix. A record without an
    id is named by its number. Tokens without a tag are outside, tags without a token don't count; a null token is an empty one.
    """
    words = [F.coalesce(F.col(roles[c]), F.array().cast("array<string>")) for c in ("tokens", "tags", "qids")]
    text = F.array_join(F.transform(words[0], lambda t: F.coalesce(t, F.lit(""))), " ")
    # zipped, as a lookup of tags by place would evaluate a computed column anew for every token
    zipped = F.slice(F.arrays_zip(*[w.alias(c) for w, c in zip(words, "tgq", strict=True)]), F.lit(1), F.size(words[0]))
    rows = with_names(df, roles).select("doc_id", text.alias("text"), zipped.alias("_tokens"))
    rows = rows.select("doc_id", "text", F.posexplode(F.arrow_udf(_spans, _SPANS)("_tokens")).alias("k", "s"))
    return rows.select(F.concat("doc_id", F.lit("-"), F.col("k")).alias("id"), "doc_id", "text", "s.mention", "s.type", "s.start", "s.end",
                       norm_gold(F.col("s.q")).alias("gold"), F.lit(source).cast("string").alias("source"))


def _around(text: str | None, mention: str | None, start: int | None, end: int | None, first: dict[str, int], chars: int) -> str | None:
    """What :func:`linkmill.functions.text.doc_context` says of one mention; ``first`` keeps where the text's mentions occur first."""
    if text is None or mention is None:
        return None
    s = e = None
    if start is not None and end is not None:
        at = start if start >= 0 else max(0, len(text) + start + 1) if start < -1 else 0
        if text[at : at + max(0, end - start)] == mention:
            s, e = start, end
    if s is None:
        if mention not in first:
            first[mention] = text.find(mention)
        s = first[mention]
        e = s + len(mention)
    if s < 0:
        return text[: 2 * chars]
    a, b = max(0, s - chars), min(len(text), e + chars)
    return f"{'…' if a > 0 else ''}{text[a:s]}⟦{text[s:e]}⟧{text[e:b]}{'…' if b < len(text) else ''}"


def mention_contexts(docs: DataFrame, chars: int = 350) -> DataFrame:
    """``id, context`` of all mentions of documents (``text, mentions``, an array of structs ``id, mention, start, end``).

    The context is :func:`linkmill.functions.text.doc_context`'s. A text stays with its mentions and goes to Python once, where a
    place in it costs the same wherever it lies, and each different mention is searched for once: beside each of its mentions
    a text would be read as often as it has words.
    """
    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, 16) for whole in batches for at in range(0, whole.num_rows, 16)):
            sizes = pc.fill_null(pc.list_value_length(b.column(1)), 0).to_pylist()
            flat = b.column(1).flatten()
            ids = pc.struct_field(flat, [0])
            mentions = zip(*(pc.struct_field(flat, [i]).to_pylist() for i in (1, 2, 3)), strict=True)
            found = []
            for text, n in zip(b.column(0).to_pylist(), sizes, strict=True):
                first: dict[str, int] = {}
                found += [_around(text, *m, first, chars) for m in islice(mentions, n)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(found, pa.string())], ["id", "context"])

    rows = docs.select(F.col("text").cast("string"), F.col("mentions").cast("array<struct<id: string, mention: string, start: int, end: int>>"))
    return rows.mapInArrow(per_batch, "id string, context string")


def detect_roles(df: DataFrame, n: int = 300) -> dict:
    """Guesses layout and fields from the first ``n`` records: one wide aggregate over that bounded sample, one row back.

    Text is the longest string field; an array of structs with item ids makes the layout nested, arrays of strings with
    tags make it bio, else it is flat. A field takes a role by the share of its values that look like it.
    """
    sample = df.limit(n)
    arrays = [f for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
    nested = next((f.name for f in arrays if isinstance(f.dataType.elementType, T.StructType)), None)
    word_lists = [f.name for f in arrays if isinstance(f.dataType.elementType, T.StringType)]

    def shares(rows: DataFrame, columns: dict[str, T.DataType]) -> dict[str, dict[str, float]]:
        tests = {
            "qid": lambda c: F.trim(c).rlike(ITEM),
            "type": lambda c: c.rlike(r"^(?:[BIES]-)?[A-Z_]{2,12}$"), "tag": lambda c: c.rlike(r"^(?:O|[BIES]-.+)$"),
        }
        found = rows.agg(*[F.avg(F.coalesce(t(F.col(c).cast("string")), F.lit(False)).cast("int")).alias(f"{c}|{k}") for c in columns for k, t in tests.items()],
                         *[F.avg(F.char_length(F.col(c).cast("string"))).alias(f"{c}|length") for c in columns], *[F.approx_count_distinct(c).alias(f"{c}|distinct") for c in columns], F.count("*").alias("rows")).first()
        return {c: {k: found[f"{c}|{k}"] or 0 for k in (*tests, "length", "distinct")} | {"rows": found["rows"]} for c in columns}

    def pick(stats: dict, key: str, least: float) -> str | None:
        best = max(stats, key=lambda c: stats[c][key], default=None)
        return best if best is not None and stats[best][key] >= least else None

    top = {f.name: f.dataType for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))}
    stats = shares(sample, top) if top else {}
    named = lambda *names: next((c for w in names for c in top if c.lower() == w), None)
    roles: dict = {"id": named("id", "sent_id", "doc_id", "sentence_id"), "text": named("text", "sentence", "context") or pick({c: s for c, s in stats.items() if isinstance(top[c], T.StringType)}, "length", 1)}
    entities, fields = sample, {c: t for c, t in top.items() if c not in (roles["id"], roles["text"])}
    if nested and len(word_lists) < 2:
        roles |= {"layout": "nested", "entities": nested}
        entities = sample.select(F.inline(nested))
        fields = {f.name: f.dataType for f in entities.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.StructType))}
    elif len(word_lists) >= 2:
        lists = shares(sample.select(F.inline(F.arrays_zip(*word_lists))), dict.fromkeys(word_lists, T.StringType()))
        tags = pick(lists, "tag", 0.9)
        rest = {c: s for c, s in lists.items() if c != tags}
        qids = max(rest, key=lambda c: rest[c]["qid"])
        return roles | {"layout": "bio", "tags": tags, "qids": qids, "tokens": next((c for c in rest if c != qids), None)}
    else:
        roles["layout"] = "flat"
    inner = shares(entities, fields) if fields else {}
    roles["qid"] = pick(inner, "qid", 0.01)
    near = lambda *names: next((c for w in names for c in fields if c.lower() == w), None)
    roles["start"], roles["end"] = near("start", "start_char", "begin", "offset"), near("end", "end_char", "stop")
    left = {c: s for c, s in inner.items() if c not in (roles["qid"], roles["start"], roles["end"]) and isinstance(fields[c], T.StringType)}
    roles["type"] = near("type", "label", "ner", "entity_type") or pick(left, "type", 0.6)
    roles["mention"] = near("mention", "entity", "span", "surface") or pick({c: s for c, s in left.items() if c != roles["type"]}, "length", 1)
    return roles


class _Links(HTMLParser):
    """Paragraph texts of a page with their links."""

    SKIP = {"sup", "style", "script"}
    OUTSIDE = {"table", "figure", "li"}
    VOID = {"br", "img", "hr", "input", "link", "meta", "wbr"}

    def __init__(self, container: str):
        super().__init__(convert_charrefs=True)
        self.container, self.found, self.stack = container, [], []
        self.text, self.links, self.open = None, [], None
        self.skip = self.outside = 0

    def handle_starttag(self, tag, attrs):
        if tag in self.VOID:
            return
        a = dict(attrs)
        names = (a.get("class") or "").split()
        skip = tag in self.SKIP or bool({"mw-editsection", "noprint", "reference"} & set(names))
        self.stack.append((tag, skip))
        self.skip += skip
        self.outside += tag in self.OUTSIDE and tag != self.container and self.container == "p"
        if tag == self.container and self.text is None and not self.outside:
            self.text, self.links, self.open = "", [], None
        elif tag == "a" and self.text is not None and not self.skip:
            self.open = (a.get("href") or "", a.get("title") or "", names, len(self.text))

    def handle_endtag(self, tag):
        if tag not in [t for t, _ in self.stack]:
            return
        while self.stack:
            last, skip = self.stack.pop()
            self.skip -= skip
            self.outside -= last in self.OUTSIDE and last != self.container and self.container == "p"
            if last == "a" and self.open is not None:
                self.links.append((*self.open, len(self.text)))
                self.open = None
            if last == self.container and self.text is not None and self.container not in [t for t, _ in self.stack]:
                self.found.append((self.text, self.links))
                self.text = None
            if last == tag:
                break

    def handle_data(self, data):
        if self.text is not None and not self.skip:
            self.text += data


def link_mentions(pages: DataFrame, id_col: str = "title", html_col: str = "html", container: str = "p", prefix: str = "/wiki/", least: int = 40) -> DataFrame:
    """Links inside the paragraphs of articles: ``doc_id, para, text, anchor, target, start, end``.

    Left out: footnotes and the like, paragraphs in tables, figures and lists, links elsewhere than under ``prefix``, links
    to missing pages, titles with a name space, anchors of one character or of digits, paragraphs of at most ``least``
    characters. Without a title attribute the address names the target. Parsed page by page in Arrow batches.
    """
    def per_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, html in zip(pdf["doc_id"], pdf["html"], strict=True):
                parser = _Links(container)
                parser.feed(html or "")
                parser.close()
                for para, (text, links) in enumerate(parser.found):
                    for href, title, names, s, e in links:
                        target = (title or href.removeprefix(prefix)).split("#")[0]
                        if not href.startswith(prefix) or "redlink" in href or "new" in names or not target or ":" in target:
                            continue
                        anchor = text[s:e]
                        s, e = s + len(anchor) - len(anchor.lstrip()), e - len(anchor) + len(anchor.rstrip())
                        if e - s >= 2 and not all(c.isspace() or c.isdigit() for c in text[s:e]) and len(text.strip()) > least:
                            rows.append((doc, para, text, text[s:e], target, s, e))
            yield pd.DataFrame(rows, columns=["doc_id", "para", "text", "anchor", "target", "start", "end"])

    rows = pages.select(F.col(id_col).cast("string").alias("doc_id"), F.col(html_col).alias("html"))
    return rows.mapInPandas(per_batch, "doc_id string, para int, text string, anchor string, target string, start int, end int")


def build_link_set(links: DataFrame, titles: DataFrame, closure: DataFrame | None, instances: DataFrame | None, n: int, max_per_article: int = 4, alias_frac: float = 0.7, crop: int = 900, seed: int = 13) -> DataFrame:
    """A silver set of mentions from links: ``titles`` maps ``target`` to ``gold``.

    Links whose words are not the title's (less a closing parenthesis) are *aliases*; a hashed coin decides before each
    pick whether an alias or a plain link comes next, as long as there are both. Items known to be no named entity
    (``instances`` of classes outside ``closure``) are out, each item counts once an article, at most
    ``max_per_article`` links an article stay, long texts are cropped around the mention, and the ``n`` first documents'
    rows by hash remain (a top-k, no sort of all).

    Links are chosen without their texts, which are read again for the ``n`` chosen ones alone. Of an article's aliases, and
    of its plain links, only the first of each item and the first ``max_per_article`` of these can be chosen, so no more meet
    the coins. Words of names are found once for each title and each different anchor. Both go to all tasks up to
    :data:`FEW_TITLES`, as many links may have one target; beyond that Spark joins.
    """
    known = titles.select("target", "gold").filter("gold IS NOT NULL")
    if closure is not None and instances is not None:
        typed = instances.join(closure.select("class").distinct().withColumn("named", F.lit(True)), "class", "left")
        barred = typed.groupBy("qid").agg(F.bool_or(F.coalesce("named", F.lit(False))).alias("named")).filter("NOT named")
        known = known.join(barred.select(F.col("qid").alias("gold")), "gold", "left_anti")
    words = lambda c: F.array_join(name_tokens(c), " ")
    key = ["doc_id", "para", "start", "end", "anchor", "target"]
    few = lambda df: F.broadcast(df) if df.count() <= FEW_TITLES else df
    known = cut_lineage(known.withColumn("_title", words(F.regexp_replace("target", r"\s*\(.*?\)\s*$", ""))))
    rows = cut_lineage(links.select(*key).join(few(known), "target"))
    anchors = cut_lineage(rows.select("anchor").distinct().select(F.col("anchor").alias("_anchor"), words(F.col("anchor")).alias("_words")))
    rows = rows.join(few(anchors), F.col("anchor").eqNullSafe(F.col("_anchor")))
    rows = rows.select(*key, "gold", (F.col("_words") != F.col("_title")).alias("alias"), draw(seed, "doc_id", "para", "start", "anchor").alias("place"))
    rows = rows.withColumn("nth", F.row_number().over(W.partitionBy("doc_id", "alias").orderBy("place")).cast("long"))
    rows = rows.groupBy("doc_id", "alias", "gold").agg(F.count("*").alias("links"), F.min_by(F.struct("nth", "place", *key[1:]), "nth").alias("first"))
    rows = rows.select("doc_id", "alias", "gold", "first.*", F.sum("links").over(W.partitionBy("doc_id")).alias("total"))
    rows = rows.withColumn("again", F.row_number().over(W.partitionBy("doc_id", "alias").orderBy("nth"))).filter(F.col("again") <= max_per_article)
    # the j-th alias stands at the j-th head of the article's coins, the j-th plain link at the j-th tail
    head = lambda toss: F.conv(F.substring(draw(seed + 1, "doc_id", toss.cast("string")), 1, 8), 16, 10).cast("double") / float(1 << 32) < alias_frac
    all_tosses = F.col("total").cast("int") * 2 + 16
    nth_toss = lambda upto: F.get(F.filter(F.sequence(F.lit(1), upto), lambda toss: head(toss) == F.col("alias")), (F.col("nth") - 1).cast("int"))
    # the first tosses nearly always suffice; all are tossed only where they don't
    rows = rows.withColumn("turn", F.coalesce(nth_toss(F.least(all_tosses, F.col("nth").cast("int") * 8 + 64)), nth_toss(all_tosses), F.col("nth") + (1 << 20)))
    once = rows.withColumn("again", F.row_number().over(W.partitionBy("doc_id", "gold").orderBy("turn", "place"))).filter("again = 1")
    once = once.withColumn("k", F.row_number().over(W.partitionBy("doc_id").orderBy("turn", "place"))).filter(F.col("k") <= max_per_article)
    once = cut_lineage(once.select(*key, "gold", "alias", "k").orderBy(draw(seed, "doc_id"), "doc_id", "k").limit(n))
    asked = once.select(*[F.col(c).alias(f"_{c}") for c in key]).distinct()
    found = links.join(F.broadcast(asked), reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]))  # n rows
    found = found.groupBy(*[f"_{c}" for c in key]).agg(F.min("text").alias("text"))
    once = once.join(found, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]))
    left = F.when(F.char_length("text") > crop, F.greatest(F.lit(0), F.least(F.col("start") - crop // 2, F.char_length("text") - crop))).otherwise(0)
    out = once.withColumn("cut", left).select(
        F.concat("doc_id", F.lit("#"), F.col("k") - 1).alias("id"), "doc_id", F.expr(f"substring(text, cut + 1, {crop})").alias("text"), F.col("anchor").alias("mention"),
        (F.col("start") - F.col("cut")).cast("int").alias("start"), (F.col("end") - F.col("cut")).cast("int").alias("end"), "gold", F.col("target").alias("target_title"), F.when(F.col("alias"), "alias").otherwise("title").alias("surface"), "k")
    return out.orderBy(draw(seed, "doc_id"), "doc_id", "k").drop("k")


def corpus_profile(rows: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """``measure, value`` of mention rows: sentences, mentions, shares, mean length, and the ten commonest types.

    With ``docs`` (``doc_id, text``), texts without mentions count too; else the texts of the rows stand for the corpus.
    Sentence and mention measures are two aggregates of one row each.
    """
    m = rows.agg(F.count("*").alias("mentions"), F.count_if(F.col("gold") == "NIL").alias("nil"), F.count_if(mention_script(F.col("mention")) != "arabic").alias("latin"), F.countDistinct("doc_id").alias("with_mentions"))
    texts = docs.filter(r"text RLIKE '\\S'") if docs is not None else rows.groupBy(doc_key(F.col("doc_id"), F.col("text")).alias("doc")).agg(F.min("text").alias("text"))
    s = texts.agg(F.count("*").alias("sentences"), F.count_if(~F.col("text").rlike(ARABIC)).alias("no_arabic"), F.coalesce(F.sum(F.char_length("text")), F.lit(0)).alias("chars"))
    types = rows.groupBy(F.coalesce("type", F.lit("None")).alias("t")).agg(F.count("*").alias("c"))
    return profile_measures(m.crossJoin(s), types, docs is not None)  # one row by one row


def profile_measures(one: DataFrame, types: DataFrame, per_sentence: bool) -> DataFrame:
    """``measure, value`` from one row of counters and from counts ``c`` by entity type ``t``."""
    n, k = F.greatest("sentences", F.lit(1)), F.greatest("mentions", F.lit(1))
    values = [("sentences", F.col("sentences").cast("double")), ("mentions", F.col("mentions").cast("double")), ("share of mentions labeled NIL", F.bround(F.col("nil") / k, 4)),
              ("share of mentions in Latin script", F.bround(F.col("latin") / k, 4)), ("share of sentences without Arabic script", F.bround(F.col("no_arabic") / n, 4)), ("mean sentence length (chars)", F.bround(F.col("chars") / n, 1))]
    if per_sentence:
        values.append(("mentions per sentence with mentions", F.bround(F.col("mentions") / F.greatest("with_mentions", F.lit(1)), 3)))
    head = one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("measure"), b.alias("value")) for a, b in values])))
    top = types.orderBy(F.desc("c"), "t").limit(10)
    return head.unionByName(top.crossJoin(one.select("mentions")).select(F.concat(F.lit("type "), "t").alias("measure"), F.bround(F.col("c") / F.col("mentions"), 4).alias("value")))


def coverage_check(sample: DataFrame, corpus: DataFrame) -> DataFrame:
    """How many documents of a sample are in a corpus by id, and how many of those with the same text."""
    rows = corpus.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("_other"))
    one = sample.select(F.col("doc_id").cast("string").alias("doc_id"), "text").dropDuplicates(["doc_id"])
    same = rows.join(one, "doc_id").groupBy("doc_id").agg(F.bool_or(F.col("_other") == F.col("text")).alias("same"))
    got = one.select("doc_id").join(same, "doc_id", "left").agg(F.count("*").alias("sampled"), F.count("same").alias("found"), F.count_if("same").alias("same_text"))
    return got.select("*", ratio("found", "sampled").alias("coverage"))


def split_by_doc(rows: DataFrame, dev_frac: float = 0.2, seed: int = 13) -> tuple[DataFrame, DataFrame]:
    """Development and test rows; all mentions of a document stay together. The former get ``max(1, int(n * dev_frac))`` documents.

    Documents are counted by the first hexadecimal digits of their hash (4,096 counts reach the driver); the digits in which
    the border lies are found there, and only the documents with those digits are ranked. All others are told by their hash.
    """
    rows = rows.withColumn("_key", doc_key(F.col("doc_id"), F.col("text")))
    keys = rows.select("_key").distinct().select("_key", draw(seed, "_key").alias("_draw")).withColumn("_head", F.substring("_draw", 1, 3))
    counts = sorted(map(tuple, keys.groupBy("_head").count().collect()))
    left, border = max(1, int(sum(n for _, n in counts) * dev_frac)), ""
    for border, n in counts:
        if n >= left:
            break
        left -= n
    first = keys.filter(F.col("_head") == border).orderBy("_draw", "_key").limit(left).select("_key", F.lit(True).alias("_dev"))
    rows = rows.join(first, "_key", "left").withColumn("_dev", F.coalesce("_dev", F.substring(draw(seed, "_key"), 1, 3) < border))
    return rows.filter("_dev").drop("_key", "_dev"), rows.filter("NOT _dev").drop("_key", "_dev")


def sample_by_doc(rows: DataFrame, n: int, max_per_doc: int = 5, linked_only: bool = False, seed: int = 13, order: str = "id") -> DataFrame:
    """``n`` mentions of random documents, at most ``max_per_doc`` of each."""
    rows = rows.filter("gold <> 'NIL'") if linked_only else rows
    rows = rows.withColumn("_key", doc_key(F.col("doc_id"), F.col("text")))
    rows = rows.withColumn("_nth", F.row_number().over(W.partitionBy("_key").orderBy(order))).filter(F.col("_nth") <= max_per_doc)
    return rows.orderBy(draw(seed, "_key"), "_key", "_nth").limit(n).drop("_key", "_nth")


def uniform_sample(df: DataFrame, k: int, key: str, seed: int = 13) -> DataFrame:
    """``k`` uniform rows: the smallest hashes of the key, a top-k that merges across partitions and over time."""
    return df.orderBy(draw(seed, key), key).limit(k)


def label_crosstab(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Per type: mentions, years, gold NIL, reviewed, unclear and wrong labels, and how many of the wrong ones are NIL or years."""
    found = rows.withColumn("id", F.col("id").cast("string")).join(labels, "id", "left")
    wrong = F.coalesce(~F.array_contains("accepted", F.col("gold")), F.lit(False))
    year = is_date_mention(F.lit(None).cast("string"), F.col("mention"))
    return found.groupBy(F.coalesce(norm_type(F.col("type")), F.lit("None")).alias("type")).agg(
        F.count("*").alias("mentions"), F.count_if(year).alias("years"), F.count_if(F.col("gold") == "NIL").alias("gold_nil"), F.count_if(F.col("accepted").isNotNull()).alias("reviewed"),
        F.count_if(F.coalesce("unclear", F.lit(False))).alias("unclear"), F.count_if(wrong).alias("wrong"), F.count_if(wrong & (F.col("gold") == "NIL")).alias("wrong_nil"), F.count_if(wrong & year).alias("wrong_years"))
