"""Names, answers and contexts as column expressions. Nothing here leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes of the matching rules, in regular expression syntax.
MARKS = r"[\x{0610}-\x{061A}\x{064B}-\x{065F}\x{0670}\x{06D6}-\x{06ED}\x{0640}]"
PUNCTUATION = r"""["'«»“”()\[\]{}<>\x{060C},.:;\x{061B}!?\x{061F}\-_/\\|]"""
LEFT_EDGE = r"""^["'«»“”(\[\s]+"""
RIGHT_EDGE = r"""["'«»“”)\]\s.,\x{060C}:;\x{061B}!?\x{061F}]+$"""
#: Any text without this is what :func:`strip_marks` and :func:`edge_trim` would leave of it: one look instead of five replacements.
UNTIDY = rf"""(?U){MARKS}|^["'«»“”(\[\s]|["'«»“”)\]\s.,\x{{060C}}:;\x{{061B}}!?\x{{061F}}]$"""
FOLD_FROM, FOLD_TO = "إأآٱىةؤئ", "اااايهوي"
ARTICLE = "ال"
ARABIC = r"[\x{0600}-\x{06FF}]"
YEAR = r"^\s*[0-9\x{0660}-\x{0669}]{4}\s*$"
# Entity types under their short names.
TYPES = {
    "PER": "PER", "PERS": "PER", "PERSON": "PER", "LOC": "LOC", "LOCATION": "LOC", "GPE": "GPE",
    "ORG": "ORG", "ORGANIZATION": "ORG", "ORGANISATION": "ORG", "FAC": "FAC", "FACILITY": "FAC", "EVENT": "EVENT", "EVT": "EVENT",
}
ANSWER = "struct<action: string, qid: string, query: string, lang: string, confidence: string, reason: string>"


def _strip(col: Column) -> Column:
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def strip_marks(col: Column) -> Column:
    return F.regexp_replace(F.coalesce(col, F.lit("")), MARKS, "")


def normalize_text(col: Column) -> Column:
    """For matching only: no marks, one form of each letter, punctuation and white space as single spaces, lower case."""
    plain = F.regexp_replace(F.translate(strip_marks(col), FOLD_FROM, FOLD_TO), PUNCTUATION, " ")
    return F.lower(_strip(F.regexp_replace(plain, r"(?U)\s+", " ")))


def name_tokens(col: Column) -> Column:
    """Normalised words, without a leading article in words of more than three letters."""
    words = F.filter(F.split(normalize_text(col), " "), lambda w: w != "")
    return F.transform(words, lambda w: F.when(F.startswith(w, F.lit(ARTICLE)) & (F.char_length(w) > 3), F.substring(w, 3, 1 << 30)).otherwise(w))


def token_key(col: Column) -> Column:
    """The tokens as one string, so that equality of names is an equality of keys; null for no tokens."""
    return F.nullif(F.array_join(name_tokens(col), " "), F.lit(""))


def edge_trim(col: Column) -> Column:
    return _strip(F.regexp_replace(F.regexp_replace(_strip(col), LEFT_EDGE, ""), RIGHT_EDGE, ""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def search_variants(col: Column) -> Column:
    """``primary`` and ``fallback`` query variants of a mention with attached particles."""
    tidy = F.when(col.rlike(UNTIDY), edge_trim(strip_marks(col))).otherwise(F.coalesce(col, F.lit("")))
    return let(tidy, lambda name: let(F.filter(F.split(name, r"(?U)\s+"), lambda w: w != ""), lambda words: _variants(name, words)))


def _variants(name: Column, words: Column) -> Column:
    n = F.char_length
    begins = lambda w, letters: F.substring(w, 1, 1).isin(*letters)

    def article(w: Column) -> Column:
        return F.when(F.startswith(w, F.lit("لل")) & (n(w) > 4), F.concat(F.lit(ARTICLE), F.substring(w, 3, 1 << 30))).when(
            (n(w) > 4) & begins(w, "بكف") & (F.substring(w, 2, 2) == ARTICLE), F.substring(w, 2, 1 << 30))

    def usable(a: Column) -> Column:
        return F.array_distinct(F.filter(a, lambda v: v.isNotNull() & (n(v) >= 2)))  # made of trimmed words, so nothing to strip

    def with_forms(forms: Column, rest: Column) -> Column:
        primary = usable(F.concat(F.array(name), F.transform(F.slice(forms, 2, 3), lambda w: F.concat(w, rest))))
        cut = F.filter(forms, lambda w: (n(w) > 3) & begins(w, "بلك") & ~F.startswith(w, F.lit(ARTICLE)) & ~F.startswith(w, F.lit("لل")))
        fallback = usable(F.transform(cut, lambda w: F.concat(F.substring(w, 2, 1 << 30), rest)))
        return F.struct(primary.alias("primary"), F.array_except(fallback, primary).alias("fallback"))

    first = F.get(words, 0)
    joined = F.when((n(first) > 3) & begins(first, "وف"), F.substring(first, 2, 1 << 30))
    plain = F.filter(F.array(first, joined), lambda w: w.isNotNull())
    forms = let(plain, lambda p: F.concat(p, F.filter(F.transform(p, article), lambda w: w.isNotNull())))
    rest = F.when(F.size(words) > 1, F.concat(F.lit(" "), F.array_join(F.slice(words, F.lit(2), F.size(words)), " "))).otherwise("")
    return let(F.struct(forms.alias("forms"), rest.alias("rest")), lambda x: with_forms(x["forms"], x["rest"]))


def all_variants(col: Column) -> Column:
    return let(search_variants(col), lambda found: F.concat(found["primary"], found["fallback"]))


def has_latin(col: Column) -> Column:
    return F.coalesce(col.rlike("[A-Za-z]"), F.lit(False))


def mention_script(col: Column) -> Column:
    """``latin``, ``arabic`` or ``mixed``; ``arabic`` where neither script occurs."""
    arabic = F.coalesce(col.rlike(ARABIC), F.lit(False))
    return F.when(has_latin(col) & arabic, "mixed").when(has_latin(col), "latin").otherwise("arabic")


def norm_gold(col: Column) -> Column:
    """The first item id in the value, else ``NIL``."""
    return F.coalesce(F.nullif(F.regexp_extract(col.cast("string"), r"(Q\p{Nd}+)", 1), F.lit("")), F.lit("NIL"))


def norm_type(col: Column) -> Column:
    """Upper-case type without a ``B-`` or ``I-`` mark, under its short name; unknown types stay, empty ones are null."""
    plain = F.regexp_replace(F.upper(_strip(col.cast("string"))), "^[BI]-", "")
    names = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    return F.when(col.cast("string") != "", F.coalesce(F.element_at(names, plain), plain))


def is_date_mention(kind: Column, mention: Column) -> Column:
    return F.coalesce(F.upper(kind).isin("DATE", "TIME"), F.lit(False)) | F.coalesce(mention.rlike(YEAR), F.lit(False))


def split_run_tag(col: Column) -> Column:
    """``config``, ``tag`` (null without one) and ``main``: no tag, or that of a repeat."""
    parts = F.split(col, "@", 2)
    tag = F.get(parts, 1)
    return F.struct(F.get(parts, 0).alias("config"), tag.alias("tag"), (tag.isNull() | tag.rlike(r"^r\p{Nd}+$")).alias("main"))


def answer_json(col: Column) -> Column:
    """The JSON object in a model's reply: thoughts and code fences dropped, else from the first ``{`` to the last ``}``."""
    text = _strip(F.regexp_replace(col, r"(?s)<think>.*?</think>", ""))
    text = F.regexp_replace(text, r"^```(?:json)?\s*|\s*```$", "")
    outer = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    good = lambda c: F.when(F.try_parse_json(c).isNotNull(), c)
    return F.coalesce(good(text), good(F.nullif(outer, F.lit(""))))


def parse_answer(col: Column) -> Column:
    """A reply as a decision; null where it holds no JSON. Unknown actions, and selections without an item, are ``invalid``."""
    return let(answer_json(col), lambda found: F.when(found.isNotNull(), let(F.from_json(found, ANSWER), _decision)))


def _decision(d: Column) -> Column:
    qid = F.upper(_strip(F.coalesce(d["qid"], F.lit(""))))
    qid = F.when(qid.rlike(r"^Q\p{Nd}+$"), qid).otherwise("")
    said = F.lower(_strip(F.coalesce(d["action"], F.lit(""))))
    said = F.when((said == "") & (qid != ""), "select").otherwise(said)
    action = F.when((said == "select") & (qid == ""), "invalid").when(said.isin("select", "nil", "search", "confirm"), said).otherwise("invalid")
    sure = F.coalesce(d["confidence"].try_cast("double"), F.lit(0.5))
    return F.struct(
        action.alias("action"), F.when(action == "select", qid).otherwise("").alias("qid"), F.coalesce(d["query"], F.lit("")).alias("query"),
        F.when(F.startswith(F.lower(F.coalesce(d["lang"], F.lit(""))), F.lit("en")), "en").otherwise("ar").alias("lang"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), sure)).alias("confidence"), F.substring(F.coalesce(d["reason"], F.lit("")), 1, 300).alias("reason"))


def doc_context(text: Column, mention: Column, start: Column, end: Column, chars: int = 350) -> Column:
    """The mention in brackets with ``chars`` characters on both sides, and an ellipsis at a cut end.

    Offsets count only if they hold the mention; else its first occurrence does, else the text's first ``2 * chars``.
    """
    right = F.coalesce(F.substring(text, start + 1, end - start) == mention, F.lit(False))
    s = F.when(right, start).otherwise(F.instr(text, mention) - 1)
    e = F.when(right, end).otherwise(s + F.char_length(mention))
    a, b = F.greatest(F.lit(0), s - chars), F.least(F.char_length(text), e + chars)
    part = lambda i, j: F.substring(text, i + 1, j - i)
    marked = F.concat(F.when(a > 0, "…").otherwise(""), part(a, s), F.lit("⟦"), part(s, e), F.lit("⟧"), part(e, b), F.when(b < F.char_length(text), "…").otherwise(""))
    return F.when(s < 0, F.substring(text, 1, 2 * chars)).otherwise(marked)


def text_sha1(col: Column) -> Column:
    return F.sha1(F.coalesce(col, F.lit("")))
