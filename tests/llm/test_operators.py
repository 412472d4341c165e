"""The training-data operators against brute force, on small tables with nulls, empty and repeated rows and clashing names."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from html import unescape

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from linkmill.llm import components, decontamination, html_text, language, line_dedup, packing, quality, simhash, substring_dedup, toxicity, url_filter
from linkmill.llm.common import cut_lineage
from linkmill.llm.components import connected_components
from linkmill.llm.html_pages import labelled_pages
from linkmill.llm.queries import vocabulary

WORDS = [f"w{i}" for i in range(40)]
LONG_LINE = "this shared line has clearly more than forty characters in it"


def corpus():
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(60)]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "A b\n\nC")]
    for i in range(10, 40):
        words = rng.choices(WORDS, k=rng.randint(5, 90))
        if i % 3 == 0:
            at = rng.randint(0, len(words))
            words[at:at] = passage[rng.randint(0, 20) : rng.randint(30, 60)]
        rows.append((i, " ".join(words) + "\n" + (f" {LONG_LINE.upper()} " if i % 4 == 0 else "short") + "\n" + LONG_LINE * (i % 5 == 0)))
    rows += [(50, rows[12][1]), (51, rows[12][1]), (51, rows[12][1]), (52, "wörd " * 500), (53, "x" * 5000), (60, "first text of an id"), (60, "second " + rows[15][1])]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string")
    clash = {c: F.lit("x") for c in ("row", "key", "fp", "score", "pos", "n_words", "kept", "lost", "length", "lang_", "h")}
    return df.withColumns(clash).repartition(5)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})


def test_line_dedup(docs, nothing):
    holders = defaultdict(set)
    for i, t in corpus():
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(i)
    want = []
    for i, t in corpus():
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders[key(x)]) < 5 or max(holders[key(x)]) == i]
        want.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    assert sorted(map(tuple, line_dedup.digest(line_dedup.line_dedup(docs)).collect())) == sorted(want)
    assert any(w[2] for w in want) and line_dedup.line_dedup(nothing).count() == 0
    dropped = line_dedup.drop_lines(docs)
    assert dropped.columns == docs.columns and dropped.count() == docs.count()
    odd = docs.withColumns({"a.b": F.lit(1), "n_chars": F.length("text")}).withColumnRenamed("text", "Text")
    again = line_dedup.drop_lines(odd)
    assert again.columns == odd.columns and again.schema.simpleString() == odd.schema.simpleString()
    texts = {r.doc_id: r.Text for r in again.collect()}
    assert texts[1] is None and texts[2] == "" and sorted(map(tuple, line_dedup.line_dedup(docs).select("doc_id", "kept_text").na.drop().collect())) == sorted((r.doc_id, r.Text or "") for r in again.collect())


def test_line_dedup_of_null_ids(spark):
    rows = [(None, LONG_LINE), (None, "x"), *((i, f"{i}\n{LONG_LINE}") for i in range(5)), (7, None)]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_dropped, r.kept_text) for r in got) == [
        (-1, 0, "x"), (-1, 1, ""), *((i, 1, str(i)) for i in range(4)), (4, 0, f"4\n{LONG_LINE}"), (7, 0, "")]


def test_substring_dedup(docs, nothing):
    order = sorted({(i, xxhash.xxh64_intdigest((t or "").encode(), 42) if t is not None else 42, t) for i, t in corpus()}, key=lambda x: (x[0], x[1] - (1 << 64) * (x[1] >> 63)))
    seen, want = set(), {}
    for i, _, t in order:
        words = (t or "").encode().split()
        lost, new = [False] * len(words), []
        for s in range(len(words) - 19):
            w = tuple(words[s : s + 20])
            if w in seen:
                lost[s : s + 20] = [True] * 20
            seen.add(w)
        want[i, t] = (i, len(words), sum(lost), hashlib.sha256(b" ".join(w for w, x in zip(words, lost, strict=True) if not x)).hexdigest())
        del new
    got = sorted(map(tuple, substring_dedup.digest(substring_dedup.substring_dedup(docs)).collect()))
    assert got == sorted(want[i, t] for i, t in corpus())
    assert sum(g[2] for g in got) > 100 and substring_dedup.substring_dedup(nothing).count() == 0


def test_difference_cover():
    assert all(any((i + d) % 13 in substring_dedup.COVER and (j + d) % 13 in substring_dedup.COVER for d in range(13)) for i in range(13) for j in range(13))


def test_packing(docs, nothing):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary())
    rows = packing.pack(docs, vocabulary(), size=64, with_ids=True).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, t in corpus():
        if i not in (51, 60):
            ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
            assert sum((r.ids for r in sorted(pieces[i], key=lambda r: r.start)), []) == ids
            assert {r.doc_tokens for r in pieces[i]} == {len(ids)}
    for s in sequences.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == [sum(x.length for x in s[:k]) for k in range(len(s))] and sum(r.length for r in s) <= 64
    assert packing.pack(nothing, vocabulary()).count() == 0


def test_tokens_are_those_of_whole_texts():
    from tokenizers import Tokenizer

    texts = ["Don't STOP!!! it's «x». foo». a<|endoftext|>b <|ENDOFTEXT|> İx. Σας! x²!! 10.000,5%", "naïve—word. 'tis. ABC'S. y　z", "日本語、テスト。ok!!", None]
    tokenizer, tokens = Tokenizer.from_file(vocabulary()), packing.Tokens(vocabulary())
    for t, ids in zip(texts, tokens.of(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(t or "", add_special_tokens=False).ids + [1]


def test_tokens_of_words_whose_lower_case_ends_in_a_mark():
    from tokenizers import Tokenizer

    texts = ["BELEDİYESİ, KAPADOKYA'DA.", "İ, İ! aİ?: İx, xİ1.", "İ"]
    tokenizer, tokens = Tokenizer.from_file(vocabulary()), packing.Tokens(vocabulary())
    for t, ids in zip(texts, tokens.of(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids + [1]


def test_tokens_of_all_letters_before_punctuation():
    from tokenizers import Tokenizer

    letters = [c for c in map(chr, range(0x110000)) if c.isalnum()]
    tokenizer, tokens = Tokenizer.from_file(vocabulary()), packing.Tokens(vocabulary())
    texts = [f"ab{x}. {x}, {x.upper()}!! cd{x}?" for x in letters] + ["T\u0308. J\u030c! y\u030a, <|endoftext|>. <a>T."]
    wrong = [t for at in range(0, len(texts), 5000) for t, ids in zip(texts[at : at + 5000], tokens.of(texts[at : at + 5000]), strict=True)
             if np.frombuffer(ids, "<u4").tolist() != tokenizer.encode(t, add_special_tokens=False).ids + [1]]
    assert not wrong


def test_frequent_words_stay_known_when_the_cache_is_full(monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 40)
    tokens, encoded = packing.Tokens(vocabulary()), Counter()
    encode = tokens.encode
    monkeypatch.setattr(tokens, "encode", lambda words: (encoded.update(words), encode(words)))
    letters = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿß"
    texts = [f"often {a}{b}. {b}{a}x!" for a in letters for b in letters[:9]]
    for t in texts:
        assert np.frombuffer(tokens.of([t])[0], "<u4").tolist() == tokens.tokenizer.encode(t, add_special_tokens=False).ids + [1]
        assert max(len(c) for half in (tokens.known, tokens.parts) for c in (half.new, half.old)) <= 40
    assert encoded[b"often"] == 1


def test_words_are_encoded_without_the_marks_around_them(monkeypatch):
    tokens, encoded = packing.Tokens(vocabulary()), Counter()
    encode = tokens.encode
    monkeypatch.setattr(tokens, "encode", lambda words: (encoded.update(words), encode(words)))
    text = "(often, often-Often ÉTÉ. 'été' STRAßE; straße7 often/été [été] T\u0344"
    assert np.frombuffer(tokens.of([text])[0], "<u4").tolist() == tokens.tokenizer.encode(text, add_special_tokens=False).ids + [1]
    assert {w.decode() for w in encoded if len(w) > 2} == {"often", "été", "straße", "'été", "T\u0344"} and max(encoded.values()) == 1


def test_tokens_of_random_characters():
    rng = np.random.default_rng(5)
    alphabet = [*"abstSTRVEDLM''.,-_=<>|!;~`09éÉßÞ÷×İŒœΣσ½²中々’ \n\t\u00a0\u0085\u0300\u0308\u0323\u0338\u0340\u0344\u0345\u037e", "'s", "'ll", "<|", "<|endoftext|>", "<|ENDOFTEXT|>", "  "]
    texts = ["".join(rng.choice(alphabet, n)) for n in rng.integers(0, 40, 20_000)]
    tokens = packing.Tokens(vocabulary())
    want = tokens.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert not [t for t, ids, w in zip(texts, tokens.of(texts), want, strict=True) if np.frombuffer(ids, "<u4").tolist() != w.ids + [1]]


def test_together_keeps_rows_whole_and_in_order(monkeypatch):
    monkeypatch.setattr(packing, "TOGETHER", 10)
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(["", "abcd", None, "efghijk", "x" * 50, "", "y"])], ["doc_id", "text"])
    parts = list(packing.together(batch))
    assert [p.column(0).to_pylist() for p in parts] == [[0, 1, 2], [3], [4], [5, 6]] and not list(packing.together(batch.slice(0, 0)))


@pytest.mark.parametrize("per_bucket", [3, 100_000])
def test_packing_of_repeated_rows_and_many_buckets(docs, per_bucket):
    rows = packing.pack(docs, vocabulary(), size=64, per_bucket=per_bucket).collect()
    taken = sorted((r.sequence_id, r.offset, r.length) for r in rows)
    for (s, at, n), (t, to, _) in zip(taken, taken[1:], strict=False):
        assert to == (at + n if s == t else 0) and s <= t <= s + 1
    tokens = packing.Tokens(vocabulary())
    want = defaultdict(int)
    for (i, _), ids in zip(corpus(), tokens.of([t for _, t in corpus()]), strict=True):
        for start, n in packing.cut(len(ids) // 4, 64):
            want[i, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), len(ids) // 4] += 1
    got = defaultdict(int)
    for r in rows:
        got[r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens] += 1
    assert got == want and max(want.values()) > 1


def test_histogram_packs():
    rng = np.random.default_rng(1)
    counts = np.append(0, rng.integers(0, 50, 256))
    packs = packing.pack_histogram(counts)
    placed = np.zeros_like(counts)
    for n, lengths in packs:
        assert sum(lengths) <= 256
        for x in lengths:
            placed[x] += n
    assert (placed == counts).all()
    assert sum(n for n, _ in packs) <= 1.03 * (counts * np.arange(257)).sum() / 256 + 1


def test_simhash(docs, nothing):
    def print_of(t):
        w = key_words(t)
        shingles = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0

    def key_words(t):
        return (t or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()

    rows = [(i, print_of(t)) for i, t in corpus()]
    got = sorted(map(tuple, simhash.digest(simhash.simhash_groups(docs)).collect()))
    assert [(i, f) for i, f, _ in got] == sorted((i, f"{p:016x}") for i, p in rows)
    part = {i: i for i, _ in rows}
    for _ in rows:
        for a, p in rows:
            for b, q in rows:
                if (p ^ q).bit_count() <= 4:
                    part[a] = part[b] = min(part[a], part[b])
    assert all(c == part[i] for i, _, c in got if i != 60)
    assert simhash.simhash_groups(nothing).count() == 0


@pytest.mark.parametrize("hot, leaders", [(64, 16), (2, 1), (5, 3)])
def test_joining_links_connect_what_all_links_connect(spark, hot, leaders):
    rng = random.Random(6)
    prints = {rng.getrandbits(64) for _ in range(40)}
    for p in list(prints)[:5]:  # chains and dense groups
        for _ in range(60):
            q = rng.choice([x for x in prints if (x ^ p).bit_count() < 9])
            prints.add(q ^ sum(1 << b for b in rng.sample(range(40), rng.randint(1, 4))))
    signed = [p - (1 << 64) * (p >> 63) for p in prints]
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 4}
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    got = {tuple(r) for r in simhash.joining_links(df, hot=hot, leaders=leaders).collect()}
    part = lambda edges: dict(map(tuple, connected_components(spark.createDataFrame(sorted(edges), "u long, v long")).collect()))
    assert got <= want and part(got) == part(want) and len(want) > 500


def test_simhash_of_repeated_and_null_ids(spark):
    text = " ".join(WORDS)
    rows = [(9, text), (9, "other words entirely " * 9), (9, text), (None, text), (4, text), (None, "alone " + " ".join(reversed(WORDS)))]
    got = sorted(map(tuple, simhash.simhash_groups(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component_id").collect()), key=str)
    assert got == sorted([(9, 4), (9, 9), (9, 4), (None, 4), (4, 4), (None, None)], key=str)


@pytest.mark.parametrize("hot", [512, 2])
def test_links_are_all_found_once(spark, hot):
    rng = random.Random(5)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for p in list(prints)[:40]:
        for n in range(1, 7):
            prints.add(p ^ sum(1 << b for b in rng.sample(range(64), n)))
    prints |= {0, 1, (1 << 64) - 1}
    signed = [p - (1 << 64) * (p >> 63) for p in prints]
    got = [tuple(r) for r in simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), hot=hot).collect()]
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 4}
    assert len(got) == len(set(got)) and set(got) == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, 50), (50, 70)] + [(200, 200 + i) for i in range(1, 9)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert {got[i] for i in range(31)} == {0} and got[100] == got[70] == 50 and got[208] == 200 and 999 not in got
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_components_end_with_stars(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(components, "cut_lineage", lambda df: (rounds.append(1), cut_lineage(df))[1])
    for edges, most in (([(1, i) for i in range(2, 40)] + [(50, 60)], 1), ([(1, 5), (2, 5), (2, 6)], 2)):
        rounds.clear()
        got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "u long, v long")).collect()))
        assert got == {n: 50 if n > 49 else 1 for e in edges for n in e} and len(rounds) <= 1 + most


ITEM = "The quick brown fox jumps over the lazy dog while seven wizards quietly boil forty purple turnips"


def least_distance(item, text):
    """Of the item to any part of the text, by dynamic programming."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_myers_and_pieces():
    rng = random.Random(2)
    items = [(k, decontamination.normalise(" ".join(rng.choices(WORDS, k=20)))) for k in range(8)]
    matcher = decontamination.Matcher(items, 0.08)
    for _ in range(60):
        k, item = rng.choice(items)
        chars = list(item.strip())
        for _ in range(rng.randint(0, 7)):
            at = rng.randrange(len(chars))
            chars[at : at + rng.randint(0, 1)] = rng.choice(["", "z", "qq"])
        text = decontamination.normalise("before it " + "".join(chars) + " and after")
        got = {i: d for i, d, _ in matcher.find(text)}
        for i, t in items:
            d = least_distance(t, text)
            assert got.get(i) == (d if d <= decontamination.budget(len(t), 0.08) else None)


def test_contamination(spark, docs, nothing):
    bench = spark.createDataFrame([(1, ITEM), (2, "short item here"), (3, None), (4, " !! ")], "item_id long, text string")
    rows = [(1, "x " * 50 + ITEM.upper() + " y"), (2, "***" + ITEM.replace(" ", "\n* ").replace("seven", "sevn") + "?"), (3, "about a short item here, yes"), (4, "a short itm here"), (5, None), (6, ITEM[: len(ITEM) // 2])]
    rows += [(7, "word " * 50_000 + ITEM), (3, "about a short item here, yes"), (3, "nothing of it")]
    got = decontamination.contamination(spark.createDataFrame(rows, "doc_id long, text string"), bench)
    # the rate alone sets the budget: one edit of the 17 characters of item 2
    assert {(r.doc_id, r.item_id): r.distance for r in got.collect()} == {(1, 1): 0, (2, 1): 1, (3, 2): 0, (4, 2): 1, (7, 1): 0}
    assert got.filter("doc_id = 3").count() == 2 and got.filter("doc_id = 3").select("key").distinct().count() == 1
    small = decontamination.contamination(spark.createDataFrame(rows, "doc_id long, text string"), bench, block=20)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, got.collect()))
    assert decontamination.contamination(docs, bench.limit(0)).count() == decontamination.contamination(nothing, bench).count() == 0


@pytest.fixture(scope="module")
def field():
    return html_text.train(250)


def test_html_text(spark, field):
    right = total = 0
    for html, labels in labelled_pages(80, seed=77):
        page = html_text.blocks(html)
        if len(page) == len(labels):
            right += sum(a == b for a, (_, b) in zip(field.decode(page), labels, strict=True))
            total += len(labels)
    assert total > 1000 and right / total > 0.97
    html = """<html><head><title>t</title></head><body><!-- <p>no</p> --><nav><ul><li><a href=/>Home</a></ul></nav><article><h1>A &amp; b</h1><p>One <b>two</b>
      three.<p>Four<br>five &lt;six&gt;.</article><script>var t="</p>";</script><div class="comments"><p>First!</p></div><footer>&copy; me</footer>"""
    rows = spark.createDataFrame([(1, "u", html), (2, None, None), (3, "u", ""), (1, "u", html)], "page_id long, url string, html string").withColumn("text", F.lit(1))
    got = [(r.page_id, r.text, r.n_chars) for r in html_text.html_text(rows, field).orderBy("page_id").collect()]
    text = "A & b\nOne two three.\nFour five <six>."
    assert got == [(1, text, len(text)), (1, text, len(text)), (2, "", 0), (3, "", 0)]
    assert html_text.html_text(rows.limit(0), field).count() == 0


def test_viterbi_is_the_best_of_all_chains(field):
    from itertools import product

    html, _ = labelled_pages(3, seed=9)[2]
    page = html_text.blocks(html)[:9]
    gains = field.gains(page)

    def value(states):
        return field.ends[states[0]] + sum(g for g, s in zip(gains, states, strict=True) if s) + sum(field.pairs[a][b] for a, b in zip(states, states[1:], strict=False))

    best = max(product((0, 1), repeat=len(page)), key=value)
    assert value(tuple(map(int, field.decode(page)))) == pytest.approx(value(best))


def test_blocks_match_their_labels():
    same = sum([b[0] for b in html_text.blocks(h)] == [unescape(t) for t, _ in y] for h, y in labelled_pages(100, seed=4))
    assert same > 85


def test_unclosed_elements_lose_no_text():
    said = lambda html: [t for t, *_ in html_text.blocks(html)]
    assert said("<p hidden>x<p>Real text.<div>More</div>") == ["Real text.", "More"]
    assert said('<p style="display:none">x<p>Body one.') == ["Body one."]
    assert said("<article><select><option>a<option>b<p>one</p></article><p>two") == ["one", "two"]
    assert said("<div><svg><path d='x'><text>no</text></div><p>yes") == said("<svg><circle/><p>yes</p>") == ["yes"]
    assert said("<table><tr><td hidden>x<td>y<tr><td>z</table>") == ["y", "z"]
    assert said("<noscript><p>x</noscript><p>y<template><div>x</div></template>z<script>a<p>b</script>c") == ["y", "z", "c"]
    assert said("<head><title>t</title><p>no body tag") == ["no body tag"] and said("a<script>b<p>c") == ["a"]


# Pages by hand, not from the generator: html and the article's text.
PAGES = (
    ("<html><body><div id=nav><a href=/>Home</a> <a href=/b>Blog</a></div><div id=content><h1>Bread</h1><p>Mix flour and water. Let it rest for an hour before you bake it.</p></div></body></html>",
     "Bread\nMix flour and water. Let it rest for an hour before you bake it."),
    ("<body><header><a href=/>Daily</a></header><main><article><h2>Rain</h2><p>It rained all week in the north, and the rivers rose.<p>Farmers were glad of it, as the spring had been dry.</article></main><footer>© 2020 Daily</footer>",
     "Rain\nIt rained all week in the north, and the rivers rose.\nFarmers were glad of it, as the spring had been dry."),
    ("<body><div class=cookie-banner>We use cookies. <button>OK</button></div><article class=post><p>The bridge was opened in 1932 after seven years of work.</p><blockquote>It is a fine bridge, said the mayor.</blockquote></article><div class=comments><p>Nice!</p></div>",
     "The bridge was opened in 1932 after seven years of work.\nIt is a fine bridge, said the mayor."),
    ("<body><nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav><section class=entry-content><h1>Bees &amp; wasps</h1><p>Bees eat pollen.\n   Wasps eat other insects, and fruit.</p><ul><li>Bees are furry animals.</li><li>Wasps are smooth ones.</li></ul></section><aside class=sidebar><h3>Popular</h3><a href=3>Ants</a></aside>",
     "Bees & wasps\nBees eat pollen. Wasps eat other insects, and fruit.\nBees are furry animals.\nWasps are smooth ones."),
    ("<body><form class=search><label>Search</label><input></form><div class=article-body><p>She walked home slowly that night, thinking of the sea.</p><div class=ad>Buy now!</div><p>In the morning the boat was gone.</p></div><div class=footer>Terms</div>",
     "She walked home slowly that night, thinking of the sea.\nIn the morning the boat was gone."),
    ("<body><div class=share><a href=x>Share</a><a href=y>Tweet</a></div><main><p>Salt keeps food from rotting, which was known long ago.</p></main><div class=newsletter><p>Sign up for our letter.</p></div>",
     "Salt keeps food from rotting, which was known long ago."),
)


def test_pages_outside_the_generator():
    field = html_text.train()
    got = [html_text.main_text(html, field) for html, _ in PAGES]
    assert got == [text for _, text in PAGES]


def test_html_of_a_very_long_page(field):
    html = "<article>" + "<p>One more line of this long text, which goes on and on.</p>" * 20_000 + "</article><footer>© me</footer>"
    assert html_text.main_text(html, field).count("\n") == 19_999


def test_rank_crosses_hosts(spark):
    link = lambda to: f'<p><a class="x" href="https://{to}/1">x</a>'
    rows = [(1, "http://bad.com/de/1", None), (2, "http://one.net/", link("bad.com")), (3, "http://two.net/", link("one.net")), (4, "http://three.net/", link("two.net")),
            (5, "http://far.net/", '<link rel=stylesheet href="//bad.com/x"><a data-href="//bad.com/y">'), (6, "http://both.net/", link("bad.com") + link("good.org")), (7, "http://good.org/", link("both.net"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.verdict for r in url_filter.url_filter(df).collect()} == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "allow", 7: "allow"}
    name, verdict = url_filter.rule_of(F.lit("a.b"), F.lit("/x"), (("allow", "a.b", "/"), ("block", "a.b", "/")))
    assert tuple(spark.range(1).select(name, verdict).first()) == ("a.b/", "block")


def test_url_filter(spark):
    rows = [(1, "http://a.org/x", None), (2, "https://m.example.org/es/1?q", None), (3, "http://example.org/en/12#t", ""), (4, "http://example.org/en/2", None), (5, "http://a.com/de/1", '<a href="http://b.net/">'),
            (6, "http://b.net/1", '<a href="http://a.com/de/1">x'), (7, None, None), (8, "no scheme", None), (9, "HTTP://C.NET?x", None), (10, "http://notorg/x", None), (11, "http://a.com/de/1", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit(1), "kind": F.lit(2)})
    got = {r.page_id: tuple(r)[1:] for r in url_filter.url_filter(df).collect()}
    assert got[1] == ("a.org", "/x", "org/", "allow") and got[2][2:] == ("example.org/es/", "block") and got[3][2:] == ("example.org/en/1", "block") and got[4][2:] == ("org/", "allow")
    assert got[5][2:] == ("com/de/", "block") and got[6] == ("b.net", "/1", None, "block")
    assert got[7] == got[8] == ("", "", None, "allow") and got[9] == ("c.net", "", None, "allow") and got[10][2:] == (None, "allow")
    assert url_filter.url_filter(df.limit(0)).count() == 0


def test_quality_counts():
    t = quality.Text("a b\na b\n\na b\n#1 $2 wörd")
    assert quality.counts(t) == (9, 14, 2, 2, 0)
    eight = " ".join("abcdefgh")
    assert quality.counts(quality.Text(f"{eight} x {eight} y"))[4] == 16
    assert quality.counts(quality.Text(None)) == (0, 0, 0, 0, 0)


def brute_counts(text):
    words = (text or "").encode().split()
    windows = defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i : i + 8])].append(i)
    again = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(again)


def test_quality_counts_against_brute_force(spark, docs):
    rng = random.Random(12)
    rows = corpus() + [(70 + i, "\n".join(" ".join(rng.choices(["a", "#b", "wörd", "<c>"], k=rng.randint(0, 30))) for _ in range(rng.randint(1, 8)))) for i in range(30)]
    rows += [(200, " ".join(rng.choices(WORDS, k=300_000)))]  # longer than a part
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"kept": F.lit("x"), "quality": F.lit(2), "a.b": F.lit(0)})
    got = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.quality_rules(df, df.select("doc_id", F.lit(None).alias("quality"))).collect())
    want = [(i, *brute_counts(t)) for i, t in rows]
    assert got == sorted((*w, w[1] < 20 or 100 * w[5] > 30 * w[1]) for w in want)


def test_features_of_long_texts_do_not_depend_on_parts(monkeypatch):
    from linkmill.llm import learning

    text = "Ein längerer Text, der öfter geteilt wird. " * 40
    model = quality.Model(np.random.default_rng(1).normal(size=quality.FAMILIES << quality.BITS).astype(np.float32), 0.1)
    want = quality.shares(quality.Text(text)), model.probability(quality.Text(text)), language.shares(text)
    monkeypatch.setattr(learning, "CHUNK", 64)
    got = quality.shares(quality.Text(text)), model.probability(quality.Text(text)), language.shares(text)
    for a, b in ((want[0], got[0]), (want[2], got[2])):
        assert (a[0] == b[0]).all() and np.allclose(a[1], b[1])
    assert want[1] == pytest.approx(got[1])


def test_samples_are_bounded_and_hold_both_classes(spark):
    from linkmill.llm import learning

    rows = [(1, f"text {i}") for i in range(300)] + [(i, f"word {i}") for i in range(2, 60)] + [(None, "x"), (70, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = [(1, 0)] * 300 + [(i, i % 2) for i in range(2, 60)] + [(1000 + i, 1) for i in range(400)] + [(None, 1), (5, None), (70, 1)]
    labels = spark.createDataFrame(labels, "doc_id long, y int")
    for cap in (20, 100):
        got = [tuple(r) for r in learning.sample(docs, labels, "y", cap).select("doc_id", "y", "text").collect()]
        n = [sum(y == k for _, y, _ in got) for k in (0, 1)]
        assert n == [min(cap, 30), min(cap, 29)] and len({i for i, *_ in got}) == len(got)
    assert [t for i, _, t in got if i == 1] == [min((t for i, t in rows if i == 1), key=lambda t: (xxhash.xxh64_intdigest(t.encode(), 42) + (1 << 63)) % (1 << 64))]
    assert learning.sample(docs, labels.limit(0), "y", 5).count() == learning.sample(docs.limit(0), labels, "y", 5).count() == 0


def labelled(spark, n=240):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        bad = i % 3 == 0
        words = rng.choices(WORDS, k=60)
        if bad:
            words[5] = rng.choice(["idiot", "moron", "scumbag"])
            words[30] = rng.choice(["idiot", "moron", "scumbag"])
            words = [w + "###" if rng.random() < 0.5 else w for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, int(not bad), int(bad)))
    rows += [(1000, "an idxiot and a m-oron, really scumbbag " + " ".join(WORDS)), (1001, " ".join(WORDS)), (1002, None), (1003, "")]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (5000, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")


def test_quality_rules(spark):
    docs, labels = labelled(spark)
    got = {r.doc_id: r for r in quality.quality_rules(docs, labels).collect()}
    right = [got[i].kept == (i % 3 > 0) for i in range(240)]
    assert sum(right) > 230 and got[1002].base_failed and not got[1003].kept and got[1001].kept
    assert quality.quality_rules(docs.limit(0), labels).count() == 0
    alone = quality.quality_rules(docs, labels.limit(0)).collect()
    assert all(r.kept != r.base_failed and r.quality is None for r in alone)


def test_toxicity(spark):
    docs, labels = labelled(spark)
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    held = [i for i in range(240) if got[i].held_out]
    assert len(held) > 20 and all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert sum(got[i].predicted == (i % 3 == 0) for i in held) / len(held) > 0.95
    assert got[1000].predicted == 1 and got[1001].predicted == 0 and 0 <= got[1002].score == got[1003].score < 0.5
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    assert {round(r.score, 6) for r in toxicity.toxicity(docs, labels.filter("toxic = 0")).collect()} and toxicity.toxicity(docs, labels.limit(0)).count() == docs.count()


def test_kernel_against_enumeration(monkeypatch):
    from itertools import combinations

    def vector(word):
        word, out = "\x02" + word + "\x03", defaultdict(float)
        for at in combinations(range(len(word)), 3):
            out[tuple(word[i] for i in at)] += toxicity.DECAY ** (at[2] - at[0] + 1)
        norm = sum(v * v for v in out.values()) ** 0.5
        return {k: v / norm for k, v in out.items()}

    words = ["idiot", "idxiot", "a", "ab", "banana", "i1d1i1o1t", "straßenbahn", "", "moron" * 30, "abcdefghijklmnopqrstu"]
    vectors = [vector(w) for w in words]
    want = np.array([[sum(v * b.get(k, 0) for k, v in a.items()) for b in vectors] for a in vectors])
    for short in (20, 3, 200):  # written out, or summed letter by letter: the same
        monkeypatch.setattr(toxicity, "SHORT", min(short, 20))
        flat = toxicity.dense(words if short < 200 else [w[:20] for w in words])
        if short < 200:
            assert np.abs(flat[:7] @ flat.T - want[:7])[:, [k for k in range(10) if k != 7]].max() < 1e-5


def test_toxicity_of_long_texts_and_clashing_columns(spark):
    docs, labels = labelled(spark)
    rows = docs.unionByName(spark.createDataFrame([(2000, "w1 " * 200_000 + "idiot moron"), (2001, "x" * 700_000), (3, "a second text"), (None, "idiot")], "doc_id long, text string"))
    rows = rows.withColumns({"held_out": F.lit(1), "a.b": F.lit(2), "toxic": F.lit(1)})
    got = toxicity.toxicity(rows, labels.withColumn("text", F.lit("x"))).collect()
    assert len(got) == rows.count() and {r.predicted for r in got if r.doc_id == 2001} == {0} and all(0 <= r.score <= 1 for r in got)


def test_kernel_tolerates_insertions():
    marks = toxicity.dense(["idiot"])
    near, gap, far = toxicity.kernel(["idiots", "idxiot", "banana"], marks)[:, 0]
    assert near > 0.6 and gap > 0.4 and far < 0.2
    assert toxicity.kernel(["idiot"], marks)[0, 0] == pytest.approx(1)
    for text in ("I D I O T", "i-d-i-o-t", "i--d--i--o--t", "iiddiioott", "id*iot", "IDIIIIOT"):
        assert toxicity.units(f"He is an {text}! no") == ["he", "is", "an", "idiot", "no"]
    assert toxicity.units("book -- 'x y' moon") == ["book", "moon"][:1] + ["moon"] and toxicity.units(None) == []


@pytest.fixture(scope="module")
def given(spark):
    from linkmill.llm.common import in_fold

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels.filter(~in_fold(5, 0)))
    held = docs.join(labels, "doc_id").filter(in_fold(5, 0)).select("text", "toxic").toPandas()
    return model, held


def test_toxicity_of_held_out_documents(given):
    model, held = given
    said = model.scores(held.text.tolist()) >= 0.5
    assert said[held.toxic == 1].mean() > 0.9 and said[held.toxic == 0].mean() < 0.01


def test_insults_with_inserted_characters(given):
    """Three insults put into clean texts, damaged or not."""
    model, held = given
    rng = random.Random(1)
    clean = [t for t, y in zip(held.text, held.toxic, strict=True) if not y and t and len(t) > 200][:200]
    insults = "stupid disgusting idiot trash clown pathetic worthless scum moron loser".split()

    def put(w, letter):
        k = rng.randint(1, len(w) - 1)
        return w[:k] + letter + w[k:]

    ways = {
        "plain": lambda w: w, "mark after the second": lambda w: w[:2] + "-" + w[2:], "marks": "-".join, "two marks": "--".join, "spelled": " ".join,
        "doubled": lambda w: "".join(2 * c for c in w), "letter": lambda w: put(w, rng.choice("abcdefghijklmnopqrstuvwxyz")), "digit": lambda w: put(w, "7")}
    share = {name: (model.scores([f"{t} " + " . ".join(way(w) for w in rng.sample(insults, 3)) for t in clean]) >= 0.5).mean() for name, way in ways.items()}
    assert (model.scores(clean) >= 0.5).mean() <= 0.01 and share["plain"] > 0.8
    assert all(x >= 0.9 * share["plain"] for x in share.values()), share


@pytest.mark.parametrize("text", ["text", "Text", "TEXT"])
def test_drop_toxic_with_odd_columns(spark, text):
    docs, labels = labelled(spark)
    odd = docs.withColumns({"a.b": F.lit(1), "score": F.lit(2), "c0": F.lit("x"), "Score_": F.lit(3)}).withColumnRenamed("text", text)
    odd = odd.unionByName(odd.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    model = toxicity.fit(odd, labels)
    got = toxicity.score(odd, model, "my.score", text)
    assert got.columns == [*odd.columns, "my.score"] and got.count() == odd.count() and toxicity.score(odd.limit(0), model).count() == 0


def test_language_id(spark):
    rng = random.Random(4)
    sounds = {"xx": "ba ko mi tu".split(), "yy": "sch ung er ein".split()}
    rows = [(i, " ".join("".join(rng.choices(sounds[x], k=3)) for _ in range(rng.randint(2, 40))), x) for i in range(150) for x in [("xx", "yy")[i % 2]]]
    rows += [(900, None, "xx"), (901, "12 !!", "xx"), (902, "", None), (903, "bakomi", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"score": F.lit(1), "_text": F.lit(2)})
    got = {r.doc_id: r for r in language.language_id(df).collect()}
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    held = [i for i in range(150) if got[i].held_out]
    assert sum(got[i].lang_pred == ("xx", "yy")[i % 2] for i in held) / len(held) > 0.97
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and got[903].lang_pred == "xx" and 0 <= got[903].score <= 1
    assert language.language_id(df.limit(0)).count() == 0
    assert {r.lang_pred for r in language.language_id(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_only_hidden_elements_are_left_out():
    said = lambda html: [t for t, *_ in html_text.blocks(html)]
    assert said('<div class="content hidden md:block"><p>a</p></div><p data-note="a hidden gem, display:none">b</p>') == ["a", "b"]
    assert said("<div><p hidden>x<p>a</div><p>b") == ["a", "b"]
    assert said("<div><div hidden>x<div>y</div>z</div>a</div><p>b <span style='display: none'>x</span>c</p><ul><li hidden>x<li>d</ul>") == ["a", "b c", "d"]
