"""The ten operators against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import base64
import hashlib
import io
import math
import random
import re
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import op1_ngram_join, op2_tokens, op3_quality, op5_urls, op6_mixing, op7_chat, op8_decontamination, op9_sharding, op10_warc
from tidemark.llm.op4_html import extract_text, main_text

GAP = re.compile(r"[\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string, size int, _text string"


def lower(text):
    return (text or "").encode().lower().decode()


def words(text):
    return [w for w in GAP.split(text or "") if w]


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def documents(spark, texts):
    """Rows with columns that clash with names used inside the operators."""
    return spark.createDataFrame([(i, t, None if i % 7 == 3 else f"s{i % 4}", 5, "x") for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    base = [prose(rng, n) for n in (40, 60, 90, 30, 25)]
    near = []
    for t in base:
        for _ in range(6):
            w = t.split()
            for _ in range(rng.randrange(3)):
                w[rng.randrange(len(w))] = f"new{rng.randrange(1000)}"
            near.append(" ".join(w))
    return [*base, *near, None, "", " \n\t", "one two", "ONE  two", "one two three", base[0].upper(), base[0], prose(rng, 30_000, 9_000), *[prose(rng, 50) for _ in range(20)]]


def shingles(text):
    w = words(lower(text))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_op1_components(spark, texts):
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both) and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    got = op1_ngram_join.similar_components(documents(spark, texts))
    assert got.columns == ["doc_id", "text", "source", "size", "_text", "n_shingles", "component_id"]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == {i: (len(s), root[i]) for i, s in enumerate(sets)}


def test_op1_in_blocks(spark, texts, monkeypatch):
    """Lists, groups and documents of more partners than a block, here of two, are split without loss."""
    want = {(r.doc_id, r.component_id) for r in op1_ngram_join.similar_components(documents(spark, texts)).collect()}
    monkeypatch.setattr(op1_ngram_join, "BLOCK", 2)
    rng = random.Random(9)
    lead = prose(rng, 30, 90)
    family = [lead + " " + prose(rng, 12, 30) for _ in range(25)]  # one prefix, many sets, some of them similar
    assert want == {(r.doc_id, r.component_id) for r in op1_ngram_join.similar_components(documents(spark, texts)).collect()}
    got = {r.doc_id: r.component_id for r in op1_ngram_join.similar_components(documents(spark, [*family, *family[:3]])).collect()}
    sets = [shingles(t) for t in [*family, *family[:3]]]
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    assert got == dict(enumerate(root))


def test_op1_ids_missing_or_repeated_and_empty_table(spark):
    long = " ".join(f"a{i}" for i in range(20))
    df = spark.createDataFrame([(5, long), (5, "x y z q r s t u"), (9, "x y z q r s t u"), (None, long), (None, "else where")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.text[:4], r.component_id) for r in op1_ngram_join.similar_components(df).collect())
    assert got == sorted([("5", "a0 a", 5), ("5", "x y ", 5), ("9", "x y ", 5), ("None", "a0 a", 5), ("None", "else", None)])
    assert op1_ngram_join.similar_components(df.limit(0)).count() == 0


def test_op2_counts_like_the_library(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    rng = random.Random(1)
    signs = [*map(chr, range(0x260)), "'s", "'LL", "<|endoftext|>", "<|", " ", "\n", "the", "ing", "中", "İ", "é", "ﬁ"]
    foreign = ["“", "”", "’", "—", "…", "\u2003", "\u3000", "\u0301", "\u0323", "\u200d", "中文", "日本", "한", "\u1112\u1161", "Σ", "Σς", "ſ", "K", "İ", "\U0001f600", "ﬀ", "x\u0301", "don’t", "it's"]
    rows = [*texts, *("".join(rng.choice(signs[:300:9] + foreign + ["the", "It’s", " ", "\n", "<|endoftext|>"]) for _ in range(60)) for _ in range(2_000))]
    rows += ["“Quoted text” — it’s said, isn’t it… " * 300, "中文分词没有空格" * 500, *("".join(rng.choice(signs) for _ in range(80)) for _ in range(500)), "it's <|endoftext|>'t", "x" * 20_000]
    rows += rows[-5:]
    assert op2_tokens.count_tokens(documents(spark, rows).limit(0), path).count() == 0
    got = {r.doc_id: r for r in op2_tokens.count_tokens(documents(spark, rows), path).collect()}
    library = Tokenizer.from_file(path)
    for i, t in enumerate(rows):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 2048), repr(t)[:100]


def buckets(text):
    """Buckets of all tokens and pairs of neighbours: a pair's hash goes on from its first token's."""
    import xxhash

    tokens = [t.encode() for t in re.findall(op3_quality.TOKEN, text or "")]
    signed = lambda h: h - (1 << 64) if h >= 1 << 63 else h
    one = [xxhash.xxh64_intdigest(t, 42) for t in tokens]
    two = [xxhash.xxh64_intdigest(b, h) for h, b in zip(one, tokens[1:])]
    return [signed(h) % op3_quality.BUCKETS for h in one + two]


def llr_weights(texts, trusted):
    every, good = Counter(), Counter()
    for i, t in enumerate(texts):
        b = buckets(t)
        every.update(b)
        if i in trusted:
            good.update(b)
    n, m = sum(every.values()) + op3_quality.BUCKETS, sum(good.values()) + op3_quality.BUCKETS
    return [math.log((good[k] + 1) / m) - math.log((every[k] + 1) / n) for k in range(op3_quality.BUCKETS)]


def test_op3_base_rules_and_verdict(spark, texts):
    rng = random.Random(5)
    good = [prose(rng, 80) for _ in range(60)]
    bad = [" ".join(w + rng.choice(("%%%", "&&&", "###")) for w in prose(rng, 80).split()) for _ in range(20)]
    repeats = [" ".join(["again"] * 40), "a b c d e f g h " * 5 + prose(rng, 30), "line one\nline one\n\nline two\nline one " + prose(rng, 30)]
    rows = [*good, *bad, *repeats, *texts]
    trusted = spark.createDataFrame([(i,) for i in range(30)], "doc_id long")
    got = {r.doc_id: r for r in op3_quality.judge(documents(spark, rows), trusted).collect()}
    for i, t in enumerate(rows):
        w = words(t)
        spans = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        many = Counter(spans)
        repeated = {k + j for k, s in enumerate(spans) if many[s] > 1 for j in range(8)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(repeated))
        assert tuple(got[i][c] for c in op3_quality.RESULTS[:5]) == want, repr(t)[:80]
        assert got[i].base_failed == (len(w) < 20 or 100 * len(repeated) > 30 * len(w))
    assert all(got[i].kept for i in range(60)) and not any(got[i].kept for i in range(60, 80))
    weights = llr_weights(rows, range(30))
    for i, t in enumerate(rows):
        b = buckets(t)
        score = sum(weights[x] for x in b) / len(b) if b else 0.0
        assert got[i].score == pytest.approx(score, abs=1e-9)
        assert got[i].kept == (not got[i].base_failed and score >= op3_quality.LEAST_SCORE)
    again = op3_quality.judge(documents(spark, [*rows, *rows[:5]]), trusted).collect()
    assert len(again) == len(rows) + 5 and all(len({(r.kept, r.score) for r in again if r.text == t}) == 1 for t in rows[:5])
    unlabelled = op3_quality.judge(documents(spark, rows), trusted.limit(0)).collect()
    assert all(r.kept == (not r.base_failed) and r.score == 0 for r in unlabelled)
    assert op3_quality.judge(documents(spark, ["x"]).limit(0), trusted).count() == 0


def test_op8_common_phrase(spark):
    """One phrase over and over in 50 items and in one long document: the places grow with the text, and not with their product."""
    phrase = "all rights reserved by the owner of this page and no one else ".split()
    items = [(i, " ".join(phrase * 15 + [f"item{i}"] * 5)) for i in range(50)]
    took = []
    for n in (2_500, 20_000):
        began = time.time()
        (row,) = op8_decontamination.decontaminate(spark.createDataFrame([(1, " ".join(phrase * (n // len(phrase))))], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
        took.append(time.time() - began)
        assert (row.n_words, row.n_hit, row.n_items) == (n // len(phrase) * len(phrase),) * 2 + (50,)
    assert took[1] < 20


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar"><header><h1>Site</h1></header><nav><a href="/">Home</a></nav>
<div class="cookie-notice">We use cookies, many of them, on all of these pages here.</div><article><header><h1>Title &amp; more</h1></header><p><b>First
  paragraph<br><p>Second&nbsp;one, <a href="x">linked</a> text.<ul><li>one<li>two</ul><div class="ad">Buy things now</div><form><p>Sign up</p></form></article>
<section id="comments"><p>What a long and winding comment this is, longer than the article is, by far and for sure, and it goes on.</p></section><aside>More</aside><footer>&copy; me</footer></body></html>"""


def test_op4_main_text(spark):
    assert main_text(PAGE) == "Title & more\n\nFirst paragraph\n\nSecond one, linked text.\n\none\n\ntwo"
    plain = "<div id=nav><a>x</a></div><div id=content><h1>Head line here</h1>" + "<p>Some words that make a paragraph of text, quite long.</p>" * 3 + "</div><div class=side><a href=a>l</a><a href=b>m</a></div>"
    assert main_text(plain) == "\n\n".join(["Head line here"] + ["Some words that make a paragraph of text, quite long."] * 3)
    rows = [(1, PAGE, "x"), (2, None, "x"), (3, "", "x"), (4, "<nav>only</nav>", "x"), (5, "<p>a < b &lt; c <!-- cut", "x"), (6, "<div>" * 3000 + "deep", "x"), (1, PAGE, "x")]
    got = extract_text(spark.createDataFrame(rows, "page_id long, html string, text string"))
    assert got.columns == ["page_id", "html", "text", "n_chars"]
    by = {r.page_id: (r.text, r.n_chars) for r in got.collect()}
    assert got.count() == 7 and by[2] == by[3] == by[4] == ("", 0) and by[5] == ("a < b < c", 9) and by[6] == ("deep", 4)


def test_op4_article_within_form_or_hinted_element():
    block = "<p>Some words that make a paragraph of text, quite long.</p>" * 3
    want = "\n\n".join(["Head line here"] + ["Some words that make a paragraph of text, quite long."] * 3)
    inner = "<h2>Head line here</h2>" + block
    for page in (
        f"<body><form id=aspnetForm><div class=menu><a href=a>x</a></div><article><h1>Head line here</h1>{block}</article><label>Find</label><input></form>",
        f"<body><form><div class=menu><a href=a>x</a></div><div id=content>{inner}</div><div class=sidebar><p>Side words</p></div><button>Go</button></form>",
        f"<body><form>{inner}<section class=comments>{block * 3}</section></form>",
        f"<body><div class='layout no-sidebar'>{inner}</div><div class=sidebar>Side words</div>",
        f"<body><div>Foot</div><div class='header-fixed content'>{inner}</div>",
        f"<body><div class=share>{inner}</div><div class=related><a href=a>Other page</a></div>",
        f"<body><div id=content>{inner}</div><div class=comments>{block * 3}</div><form><p>Sign up</p></form>",
    ):
        assert main_text(page) == want, page
    widgets = "".join(f"<div class=page-widget><p>Paragraph {i} of the text, quite long as these go.</p></div>" for i in range(4))
    assert main_text(f"<body>{widgets}<form hidden>{block}</form>") == "\n\n".join(f"Paragraph {i} of the text, quite long as these go." for i in range(4))


def tree_text(rng, depth):
    """A random tree of blocks: (tag, children), where a string is text and ("a", [text]) a link."""
    if depth == 0 or rng.random() < 0.3:
        kids = [rng.choice((prose(rng, rng.randrange(1, 60)), ("a", [prose(rng, rng.randrange(1, 6))]), ("b", [prose(rng, 3)]))) for _ in range(rng.randrange(1, 4))]
        return (rng.choice("p h2 div li".split()), kids)
    return (rng.choice("div section ul".split()), [tree_text(rng, depth - 1) for _ in range(rng.randrange(1, 6))])


def markup(node):
    return node if isinstance(node, str) else f"<{node[0]}>{''.join(map(markup, node[1]))}</{node[0]}>"


def by_definition(tree):
    """The best subtree, and all whose holder reaches the threshold, from the definitions, each by walking the tree."""
    inline = lambda x: isinstance(x, str) or x[0] in "ab"
    text = lambda x: x if isinstance(x, str) else "".join(map(text, x[1]))
    size = lambda xs: sum(len("".join(text(x).split())) for x in xs)
    every = lambda x: [] if isinstance(x, str) else [x] + [z for y in x[1] for z in every(y)]
    blocks = lambda x: [y for y in every(x) if not inline(y)]
    links = lambda xs: [y for x in xs for y in every(x) if not isinstance(x, str) and y[0] == "a"]
    ratio = size(links([tree])) / max(1, size([tree]))

    def dense(xs, tags):
        c, lc, lt = size(xs), size(links(xs)), len(links(xs))
        t = tags + lt
        if not c:
            return 0.0
        base = math.log(c / max(1, c - lc) * lc + ratio * c + math.e)
        return c / max(1, t) * (math.log(c / max(1, lc) * max(1, t) / max(1, lt)) / math.log(max(base, 2)))

    of = lambda b: dense([b], len(blocks(b)) - 1)
    own = lambda b: dense([x for x in b[1] if inline(x)], 0)
    total = lambda b: own(b) + sum(of(x) for x in b[1] if not inline(x))
    best = lambda b: max(blocks(b), key=lambda x: (round(total(x), 9), x is b))  # noqa: E731  outermost first: max() takes the first of equals
    top = best(tree)
    path = [b for b in blocks(tree) if any(x is top for x in blocks(b))]
    threshold = min(map(of, path))
    return top, [best(b) for b in blocks(tree) if size([b]) and of(b) >= threshold and (b is tree or 2 * size(links([b])) < size([b]))], text


def test_op4_density_by_definition():
    for seed in range(300):
        rng = random.Random(seed)
        tree = ("body", [tree_text(rng, 3) for _ in range(rng.randrange(1, 5))])
        got = main_text(markup(tree))
        top, chosen, text = by_definition(tree)
        squeeze = lambda x: "".join(x.split())
        assert squeeze(text(top)) in squeeze(got), seed
        for b in chosen:
            assert squeeze(text(b)) in squeeze(got), seed
        if chosen and all(b is top for b in chosen) and top is tree:
            assert squeeze(got) == squeeze(text(tree))


def test_op4_without_article_or_main():
    block = "<p>Some words that make a paragraph of text, quite long.</p>"
    want = lambda k: "\n\n".join(["Head line here"] + ["Some words that make a paragraph of text, quite long."] * k)
    nav = "<nav><a href=a>Home</a> <a href=b>News</a> <a href=c>More</a></nav><div><a href=d>Next</a></div>"
    assert main_text(f"<body>{nav}<div><h1>Head line here</h1><p><b>Some words that make</b> a paragraph<br>of text, quite long.</p></div><div>Foot</div>") == want(1)
    assert main_text(f"<body>{nav}<div><h1>Head line here</h1><div>{block * 4}</div><div>{block}</div><div>{block * 2}</div></div><div>Foot</div>") == want(7)
    assert main_text(f"<body>{nav}<h1>Head line here</h1><div>{block * 3}</div><div>Foot</div>") == want(3)
    assert main_text(f"<body>{nav}<div><div><div><h1>Head line here</h1>{block * 2}<ul><li>one</li><li>two</li></ul>{block}</div></div></div>{nav}") == want(2) + "\n\none\n\ntwo\n\n" + want(1).split("\n\n")[1]


def test_op4_deep_pages_in_linear_time():
    took = []
    for n in (16_000, 32_000):
        began = time.process_time()
        assert main_text("<div>" * n + "deep") == "deep"
        main_text(("<article><header><span class=ad>") * n + "x" + "</x>" * n)
        took.append(time.process_time() - began)
    assert took[1] < 4 * took[0] + 1 and took[0] < 5


def test_op4_empty_table_and_long_text(spark):
    schema = "page_id long, html string, n_chars string"
    assert extract_text(spark.createDataFrame([], schema)).count() == 0
    long = "<p>" + "Long words of a long page. " * 100_000 + "</p>"
    (row,) = extract_text(spark.createDataFrame([(1, long, "x")], schema)).collect()
    assert row.n_chars == len(row.text) == 27 * 100_000 - 1


def test_op5_as_of(spark):
    day = lambda c: F.col(c).cast("date")
    lists = [("a.com", "spam", "2023-01-10", True), ("a.com", "spam", "2023-02-10", False), ("a.com", "adult", "2023-03-10", True), ("x.a.com/p/", "phish", "2023-01-01", True), (None, "spam", "2023-01-01", True), ("b.org", "spam", None, True)]
    entries = spark.createDataFrame(lists, "pattern string, category string, listed_at string, listed boolean").withColumn("listed_at", day("listed_at"))
    asked = [("http://x.A.com/p/q", "2023-01-05", "x.a.com/p/"), ("http://y.a.com", "2023-01-10", "a.com"), ("http://y.a.com", "2023-02-10", None), ("http://a.com:80/", "2024-01-01", "a.com"), ("http://ba.com/", "2024-01-01", None), (None, "2024-01-01", None), ("http://a.com", None, None), ("b.org", "2024-01-01", None), ("http://y.a.com", "2023-01-10", "a.com")]
    captures = spark.createDataFrame([(*x, "old") for x in asked], "url string, fetched_at string, want string, matched string").withColumn("fetched_at", day("fetched_at"))
    got = op5_urls.filter_urls(captures, entries).collect()
    assert len(got) == len(asked) and all(r.matched == r.want and r.blocked == (r.want is not None) for r in got)
    assert op5_urls.filter_urls(captures, entries.limit(0)).where("blocked").count() == 0
    assert op5_urls.filter_urls(captures.limit(0), entries).count() == 0
    long = spark.createDataFrame([(f"http://a.com/{'p/' * 20_000}q", "2024-01-01"), (f"http://{'l.' * 3_000}a.com/p/q", "2024-01-01"), (f"http://x.a.com/p/{'p/' * 20_000}", "2024-01-01")], "url string, fetched_at string").withColumn("fetched_at", day("fetched_at"))
    assert [r.matched for r in op5_urls.filter_urls(long, entries).orderBy("url").collect()] == ["a.com", "a.com", "x.a.com/p/"]


def test_op6_targets_and_shares(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randrange(1, 60), None if i % 5 == 0 else "abcé"[i % 4], 9) for i in range(3000)] + [(7, None, "a", 9), (7, "", "a", 9), (8, "x y", "a", 9), (8, "x y", "a", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, taken long")
    got = op6_mixing.mix_sources(df).collect()
    assert len(got) == len(rows)
    size = defaultdict(int)
    for _, t, src, _ in rows:
        size[src] += len(words(t))
    order = sorted((s for s in size if s), key=str) + [None]
    weight = dict(zip(order, [3, 1, 2] * 9))
    target, full, left = {}, set(), 1.5 * sum(size.values())
    while True:  # what is above its cap is full; the rest is shared again
        free = [s for s in order if s not in full]
        share = left / sum(weight[s] for s in free)
        over = [s for s in free if share * weight[s] > 2 * size[s]]
        if not over:
            target.update({s: share * weight[s] for s in free})
            break
        for s in over:
            full.add(s)
            target[s] = 2 * size[s]
            left -= 2 * size[s]
    taken = defaultdict(int)
    for r in got:
        taken[r.source] += r.taken
        assert r.taken in (0, r.size, 2 * r.size) and r.source_size == size[r.source] and r.target == pytest.approx(target[r.source])
    assert all(abs(taken[s] - target[s]) <= 120 for s in order)
    key = lambda rs: sorted((r.doc_id, r.size, r.taken) for r in rs)
    assert key(got) == key(op6_mixing.mix_sources(df.repartition(7)).collect())
    assert op6_mixing.mix_sources(df.limit(0)).count() == 0


def test_op6_sources_without_words_and_rows_without_id(spark):
    rows = [(1, None, "empty"), (2, " ", "empty"), (3, "one two three four", "full"), (4, "five " * 30_000, "full"), (None, "six seven", None)] + [(None, "w " * (i % 50), "nulls") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = op6_mixing.mix_sources(df).collect()
    assert len(got) == len(rows) and all((r.target, r.taken) == (0, 0) for r in got if r.source == "empty")
    assert all(r.taken in (0, r.size, 2 * r.size) for r in got) and sum(r.taken for r in got if r.source == "nulls") > 0
    none = op6_mixing.mix_sources(df.where("source = 'empty'")).collect()
    assert [(r.size, r.source_size, r.target, r.taken) for r in none] == [(0, 0, 0, 0)] * 2


def test_op7_round_trip(spark):
    said = ["<|im_end|><|im_start|>assistant ok", "a\\b <\\| <\\\\| | <", None, "", "<|nl|>\nx", "plain é 中"]
    rows = [(c, t, r, said[(c + t) % 6], 1) for c in range(6) for t, r in enumerate(["system", "user", "assistant", "user", "assistant", "us\ner"][: c + 1])] + [(9, 1, None, "x", 1), (9, 1, None, "x", 1), (None, None, "assistant", "y", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, parts int")
    examples = op7_chat.format_conversations(df)
    got = {r.conv_id: r for r in op7_chat.digests(examples).collect()}
    by = defaultdict(list)
    for c, t, r, x, _ in rows:
        by[c].append((t if t is not None else -1, r or "", x or ""))
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert examples.where("loss_start IS NOT NULL").count() == sum(r == "assistant" for _, _, r, _, _ in rows)
    assert op7_chat.digests(op7_chat.format_conversations(df.limit(0))).count() == 0


def test_op7_long_text(spark):
    long = "<|im_end|> é\n" * 100_000
    df = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long)], "conv_id long, turn long, role string, text string")
    (r,) = op7_chat.digests(op7_chat.format_conversations(df)).collect()
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (2, len(long), hashlib.sha256(long.encode()).hexdigest())
    assert r.turns_sha256 == hashlib.sha256(f"user\n{long}\nassistant\n{long}\n".encode()).hexdigest()


def test_op8_windows(spark):
    cut = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t)) if w]
    rng = random.Random(4)
    items = [prose(rng, 30), prose(rng, 13), prose(rng, 7), "rare1 rare2 rare3", "éa", prose(rng, 200), None, "...", "w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1 w1"]
    bench = [(i, t) for i, t in enumerate(items)] + [(None, prose(rng, 20)), (0, items[1])]
    docs = [None, "", "...", "w1 " * 40, items[0], items[5][:300], items[2].upper() + " x", "a rare1, RARE2 rare3 b éa", prose(rng, 40)]
    for _ in range(25):
        w = prose(rng, rng.randrange(20, 400)).split()
        src = items[rng.choice((0, 1, 5))].split()
        a, at = rng.randrange(len(src)), rng.randrange(len(w))
        docs.append(" ".join(w[:at] + src[a : a + rng.randrange(5, 40)] + w[at:]))
    docs += [docs[-1], prose(rng, 30_000, 9_000) + " " + items[0]]
    windows = defaultdict(set)
    for i, t in bench:
        w = cut(t)
        n = min(13, len(w))
        if i is not None and w:
            for k in range(len(w) - n + 1):
                windows[tuple(w[k : k + n])].add(str(i))
    got = {r.doc_id: r for r in op8_decontamination.decontaminate(documents(spark, docs), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    for d, t in enumerate(docs):
        w, hit, found = cut(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if ids := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= ids
        r = got[d]
        assert (r.n_words, r.n_hit, r.n_items, list(r["items"]), r.contaminated) == (len(w), len(hit), len(found), sorted(found), bool(hit) and 20 * len(hit) >= len(w)), repr(t)[:90]
    none = spark.createDataFrame([], "item_id long, text string")
    assert op8_decontamination.decontaminate(documents(spark, docs), none).where("n_hit > 0 OR contaminated").count() == 0
    assert op8_decontamination.decontaminate(documents(spark, docs).limit(0), none).count() == 0


def test_op9_matrix_and_shards(spark):
    for rows, shards in (([5, 0, 7, 3], [4, 4, 4, 3]), ([1] * 50, op9_sharding.shard_sizes(50, 8))):
        m = op9_sharding.communication_matrix(rows, shards, 1)
        assert list(m.sum(axis=1)) == rows and list(m.sum(axis=0)) == shards and (m >= 0).all()
    rng = op9_sharding.np.random.default_rng(1)
    big = [op9_sharding.hypergeometric(rng, 2_000_000_000, 6_000_000_000, 1000) for _ in range(400)]
    assert abs(sum(big) / 400 - 250) < 4
    df = spark.createDataFrame([(i, None if i % 9 == 0 else "t", 1) for i in range(1003)] + [(1, "t", 1)] * 4, "doc_id long, text string, shard int").repartition(5)
    got = op9_sharding.shard_rows(df).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert len(got) == 1007 and sorted(map(len, slots.values())) == [125] + [126] * 7
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert op9_sharding.shard_rows(df.limit(0)).count() == 0
    long = spark.createDataFrame([(i, "long " * 200_000, 1) for i in range(3)], "doc_id long, text string, shard int")
    assert sorted((r.shard, r.slot) for r in op9_sharding.shard_rows(long, 2).collect()) == [(0, 0), (0, 1), (1, 0)]


def chi_square(seen, expected):
    return sum((a - b) ** 2 / b for a, b in zip(seen, expected, strict=True))


def test_op9_is_uniform(spark):
    """Matrix cells against the hypergeometric law, and where the rows of each partition come to stand."""
    from math import comb

    rows, shards, draws = [5, 3, 4], [6, 6], 4_000
    cells = Counter(int(op9_sharding.communication_matrix(rows, shards, seed)[0, 0]) for seed in range(draws))
    law = [comb(6, k) * comb(6, 5 - k) / comb(12, 5) * draws for k in range(6)]
    assert chi_square([cells[k] for k in range(6)], law) < 20.5  # 5 degrees of freedom, p = 0.001
    df = spark.range(40_000).withColumnRenamed("id", "doc_id").repartition(7)
    parts = df.select("doc_id", F.spark_partition_id().alias("part"))
    got = op9_sharding.shard_rows(parts, 8).collect()
    by = Counter((r.part, r.shard) for r in got)
    share = Counter(r.part for r in got)
    assert chi_square([by[p, k] for p in range(7) for k in range(8)], [share[p] / 8 for p in range(7) for _ in range(8)]) < 77  # 42 degrees, p = 0.001
    place = Counter((r.doc_id // 4_000, (r.shard * 5_000 + r.slot) // 2_000) for r in got)
    assert chi_square([place[a, b] for a in range(10) for b in range(20)], [200.0] * 200) < 235  # 171 degrees, p = 0.001
    pairs = Counter((r.slot % 2, r.doc_id % 2) for r in got)
    assert chi_square(list(pairs.values()), [10_000.0] * 4) < 16.3
    assert sorted((r.doc_id, r.shard, r.slot) for r in got) == sorted((r.doc_id, r.shard, r.slot) for r in op9_sharding.shard_rows(parts, 8).collect())


def test_op10_archives(spark):
    rows = [(i, f"http://h/{i}\r\n%0A é", f"<p>page {i % 5} {'x é ' * (i % 5) * 50}</p>") for i in range(60)] + [(60, None, None), (61, "u", ""), (None, "u", "lone"), (62, "u", "y" * 3_000_000)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload int")
    got = {r.page_id: r for r in op10_warc.archive_pages(pages, archive_bytes=20_000).collect()}
    first = {}
    for i, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        first.setdefault(h or "", i)
    for i, u, h in rows:
        b, r = (h or "").encode(), got[i]
        assert (r.payload_bytes, r.payload_digest, r.url) == (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), u)
        assert (r.record_type, r.refers_to) == (("response", None) if first[h or ""] == i else ("revisit", first[h or ""]))
        assert (bytes(r.payload) if r.payload is not None else None) == (b if r.record_type == "response" else None)
    assert op10_warc.archive_pages(pages.limit(0)).count() == 0
    same = spark.createDataFrame([(1, "u", "same")] * 3, "page_id long, url string, html string")
    assert [(r.page_id, r.record_type) for r in op10_warc.archive_pages(same).collect()] == [(1, "response")] * 3
    ids = [re.search(rb"urn:uuid:([^>]*)", op10_warc.record_bytes(1, "u", b"same", None, False, str(i)))[1] for i in range(3)]
    assert len(set(ids)) == 3


def test_op10_reader_refuses_what_is_broken():
    import zstandard

    records = [op10_warc.record_bytes(i, "u", (f"<p>{i} " + "text of a page " * 20).encode(), None, False) for i in range(200)]
    head, dictionary = op10_warc.archive_head(records, 4096)
    assert head[:4] == bytes.fromhex("5d2a4d18") and dictionary
    frames = [zstandard.ZstdCompressor(dict_data=dictionary).compress(r) for r in records]
    read = lambda data, piece=1 << 18: list(op10_warc.read_archive(io.BytesIO(data), piece))
    assert len(read(head + b"".join(frames))) == 200
    assert read(head + b"".join(frames), 7) == read(head + b"".join(frames)) and read(b"") == []
    packed = zstandard.ZstdCompressor().compress(dictionary.as_bytes())
    again = op10_warc.struct.pack("<II", op10_warc.DICTIONARY_MAGIC, len(packed)) + packed
    assert len(read(again + b"".join(frames))) == 200
    for cut in (head + b"".join(frames)[:-9], head[:-5], head[:6], head + b"".join(frames) + b"rest", head + b"".join(frames) + b"\x28"):
        with pytest.raises((ValueError, zstandard.ZstdError)):
            read(cut)
    assert op10_warc.parse_record(records[0].replace(b"WARC/1.1", b"WARC/1.0"))[:3] == (0, "u", "response")
    for kind in (b"warcinfo", b"request", b"metadata"):
        assert op10_warc.parse_record(records[0].replace(b"WARC-Type: response", b"WARC-Type: " + kind)) is None
    drop = lambda name: re.sub(rb"\r\n" + name + rb": [^\r]*", b"", records[0], count=1)
    for bad in (*map(drop, (b"WARC-Record-ID", b"WARC-Date", b"WARC-Type", b"Content-Length")), records[0].replace(b"2024-01-01T", b"last week "), records[0].replace(b"WARC/1.1", b"WARC/9.9"), records[0].replace(b"text", b"tixt"), records[0][:-4], records[0].replace(b"Content-Length: ", b"Content-Length: 1")):
        with pytest.raises(ValueError):
            op10_warc.parse_record(bad)
