"""Operators on small tables: defined results for nulls, empty and long texts, ties, repeats and empty tables."""

import hashlib
import itertools
import math
import random
import re
import time
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from keystead.llm import chat_format, html_extract, lm_score, packing, token_counts, tokens, toxicity, url_filter
from keystead.llm.common import components, held_out
from keystead.llm.decontaminate import contaminated, drop_contaminated
from keystead.llm.exact_dedup import drop_exact_copies, exact_groups
from keystead.llm.jaccard_join import keep_one_of_each, near_classes, shared_depth

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
#: Extra columns, among them names that the operators use inside.
DOCS = "doc_id long, text string, score double, hash string, rep long, part int, label string, host string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, 0.5, "x", 1, 2, None, "h") for i, t in rows], DOCS)


def words(n, seed, vocabulary=500):
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(vocabulary)}" for _ in range(n))


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (4, "a"), (None, "a"), (5, "x" * 50_000), (6, words(30_000, 1)), (7, "é́ 東京 \u00a0 ok")]


# ---- 1 exact copies


def test_exact_groups(spark):
    rows = [(1, "a"), (5, "a"), (3, "b"), (2, None), (9, ""), (4, "A"), (7, "a")]
    got = {r.doc_id: r for r in exact_groups(documents(spark, rows), keep="largest").collect()}
    assert {k: (r.keep_id, r.group_size, r.kept) for k, r in got.items()} == {
        1: (7, 3, False), 5: (7, 3, False), 7: (7, 3, True), 3: (3, 1, True), 2: (9, 2, False), 9: (9, 2, True), 4: (4, 1, True),
    }
    assert got[2].text_sha256 == hashlib.sha256(b"").hexdigest()
    assert {r.doc_id for r in drop_exact_copies(documents(spark, rows)).collect()} == {1, 3, 2, 4}


def test_exact_groups_compare_bytes(spark):
    rows = [(1, "aa"), (2, "bb"), (3, "aa"), (4, "bb"), (5, "ccc"), (6, "cc"), (7, "aa")]
    weak = lambda digest: F.lit(b"same")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_groups(documents(spark, rows), hash_of=weak).collect()}
    assert got == {1: (1, 3), 3: (1, 3), 7: (1, 3), 2: (2, 2), 4: (2, 2), 5: (5, 1), 6: (6, 1)}


def test_exact_groups_odd_rows(spark):
    got = exact_groups(documents(spark, ODD)).collect()
    assert len(got) == len(ODD)
    assert sorted((r.keep_id, r.group_size) for r in got if r.doc_id in (4, None)) == [(4, 3)] * 3
    assert exact_groups(documents(spark, [])).collect() == []
    kept = drop_exact_copies(documents(spark, ODD))
    assert kept.columns == documents(spark, []).columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 5, 6, 7]


def test_repeated_rows_stay_once_whatever_the_columns(spark):
    rows = [(4, "same", "x", None), (4, "same", "x", None), (4, "same", "y", [1]), (4, "other", "x", None), (None, None, "z", None), (None, "", "z", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone_id string, again_digest array<int>")
    got = drop_exact_copies(docs)
    assert got.columns == docs.columns and sorted((r.doc_id or 0, r.text or "") for r in got.collect()) == [(0, ""), (4, "other"), (4, "same")]
    assert sorted(map(str, got.collect())) == sorted(map(str, drop_exact_copies(docs.repartition(5)).collect()))


# ---- 2 token counts


def best_count(word, scores, byte_score):
    best = [(0.0, 0)] + [None] * len(word)
    for end in range(1, len(word) + 1):
        width = len(word[end - 1].encode())
        options = [(best[end - 1][0] + width * byte_score, best[end - 1][1] - width)]
        options += [(best[i][0] + scores[word[i:end]], best[i][1] - 1) for i in range(end) if word[i:end] in scores]
        best[end] = max(options)
    return -best[-1][1]


def test_token_counts(spark):
    scores = token_counts.zipf_scores(PIECES)
    lowest = min(scores.values()) - 10
    rows = [r for r in ODD if r[0] != 5] + [(8, "the theory of thermal theft"), (9, words(50, 3))]
    got = sorted((r.doc_id or 0, r.n_pretokens, r.n_tokens) for r in token_counts.token_counts(documents(spark, rows), PIECES, kept=40).collect())
    want = []
    for doc_id, text in rows:
        parts = ["▁" + w for w in (text or "").split()]
        memo = {p: best_count(p, scores, lowest) for p in set(parts)}
        want.append((doc_id or 0, len(parts), sum(memo[p] for p in parts)))
    assert got == sorted(want)
    assert token_counts.token_counts(documents(spark, []), PIECES).collect() == []


# ---- 3 toxicity


def test_toxicity_finds_unseen_misspellings(spark):
    rows, labels = [], []
    for i in range(1600):
        text = words(60, i).split()
        if i % 4 == 0:
            text[i % 50] = ["horridon", "vilegraph", "nastybun"][i % 3]
        rows.append((i, " ".join(text)))
        labels.append((i, int(i % 4 == 0)))
    docs = documents(spark, rows)
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    test = [(1, words(300, 900) + " horridonn " + words(300, 901)), (2, words(600, 902)), (3, words(30, 9) + " vilegraphs"), (4, None), (5, "")]
    got = {r.doc_id: r.score for r in toxicity.score(documents(spark, test), model).collect()}
    assert got[1] > 0.5 and got[3] >= 0.7 and max(got[2], got[4], got[5]) < 0.3
    assert {r.doc_id for r in toxicity.drop_toxic(documents(spark, test), model, threshold=0.5).collect()} == {2, 4, 5}
    again = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert (again.weights == model.weights).all() and again.slope == model.slope


def test_toxicity_scores_against_brute_force(spark):
    draw = random.Random(4)
    rows = [(k, words(draw.randrange(60), k) + (" nastyword" if k % 3 == 0 else "")) for k in range(60)]
    # the one toxic window of a very long text is not lost in scoring
    rows += [(100, words(20_000, 9, 9000) + " nastyword " + words(20_000, 8, 9000)), (101, words(30_000, 7, 9000))]
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k, _ in rows if k < 100], "doc_id long, toxic int")
    docs = documents(spark, rows)
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    for doc_id, text in rows[:60]:
        totals = []
        for window in toxicity.windows(text, 12):
            buckets = [toxicity.grams([word], 1 << 18)[1] for word in window]
            totals.append(sum(sum(float(model.weights[k]) for k in own) / len(own) for own in buckets))
        logit = model.slope * (max(totals, default=0.0) / 12 + model.bias) + model.shift
        assert abs(got[doc_id] - 1 / (1 + math.exp(-logit))) < 1e-5
    assert got[100] > 0.7 > got[101]


def test_toxicity_without_labels(spark):
    docs = documents(spark, ODD)
    one_kind = spark.createDataFrame([(4, 1), (None, 1), (7, None)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, one_kind)).collect()
    assert len(got) == len(ODD) and all(r.score == 0 for r in got)
    assert toxicity.drop_toxic(docs, None).count() == len(ODD)
    assert toxicity.score(documents(spark, []), None).collect() == []


# ---- 4 URL rules

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("a.b", "/x", "block")]


def test_url_rules(spark):
    urls = [
        (1, "http://Example.NET/en/x?y"), (2, "https://example.net"), (3, "http://example.net/fr"), (4, None), (5, "no scheme"),
        (6, "x://q.a.b/xyz#f"), (7, "x://qa.b/xyz"), (8, "http://net/"), (8, "http://net/"), (9, "a://u.net/?x=://org/fr/"), (None, "h://É.net/"),
    ]
    pages = spark.createDataFrame([(i, u, "k") for i, u in urls], "page_id long, url string, key string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    for blocks in (1, 1 << 13):
        got = sorted(((r.page_id or 0, r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, rules, blocks=blocks).collect()), key=str)
        assert got == sorted([
            (1, "example.net", "/en/x", "example.net/en/", "allow"), (2, "example.net", "", None, "allow"),
            (3, "example.net", "/fr", "net/", "block"), (4, "", "", None, "allow"), (5, "", "", None, "allow"),
            (6, "q.a.b", "/xyz", "a.b/x", "block"), (7, "qa.b", "/xyz", None, "allow"), (8, "net", "/", "net/", "block"),
            (8, "net", "/", "net/", "block"), (9, "u.net", "/", "net/", "block"), (0, "É.net", "/", "net/", "block"),
        ], key=str)
    assert url_filter.filter_urls(pages, rules.limit(0), default="block").where("verdict = 'block'").count() == len(urls)
    assert url_filter.filter_urls(pages.limit(0), rules).collect() == []


# ---- 5 decontamination

ITEM = "The farmer named Peter has 12 apples and his friend Anna gives him 30 km of rope, so Peter walks home with 12 bags"


def test_templates_find_other_values(spark):
    other = ITEM.replace("Peter", "Oscar").replace("Anna", "Julia").replace("12", "77").replace("30", "4")
    broken = ITEM.replace("12 bags", "99 bags").replace("12 apples", "77 apples").replace("so Peter", "so Oscar")
    rows = [
        (1, "Some words before it. " + ITEM + " and words after"), (2, "Before. " + other), (3, "Nothing of this kind is here " + words(50, 1)),
        (4, ITEM.upper()), (5, None), (6, ""), (2, "Before. " + other), (None, ITEM.lower()),
    ]
    bench = spark.createDataFrame([(10, ITEM, 1), (11, None, 1), (12, "", 1), (13, "Too short", 1)], "item_id long, text string, size int")
    got = {r.doc_id: r for r in contaminated(documents(spark, rows), bench).collect()}
    assert set(got) == {1, 2, 4, None} and {r.item_id for r in got.values()} == {10}
    assert got[1].changed_slots == 0 and got[2].changed_slots >= 3 and got[2].coverage > 0.9
    worse = contaminated(documents(spark, [(1, "Before. " + broken)]), bench).collect()
    assert not worse or worse[0].coverage < got[2].coverage
    assert {r.doc_id for r in drop_contaminated(documents(spark, rows), bench).collect()} == {3, 5, 6}
    assert contaminated(documents(spark, []), bench).collect() == []
    assert contaminated(documents(spark, rows), bench.limit(0)).collect() == []
    short = contaminated(documents(spark, [(1, "It is too short, they say"), (2, "short")]), bench).collect()
    assert [(r.doc_id, r.item_id) for r in short] == [(1, 13)]


def test_plain_windows_against_brute_force(spark):
    bench = [(i, words(40, 700 + i)) for i in range(6)]
    rows = [(i, words(60, i) + " " + " ".join(bench[i % 6][1].split()[: 7 * (i % 7)]) + " " + words(9, 50 + i)) for i in range(40)]
    cut = lambda t: [tuple(t.split()[k : k + 8]) for k in range(len(t.split()) - 7)]
    spell = lambda t: re.sub(r"w(\d+)", lambda m: "w" + "".join(chr(97 + int(c)) for c in m[1]), t)
    rows, bench = [(i, spell(t)) for i, t in rows], [(i, spell(t)) for i, t in bench]
    want = set()
    for i, t in rows:
        own = set(cut(t))
        for k, b in bench:
            if sum(w in own for w in cut(b)) >= 0.3 * len(cut(b)):
                want.add((i, k))
    got = contaminated(documents(spark, rows), spark.createDataFrame(bench, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and want


def test_copies_of_items_made_of_values(spark):
    mixed = "Anna, Peter, Oscar and Julia got 12, 15, 18 and 21 km, then every one of them walked home again in the rain"
    bench = spark.createDataFrame([(1, "Compute 12, 15, 18, 21, 24"), (2, "Add 1, 2, 3, 4, 5, 6, 7, 8 and 9"), (3, mixed)], "item_id long, text string")
    rows = [
        (1, "Please compute 12, 15, 18, 21, 24 now"), (2, "Please compute 11, 14, 17, 20, 23 now"), (3, "12, 15, 18, 21, 24"),
        (4, "You may add 1, 2, 3, 4, 5, 6, 7, 8 and 9 here"), (5, "You may add 2, 3, 4, 5, 6, 7, 8, 9 and 10 here"), (None, "COMPUTE 12, 15, 18, 21, 24"),
        (6, "They say: " + mixed), (7, mixed.replace("Peter", "Thomas").replace("12", "99")),
    ]
    got = {(r.doc_id, r.item_id): r for r in contaminated(documents(spark, rows), bench).collect()}
    assert set(got) == {(1, 1), (4, 2), (None, 1), (6, 3), (7, 3)}
    assert all(got[key].coverage == 1 for key in [(1, 1), (4, 2), (None, 1), (6, 3)])
    assert {r.doc_id for r in drop_contaminated(documents(spark, rows), bench).collect()} == {2, 3, 5}


def test_names_that_open_sentences(spark):
    long = "Peter walked to the old mill by the river. Anna waited there for him. Peter brought bread and cheese. Anna brought wine"
    other = long.replace("Peter", "Oscar").replace("Anna", "Julia")
    bench = spark.createDataFrame([(1, "Tom has 5 apples and eats 2"), (2, long)], "item_id long, text string")
    rows = [
        (1, "Anna has 7 apples and eats 3"), (2, "Yesterday they said: Anna has 7 apples and eats 3"), (3, "There is one. " + other + ". End"),
        (4, "Nobody has seven apples, eats 3"), (5, "The has 7 apples and eats 3"), (6, long.lower()),
    ]
    got = {(r.doc_id, r.item_id): r for r in contaminated(documents(spark, rows), bench).collect()}
    assert set(got) == {(1, 1), (2, 1), (3, 2), (6, 2)}
    assert got[1, 1].changed_slots == 3 and got[3, 2].changed_slots == 2 and got[3, 2].coverage > 0.9


def test_runs_count_beside_the_share(spark):
    spell = lambda t: re.sub(r"w(\d+)", lambda m: "w" + "".join(chr(97 + int(c)) for c in m[1]), t)
    own = spell(words(200, 31)).split()
    rows = [(n, " ".join(own[50 : 50 + n])) for n in (19, 20, 50)] + [(1, " ".join(own[:19]) + " other " + " ".join(own[100:119]))]
    got = contaminated(documents(spark, rows), spark.createDataFrame([(1, " ".join(own))], "item_id long, text string")).collect()
    assert {r.doc_id for r in got} == {20, 50} and {r.matched for r in got} == {13, 43}


# ---- 6 pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=x>Home</a></ul></nav>
<div class="cookie-notice">We use cookies</div><div class="ad">Buy</div>{body}
<aside>Side</aside><form><p>Mail</p></form><footer>&copy; me</footer><script>var a="</article>"</script></body></html>"""


@pytest.mark.parametrize(
    "body",
    [
        "<article><h1>Head &amp; tail</h1><p>One <b>two\n three</b><br>four<p>Five&nbsp;six<ul><li>a<li>b</ul><div class=comments><p>No</div></article>",
        "<main><header><h1>Head &amp; tail</h1></header><p>One two three four</p><p>Five six</p><div>a</div><div>b</div></main>",
        "<div id=content><h1>Head &amp; tail</h1>One two three four<hr>Five six<table><tr><td>a<td>b</table></div>",
        "<div><h1>Head &amp; tail</h1><p>One two three four</p><p>Five six</p><p>a</p><p>b</p></div>",
    ],
)
def test_main_text(spark, body):
    rows = [(k, f"http://h{k % 2}.org/{k}", PAGE.replace("{body}", body)) for k in range(4)]
    rows += [(9, "http://h0.org/9", None), (10, None, ""), (11, "http://h1.org/e", "<p>"), (12, "x", "plain < text")]
    pages = spark.createDataFrame([(*r, "m") for r in rows], "page_id long, url string, html string, marks string")
    got = {r.page_id: r for r in html_extract.extract_pages(pages).collect()}
    for k in range(4):
        assert got[k].text == "Head & tail\n\nOne two three four\n\nFive six\n\na\n\nb" and got[k].n_chars == len(got[k].text)
    assert got[9].text == got[10].text == got[11].text == "" and len(got) == 8
    assert html_extract.extract_pages(pages.limit(0)).collect() == []


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ('<div class="layout has-sidebar"><article><p>Text</article><div class=sidebar>Side</div></div>', "Text"),
        ('<article class="post tag-search"><p>Text<div class=share>Share</div></article>', "Text"),
        ('<main><div class="has-sidebar"><article><p>Text</article></div></main>', "Text"),
        ('<article><p>Text</article><div id=comments><article class="comment" id="comment-7"><p>No</article></div>', "Text"),
        ('<article><p>Text<div class="comment-list"><article class=comment>No</article></div></article>', "Text"),
        ('<article class="post comments-open"><p>Text</article><div class="related-posts"><article><p>No</article></div>', "Text"),
        ('<div class="layout has-sidebar"><div><p>' + "Long text " * 20 + '<div class=ad>Buy more</div></div></div><div class=cookie>No</div>', ("Long text " * 20).strip()),
        ('<div class="content sidebar-left"><p>' + "Long text " * 20 + "</p><div class=share>No</div></div>", ("Long text " * 20).strip()),
        ("<div id=content><p>Text</div><div class=ad>" + "Buy " * 3 + "</div>", "Text"),
    ],
)
def test_class_words_lose_no_article(spark, body, want):
    page = "<html><body class=widget><nav>Menu</nav>{}<footer>End</footer></body></html>"
    rows = [(k, f"http://h.org/{k}", page.replace("{}", body)) for k in range(2)] + [(2, "http://h.org/2", page.replace("{}", "<div class=ad>Buy</div>"))]
    got = {r.page_id: r.text for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {0: want, 1: want, 2: ""}


def wrapper(*pages):
    """The wrapper of all pages."""
    first, *rest = [html_extract.wrapper_of(html_extract.parse(page)) for page in pages]
    for page in rest:
        first = html_extract.align(first, page)
    return first


def expression(node):
    """A wrapper as a regular expression: constants C, slots S."""
    if node["kind"] == "#":
        own = "C" if node["sign"] is not None else "S"
    else:
        own = f"{node['label'].partition('|')[0]}({' '.join(map(expression, node['kids']))})"
    return own + "+" * node["rep"] + "?" * node["opt"]


def test_wrapper_alignment():
    assert expression(wrapper("<div>a</div><p>x", "<div>b</div><p>x")) == "(div(S) p(C))"
    assert expression(wrapper("<div>a</div><p>x", "<p>x<div>a</div>")) == "(div(C)? p(C) div(C)?)"
    assert expression(wrapper("<p>x<ul><li>a<li>b</ul>", "<p>x<ul><li>a<li>b<li>c</ul><div>y</div>")) == "(p(C) ul(li(S)+) div(C)?)"
    assert expression(wrapper("<ul>" + "<li>a" * 9 + "</ul>", "<ul>" + "<li>a" * 9 + "</ul>")) == "(ul(li(C)+))"


def test_common_subsequence_against_brute_force():
    draw = random.Random(3)
    for _ in range(200):
        x, y = (["abc"[draw.randrange(3)] for _ in range(draw.randrange(7))] for _ in range(2))
        pairs = html_extract.common(x, y)
        assert [i for i, _ in pairs if i is not None] == list(range(len(x))) and [j for _, j in pairs if j is not None] == list(range(len(y)))
        both = [(i, j) for i, j in pairs if i is not None and j is not None]
        some = {tuple(c) for n in range(len(x) + 1) for c in itertools.combinations(x, n)}
        longest = max(len(c) for n in range(len(y) + 1) for c in itertools.combinations(y, n) if c in some)
        assert all(x[i] == y[j] for i, j in both) and len(both) == longest


@pytest.mark.parametrize("page", ["<div class=motto><p>{}</p></div><div class=story><p>{}</p></div>", "<div>{}</div><div>{}</div>", "<p>{}</p><p>{}</p>", "<div id=content>{}</div><div>{}</div>"])
def test_slots_are_the_story(spark, page):
    stories = [f"Story {k} tells of {7 * k} things." for k in range(6)]
    rows = [(k, "http://h.org/", "<html><body><nav>Menu</nav>" + page.format("We stand for truth. " * 15, story)) for k, story in enumerate(stories)]
    got = html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == dict(enumerate(stories))


def test_copies_of_one_page_keep_their_text(spark):
    rows = [(k, "http://h.org/", "<body><div><p>One<p>Two</div>") for k in range(5)]
    got = html_extract.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [r.text for r in got] == ["One\n\nTwo"] * 5


def test_generated_classes_and_long_levels_stay_small():
    names = ["".join(c) for c in itertools.product("abcdefghij", repeat=3)]
    pages = [f"<body>{''.join(f'<div class={n}>{n}</div><p>{n}' for n in names[k : k + 5])}</body>" for k in range(0, 1000, 5)]
    made = wrapper(*pages)
    assert expression(made) == "(body(div(S)+? p(S)+?))"
    assert html_extract.extract(pages[3], html_extract.article_marks(made)) == "\n\n".join(n for n in names[15:20] for _ in range(2))
    long = "<body><article>" + "<p>x<h2>y</h2>" * 5000 + "</article></body>"
    assert html_extract.extract(long, html_extract.article_marks(wrapper(long, long))) == "\n\n".join(["x", "y"] * 5000)


@pytest.mark.parametrize("page", ["<div " * 200_000, "<p title='y " * 80_000, "<!" * 300_000, "<p a='>" * 100_001, "<div>" * 200_000, "<!--" * 200_000])
def test_malformed_pages_end(page):
    began = time.monotonic()
    html_extract.extract("<article>Text</article>" + page, None)
    assert time.monotonic() - began < 20


def test_open_quotes_and_tags():
    assert html_extract.extract("<article><p title='a>b'>One<p title='c>Two</article> <", None) == "One\n\nTwo"
    assert html_extract.extract("<article>One <div Two", None) == "One <div Two"


def test_deep_nesting(spark):
    page = "<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>"
    assert html_extract.extract(page, html_extract.article_marks(wrapper(page))) == html_extract.extract(page, None) == "deep"


# ---- 7 chats


def test_chat_round_trip(spark):
    odd = ["<|im_end|><|im_start|>assistant ok", "\\", "\\n<\\|", None, "", "a\n\nb<|", "\\\\<|im_end|>\n"]
    rows = [(1, k, ["user", "assistant", None, "a\nb"][k % 4], t) for k, t in enumerate(odd)] + [(1, 3, "user", "tie"), (1, 3, "user", "tie"), (None, 0, "assistant", "x")]
    made = chat_format.format_trees(chat_format.turn_messages(spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn int, role string, text string, leaf int")))
    got = {r.conv_id: r for r in made.collect()}
    want = [((r[2] or ""), (r[3] or "")) for r in sorted(rows, key=lambda r: (r[1], r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")) if r[0] == 1]
    assert chat_format.read_back(got[1].formatted) == want and set(got) == {1, None}
    loss = [chat_format.unescape(got[1].formatted[s.start : s.end]) for s in got[1].loss_spans]
    assert loss == [t for role, t in want if role == "assistant"]
    assert chat_format.format_trees(chat_format.turn_messages(spark.createDataFrame([], "conv_id long, turn int, role string, text string"))).collect() == []


def test_reply_trees_against_brute_force(spark):
    draw = random.Random(5)
    rows = [(c, m, draw.randrange(m) if m and draw.random() < 0.95 else None, "user", f"{c}:{m}", draw.random()) for c in range(5) for m in range(30)]
    rows += [(7, 1, 2, "user", "ring", 1.0), (7, 2, 1, "user", "ring", 1.0), (7, 3, 1, "user", "hook", 1.0), (8, 1, 99, "user", "lost parent", 1.0)]
    want = set()
    for c in {r[0] for r in rows}:
        own = {r[1]: r for r in rows if r[0] == c}
        found = []
        for leaf in own.keys() - {r[2] for r in own.values()}:
            path, at = [], leaf
            while at in own and at not in path:
                path.append(at)
                at = own[at][2]
            if at not in path:
                found.append((-sum(own[m][5] for m in path) / len(path), leaf, path[::-1]))
        want |= {(c, leaf, rank, tuple(own[m][4] for m in path)) for rank, (_, leaf, path) in enumerate(sorted(found)[:3], 1)}
    messages = spark.createDataFrame(rows, "conv_id long, msg_id long, parent_id long, role string, text string, score double")
    got = chat_format.format_trees(messages, top=3).collect()
    assert {(r.conv_id, r.leaf, r.rank, tuple(t for _, t in chat_format.read_back(r.formatted))) for r in got} == want


# ---- 8 similarity join


def shingles(text):
    own = (text or "").lower().split()
    return {tuple(own[k : k + 5]) for k in range(max(1, len(own) - 4))} if own else set()


def test_near_classes_against_brute_force(spark):
    draw, rows = random.Random(3), []
    for base in range(12):
        text = words(150, base).split()
        for _ in range(6):
            changed = list(text)
            for _ in range(draw.randrange(6)):
                changed[draw.randrange(len(text))] = "other"
            rows.append((len(rows), " ".join(changed)))
    rows += [(100, None), (101, ""), (102, "Short text"), (103, "short TEXT"), (104, " ".join(["same"] * 500)), (105, " ".join(["same"] * 400)), (106, words(20_000, 77))]
    sets = {i: shingles(t) for i, t in rows}
    near = {i: {j for j in sets if j != i and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])} for i in sets}
    root = {i: i for i in sets}
    for _ in sets:
        root = {i: min([root[i], *(root[j] for j in near[i])]) for i in sets}
    # small chunks, so that a class spans blocks
    for chunk in (256, 2):
        got = near_classes(documents(spark, [*rows, (None, "short text")]), chunk=chunk).collect()
        assert {(r.doc_id, r.class_id, r.n_links, r.n_shingles) for r in got} == {(i, root[i], len(near[i]), len(sets[i])) for i in sets}
    kept = keep_one_of_each(documents(spark, [*rows, (None, "short text"), (0, rows[0][1])]))
    assert sorted((r.doc_id for r in kept.collect() if r.doc_id is not None)) == sorted([0, *set(root.values())])
    assert near_classes(documents(spark, [])).collect() == []


def test_prefixes_shorten_to_the_target():
    assert shared_depth(40, 0.8, 0.9995) == 7 and shared_depth(40, 0.8, 0.5) == 8 and shared_depth(1, 0.1, 0.99) == 1


def test_components(spark):
    draw = random.Random(1)
    edges = [(k, k + 1) for k in range(0, 60)] + [(draw.randrange(100, 200), draw.randrange(100, 200)) for _ in range(60)] + [(300, 300)]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {(r.node, r.root) for r in got} == set(root.items()) and len(got) == len(root)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


# ---- 9 packing


def test_encoder_equals_the_library():
    whole = Tokenizer.from_file(BPE)
    whole.encode_special_tokens = True
    odd = ["", " ", "a b", "a  b", " a", "a ", "a\nb c", "x \ny", "don't 's it'll", "a\u3000b c", "<|endoftext|> x", "é́ ü..  \n\n z", "tab\tx y", "東京 都 x", "a\x1cb c", "1 22 333 4444"]
    odd += [words(40, k) for k in range(30)]
    for kept in (5, 10_000):
        encode = tokens.encoder(BPE, kept)
        for _ in range(2):
            assert [list(memoryview(x).cast("I")) for x in encode(odd)] == [whole.encode(t, add_special_tokens=False).ids for t in odd]


@pytest.mark.parametrize("window", [3_000, 1 << 20])
def test_packing(spark, window):
    rows = [*ODD, *((k, words(k * 7 % 400, k)) for k in range(20, 90))]
    got = packing.pack(documents(spark, rows).coalesce(2), BPE, window_tokens=window).collect()
    whole = Tokenizer.from_file(BPE)
    ids = sorted((i or 0, whole.encode(t or "", add_special_tokens=False).ids + [1]) for i, t in rows)
    pieces: dict = {}
    sequences: dict = {}
    for r in got:
        pieces.setdefault(r.doc_id or 0, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for doc_id in pieces:
        own, copies = [x for i, x in ids if i == doc_id], sum(i == doc_id for i, _ in ids)
        assert {r.doc_tokens for r in pieces[doc_id]} == {len(own[0])}
        assert sum(r.length for r in pieces[doc_id]) == copies * len(own[0])
        for r in pieces[doc_id]:
            part = b"".join(x.to_bytes(4, "little") for x in own[0][r.start : r.start + r.length])
            assert zlib.crc32(part) == r.ids_crc32
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and at & (at - 1) == 0  # full, or a smaller power of two
    assert sum(sum(r.length for r in own) < 2048 for own in sequences.values()) <= 22
    assert packing.pack(documents(spark, []), BPE).collect() == []


def test_packing_balances_costs():
    window = packing.Window(64, 0)
    for k in range(400):
        window.add(k, b"\0\0\0\0" * (1 + k % 40))
    window.flush()
    costs: dict = {}
    for _, _, length, _, _, sequence, _ in window.take():
        costs[sequence] = costs.get(sequence, 0) + packing.cost(length, 64)
    assert max(costs.values()) < 1.6 * min(costs.values())


# ---- 10 language model


def test_scores(spark):
    rows = [*ODD, *((k, words(40, k % 13, 60).upper()) for k in range(20, 120))]
    docs = documents(spark, rows)
    got = lm_score.score(docs, held_out("doc_id", 7, 2), lm_score.Settings(block_tokens=300, parts=2)).collect()
    import collections
    import math

    tokens_of = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) + ["\n"]
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts = collections.Counter(w for i, t in rows if not out(i) for w in tokens_of(t))
    total, size = sum(counts.values()), len(counts)
    want = sorted((i or 0, out(i), len(tokens_of(t)), sum(counts[w] > 0 for w in tokens_of(t)), total, round(sum(math.log10((counts[w] + 1) / (total + size + 1)) for w in tokens_of(t)), 6)) for i, t in rows)
    assert sorted((r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    unseen = [r for r in got if r.held_out and (r.doc_id or 0) >= 20]
    assert unseen and sum(r.score for r in unseen) > sum(r.base_score for r in unseen)
    nothing = lm_score.score(docs, F.lit(True)).collect()
    assert all(r.base_score == 0 and abs(r.score) < 1e-9 and r.n_known == 0 and r.train_tokens == 0 for r in nothing)
    assert lm_score.score(documents(spark, []), F.lit(False)).collect() == []


def test_probabilities_sum_to_one():
    import numpy as np

    draw = np.random.default_rng(0)
    hashes = np.sort(np.repeat(np.arange(30, dtype=np.uint64), 4))
    context, counts = np.tile(np.arange(4, dtype=np.uint8), 30), draw.integers(1, 2000, 120)
    row = {"a": hashes.tobytes(), "b": context.tobytes(), "c": counts.tobytes(), "d": np.ones(120, np.int64).tobytes(), "e": np.ones(30, np.int64).tobytes(), "f": b""}
    tables = lm_score.seated(counts, 0.6, draw.random(120), draw)
    assert (tables >= 1).all() and (tables <= counts).all()
    row["d"] = tables.tobytes()
    state = lm_score.State(row)
    totals = lm_score.Totals(np.bincount(context, counts), np.bincount(context, tables), 30.0, 30.0, np.zeros(4), 0.6, 0.4)
    entry, parent = state.predict(totals, 1.0)
    unknown = (1 + 0.4 * 30) / (1 + tables.sum()) / 31
    assert abs(parent.sum() + unknown - 1) < 1e-9
    new = (1 + 0.6 * totals.tables) / (1 + totals.customers)
    assert np.allclose(np.bincount(context, entry) + new * unknown, 1)


def test_contexts_are_single_words(spark):
    # sixty-four words that are each followed by their own twin: fewer classes than words would mix the twins
    draw = random.Random(7)
    text = lambda: ". " + " . ".join(f"left{n} right{n}" for n in (draw.randrange(64) for _ in range(40))) + " ."
    rows = [(k, text()) for k in range(100)]
    pairs = [(1000 + 64 * i + j, f". left{i} right{j} .") for i in range(64) for j in range(64)]
    settings = lm_score.Settings(block_tokens=4_000, parts=3)
    docs = documents(spark, [*rows, *pairs])
    score = {r.doc_id: r.score for r in lm_score.score(docs, F.col("doc_id") >= 1000, settings).collect()}
    for i in range(64):
        others = [score[1000 + 64 * i + j] for j in range(64) if j != i]
        assert score[1000 + 65 * i] > max(others) + 2


def test_probabilities_of_all_texts_sum_to_one(spark):
    import numpy as np

    draw = random.Random(3)
    rows = [(k, " ".join(draw.choice("aabbcdefgh") for _ in range(6))) for k in range(12)]
    every = [*sorted({w for _, t in rows for w in t.split()}), "unknown"]
    asked = ["", *every, *(f"{x} {y}" for x in every for y in every)]
    docs = documents(spark, [*rows, *((1000 + k, t) for k, t in enumerate(asked))])
    got = lm_score.score(docs, F.col("doc_id") >= 1000, lm_score.Settings(block_tokens=30, parts=2)).collect()
    chance = {asked[r.doc_id - 1000]: 10**r.score for r in got if r.held_out}
    # all texts that go on behind a word are the shorter text times v: v = 1 + R v
    further = np.array([[chance[f"{x} {y}"] / chance[x] for y in every] for x in every])
    v = np.linalg.solve(np.eye(len(every)) - further, np.ones(len(every)))
    assert abs(chance[""] + sum(chance[x] * k for x, k in zip(every, v, strict=True)) - 1) < 1e-3
