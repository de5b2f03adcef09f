"""HTML extraction, URL filters and chat formatting."""

import collections
import datetime as dt
import heapq
import html
import itertools
import math
import random
import re
import time

import pytest

from docketlens.llm import chat_format, html_extraction, url_filters


def test_pages_of_the_corpus(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    text = {r["page_id"]: r["text"] for r in html_extraction.extract_pages(pages).collect()}
    for p in pages.collect():
        article = re.search(r"<article>(.*?)</article>", p["html"], re.S)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)[^>]*>", article)]
        assert text[p["page_id"]] == "\n".join(b for b in blocks if b)


PARAGRAPHS = "".join(f"<p>A paragraph of the article with a number of words, the {i}th, and no links at all.</p>" for i in range(4))
BODY = f"""<html><body><header><h2>Site</h2></header><nav><ul><li><a href=1>Home</a></li></ul></nav><div id="wrap"><div class="sidebar"><p>Popular posts here</p></div>
<div class="content"><h1>Title &amp; more</h1>{PARAGRAPHS}<ul><li>first</li><li>second</li></ul><form><input><p>Sign up</p></form></div>
<section class="comments"><p>{'A very long comment of a reader. ' * 40}</p></section></div><div class="cookie-notice">We use cookies</div><footer>foot</footer><script>var a = '<p>no</p>';</script></body></html>"""


def test_page_without_article_element():
    assert html_extraction.main_text(BODY).split("\n") == ["Title & more", *[f"A paragraph of the article with a number of words, the {i}th, and no links at all." for i in range(4)], "first", "second"]


@pytest.mark.parametrize(("page", "text"), [(None, ""), ("", ""), ("<html><nav><a href=1>x</a></nav></html>", ""), ("plain  text &lt;b&gt;", "plain text <b>"), ("<article><p>a<p>b<div>c<br>d</div></article>", "a\nb\nc d"), ("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000, "deep")])
def test_odd_pages(page, text):
    assert html_extraction.main_text(page) == text


def test_pages_table_with_nulls(spark):
    rows = [(1, "u", "<article><p>x</p></article>", 5), (1, "u", "<article><p>x</p></article>", 5), (None, None, None, 6)]
    out = html_extraction.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text int"))
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, "u", "x"), (1, "u", "x"), (None, None, "")], key=str)


def test_url_filters(spark):
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    entries = spark.createDataFrame(
        [("bad.example.org", day(10), "add"), ("bad.example.org", day(20), "remove"), ("bad.example.org", day(20), "add"), ("bad.example.org", day(30), "add"), ("a.example.com/x", day(5), "add"), (None, day(1), "add"), ("c.example.com", None, "add"), ("c.example.com", day(1), "what")],
        "pattern string, listed_at timestamp_ntz, action string",
    )
    spans = {tuple(r) for r in url_filters.intervals(entries).collect()}
    assert spans == {("bad.example.org", day(10), day(20)), ("bad.example.org", day(30), dt.datetime(9999, 12, 31)), ("a.example.com/x", day(5), dt.datetime(9999, 12, 31))}
    captures = spark.createDataFrame(
        [("http://bad.example.org/", day(9), 0), ("http://WWW.bad.example.org:80/q", day(10), 1), ("http://bad.example.org", day(20), 0), ("http://u@bad.example.org/z", day(31), 1), ("http://a.example.com/x/1", day(6), 1), ("http://a.example.com/y", day(6), 0), (None, day(6), 0), ("nonsense", day(6), 0), ("http://bad.example.org/", None, 0)] * 2,
        "url string, fetched_at timestamp_ntz, host int",
    )
    out = url_filters.filter_urls(captures, entries)
    expected = collections.Counter((r["url"], r["fetched_at"], bool(r["host"])) for r in captures.collect())
    assert collections.Counter((r["url"], r["fetched_at"], r["blocked"]) for r in out.collect()) == expected
    assert url_filters.filter_urls(captures.limit(0), entries.limit(0)).count() == 0


def cheapest(roles):
    """The least cost by Dijkstra's algorithm over (turn, state)."""
    c = chat_format
    heap, done = [(0, 0, c.START)], set()
    while heap:
        cost, i, s = heapq.heappop(heap)
        if (i, s) in done:
            continue
        done.add((i, s))
        if i == len(roles) and s == c.ASSISTANT:
            return cost
        for t in c.NEXT[s]:
            heapq.heappush(heap, (cost + c.INSERT, i, t))
        if i < len(roles):
            label = lambda t: 0 if t == roles[i] else c.NAME if roles[i] is None else c.RELABEL  # noqa: B023, E731
            for t in c.NEXT[s]:
                heapq.heappush(heap, (cost + label(t), i + 1, t))
            if s != c.START:
                heapq.heappush(heap, (cost + c.MERGE + label(s), i + 1, s))
    return None


def test_repairs_are_cheapest():
    for n in range(1, 6):
        for roles in itertools.product([None, "system", "user", "assistant"], repeat=n):
            out = chat_format.repair([(r, "x") for r in roles], chat_format.START, None, True)
            assert sum(o["cost"] for o in out) == cheapest([chat_format.role_of(r) for r in roles])
            tags = re.findall(r"<\|im_start\|>(\w+)", "".join(o["rendered"] for o in out))
            assert re.fullmatch("(system,)?(user,assistant,)+", ",".join(tags) + ",")


def test_conversations(spark, small):
    """Whole conversations, among them one of many chunks, against the repair in one piece."""
    source = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    source += [(9_000, i, ("user", "assistant", "user", None, "tool")[i * i % 5], f"t{i}") for i in range(2_000)]
    source += [(9_001, 0, None, None), (None, 0, "user", "a"), (None, 1, "assistant", "<|im_end|>"), (9_002, None, "user", "z"), (9_002, 1, "user", "y"), (9_003, 0, "user", "r"), (9_003, 0, "user", "r")]
    df = spark.createDataFrame([(*r, 1) for r in source], "conv_id long, turn long, role string, text string, chunk int").repartition(4)
    got = collections.defaultdict(list)
    for r in chat_format.format_chats(df).collect():
        got[r["conv_id"]].append(r)
    by = collections.defaultdict(list)
    for c, t, r, x in dict.fromkeys(source):
        by[c].append((t is None, t or 0, r, x))
    assert got.keys() == by.keys()
    for c, turns in by.items():
        turns.sort(key=lambda x: x[:2])
        mine = sorted(got[c], key=lambda r: (r["turn"] is None, r["turn"] or 0))
        assert len(mine) == len(turns)
        assert sum(r["cost"] for r in mine) == cheapest([chat_format.role_of(r) for _, _, r, _ in turns])
        tags = re.findall(r"<\|im_start\|>(\w+)", "".join(r["rendered"] for r in mine))
        assert re.fullmatch("(system,)?(user,assistant,)+", ",".join(tags) + ",")
    assert chat_format.format_chats(df.limit(0)).count() == 0


def paragraphs(name, n=4):
    return [f"A paragraph of the {name} with a good number of words, which is part {i} of it, and it has no links at all." for i in range(n)]


def marked(blocks):
    return "".join(f"<p>{b}</p>" for b in blocks)


@pytest.mark.parametrize("outer", ["div", "main"])
def test_story_in_a_div_beside_teaser_articles(outer):
    cards = "".join(f"<article><h3><a href=/{i}>Another headline, number {i}</a></h3><p>Short teaser. <a href=/{i}>Read more</a></p></article>" for i in range(4))
    page = f"<html><body><{outer}><h1>Title</h1><div>{marked(paragraphs('story', 6))}</div><div>{cards}</div></{outer}></body></html>"
    found = html_extraction.main_text(page).split("\n")
    assert [b for b in found if b in paragraphs("story", 6)] == paragraphs("story", 6)
    assert not [b for b in found if "teaser" in b]


@pytest.mark.parametrize("sizes", [(4, 4), (4, 3, 5), (2, 6)])
def test_story_in_several_articles(sizes):
    parts = [paragraphs(f"part {'abc'[k]}", n) for k, n in enumerate(sizes)]
    page = "<html><body><div>" + "".join(f"<article>{marked(p)}</article>" for p in parts) + "</div></body></html>"
    assert html_extraction.main_text(page).split("\n") == sum(parts, [])


STORY = marked(paragraphs("story"))


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>T</title><meta charset=x><body><article>{STORY}</article></body></html>",
        f"<html><head><title>T</title><style>p{{}}</style><article>{STORY}</article></html>",
        f"<html><head><title>T</title><noscript><img src=x></noscript><script>a</script></head><body><div>{STORY}</div></body></html>",
        f"<body><form id=aspnetForm><input type=hidden><div>{STORY}</div><select><option>x</select><button>Go</button></form></body>",
        f"<body><div>{STORY}</div><form><p>Sign up here</p><input></form></body>",
        f"<body><article class='commentary'>{STORY}</article></body>",
        f"<body><div id='noticeable'>{STORY}</div><div class='notice-bar'>Mind this</div><div class='comment_list'>So true</div></body>",
    ],
)
def test_pages_that_cut_rules_must_not_empty(page):
    assert html_extraction.main_text(page).split("\n") == paragraphs("story")


def test_title_in_a_header_class_of_an_article():
    page = f"<body><div class='header'>Site</div><article><div class='header'><h1>Title</h1></div>{STORY}</article></body>"
    assert html_extraction.main_text(page).split("\n") == ["Title", *paragraphs("story")]


def test_chunks_are_bounded_by_rows(spark):
    """Neither missing turn numbers, nor one turn number, nor repeated rows make a chunk of more than CHUNK rows."""
    roles = ("user", "assistant", None, "user", "tool")
    rows = [(None, None, roles[i * i % 5], f"a{i}") for i in range(700)]
    rows += [(1, 5, roles[i % 5], f"b{i}") for i in range(700)]
    rows += [(2, i, ("user", "assistant")[i], "again") for i in range(2)] * 700
    rows += [(3, None, "user", f"c{i}") for i in range(3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    turns = df.select("*", chat_format.F.xxhash64("role", chat_format.F.lit("/"), "text").alias("hash"))
    chunks = collections.Counter((r["conv_id"], r["chunk"]) for r in chat_format._in_chunks(turns)[0].collect())
    assert max(chunks.values()) <= chat_format.CHUNK and sum(chunks.values()) == len(set(rows))
    out = collections.defaultdict(list)
    for r in chat_format.format_chats(df).collect():
        out[r["conv_id"]].append(r)
    assert {k: len(v) for k, v in out.items()} == {None: 700, 1: 700, 2: 2, 3: 3}
    ordered = df.distinct().select("*", chat_format.F.xxhash64("role", chat_format.F.lit("/"), "text").alias("hash")).orderBy("turn", "hash").collect()
    for c, got in out.items():
        assert sum(r["cost"] for r in got) == cheapest([chat_format.role_of(r["role"]) for r in ordered if r["conv_id"] == c])
        assert sum(len(r["closing"]) > 0 or r["rendered"].endswith(chat_format.CLOSE) for r in got) == 1


def test_url_filters_on_domains_and_paths_of_any_length(spark):
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    listed = ["evil.com", "a.b.evil.net", "ok.org/x", "ok.org/x/y/z", "sub.evil.com", "0.1", "com"]
    entries = spark.createDataFrame([(p, day(1), "add") for p in listed] + [("sub.evil.com", day(5), "remove")], "pattern string, listed_at timestamp_ntz, action string")
    expected = {
        ("http://evil.com/", 2): ("host", "evil.com"),
        ("http://www.evil.com/q", 2): ("domain", "evil.com"),
        ("http://a.b.c.d.evil.com", 2): ("domain", "evil.com"),
        ("http://w.sub.evil.com/", 2): ("domain", "sub.evil.com"),
        ("http://w.sub.evil.com/", 6): ("domain", "evil.com"),
        ("http://c.a.b.evil.net/", 2): ("domain", "a.b.evil.net"),
        ("http://b.evil.net/", 2): (None, None),
        ("http://notevil.com/", 2): (None, None),
        ("http://ok.org/x/y", 2): ("path", "ok.org/x"),
        ("http://ok.org/x/y/z/w?x", 2): ("path", "ok.org/x/y/z"),
        ("http://ok.org/x/y/zz", 2): ("path", "ok.org/x"),
        ("http://ok.org/y/x", 2): (None, None),
        ("http://10.0.0.1/", 2): (None, None),
    }
    captures = spark.createDataFrame([(u, day(n)) for u, n in expected] * 2, "url string, fetched_at timestamp_ntz")
    out = url_filters.filter_urls(captures, entries).collect()
    assert len(out) == 2 * len(expected)
    assert {(r["url"], (r["fetched_at"] - day(0)).days): (r["matched_by"], r["matched_pattern"]) for r in out} == expected


@pytest.mark.parametrize("piece", ["<a ", "<!--", '<a b="', "<", "<title>", "<script>", "</", "&#", "<a b= ", "<div>", "<p><object><div>", "<li><ul><div>", "<textarea>x", "<form>", "<a class='ad-"])
def test_open_ends_take_linear_time(piece):
    """Half a megabyte of a construct that never ends takes seconds, not hours."""
    began = time.perf_counter()
    html_extraction.main_text(piece * (500_000 // len(piece)))
    assert time.perf_counter() - began < 20


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p>a < b &amp; c</p>", "a < b & c"),
        ("<p title='x > y'>a</p>", "a"),
        ("<p>a<!-- x -->b<!-->c</p>", "abc"),
        ("<P CLASS=Lead>a</P><SCRIPT>if (a < b) '</p>'</SCRIPT >b", "a\nb"),
        ("<p>&#0000000065;&#x041;&#99999999999;&#" + "9" * 5000 + ";</p>", "AA��"),
        ("<p>a</p><p>b <a href='x", "a\nb"),
        ("<title>a<p>b", ""),
        ("<?xml version='1.0'?><!DOCTYPE html><p>a</>b</p>", "ab"),
    ],
)
def test_markup_as_browsers_read_it(page, text):
    assert html_extraction.main_text(page) == text


def test_a_class_name_does_not_empty_a_page():
    for page in (f"<article class='post related'>{STORY}</article>", f"<div class='promo-article'>{STORY}</div>", f"<main id='widget'>{STORY}</main><div class='sidebar'>Side</div>"):
        assert html_extraction.main_text(f"<body>{page}</body>").split("\n") == paragraphs("story")
    assert html_extraction.main_text(f"<body><div>{STORY}</div><article class='post related'><p>A card beside it</p></article></body>").split("\n") == paragraphs("story")
    assert html_extraction.main_text("<body><div class='cookie-notice'>We use cookies</div></body>") == ""


def test_a_teaser_article_does_not_hide_the_content():
    page = f"<body><article><p>teaser</p></article><div class='content'>{STORY}</div></body>"
    assert html_extraction.main_text(page).endswith("\n".join(paragraphs("story")))


def made_tree(r, depth=0):
    """(tag, parts) with texts among its parts; links and spans hold texts only."""
    parts = []
    for _ in range(r.randint(1, 4)):
        kind = r.random()
        if kind < 0.35:
            parts.append(" ".join("x" * r.randint(1, 9) for _ in range(r.choice([1, 3, 40]))))
        elif kind < 0.6:
            parts.append((r.choice(["a", "a", "span", "h2"]), ["y" * r.randint(1, 30)]))
        elif depth < 4:
            parts.append(made_tree(r, depth + 1))
    return ("body" if depth == 0 else r.choice(["div", "div", "section", "article", "div"]), parts)


def markup(tree):
    return tree if isinstance(tree, str) else f"<{tree[0]}>" + "".join(map(markup, tree[1])) + f"</{tree[0]}>"


def below(tree):
    return [x for part in tree[1] if not isinstance(part, str) for x in [part, *below(part)]]


def letters(tree):
    return sum(len(x.replace(" ", "")) if isinstance(x, str) else letters(x) for x in tree[1])


@pytest.mark.parametrize("seed", range(200))
def test_densities_sums_and_threshold_by_plain_recursion(seed):
    """Counts afresh for every node from the tree itself, then the choice over all nodes, against the one pass over the page."""
    body = made_tree(random.Random(seed))
    everything = [body, *below(body)]
    links = lambda n: [x for x in [n, *below(n)] if x[0] == "a"]
    linked = lambda n: sum(letters(x) for x in links(n))

    def density(n):
        c, lc = letters(n), linked(n)
        if not c:
            return 0.0
        tags, link_tags = max(len(below(n)), 1), max(len(links(n)), 1)
        base = math.log(c / max(c - lc, 1) * lc + linked(body) / max(letters(body), 1) * c + math.e) + 1
        return c / tags * math.log(max(c * tags / (max(lc, 1) * link_tags), 1) + 1, base)

    tree = html_extraction.Tree()
    tree.feed(markup(body))
    html_extraction.settle(tree.top)
    chosen = html_extraction.choose(tree.top)
    nodes = html_extraction.in_order(tree.top)
    assert [n.tag for n in nodes[1:]] == [n[0] for n in everything[1:]]  # the body is the root
    dense = {id(n): density(n) for n in everything}
    sums = {id(n): sum(dense[id(x)] for x in n[1] if not isinstance(x, str)) for n in everything}
    for node, plain in zip(nodes, everything):
        assert node.chars == letters(plain) and node.link_chars == linked(plain)
        assert math.isclose(node.density, dense[id(plain)], abs_tol=1e-9) and math.isclose(node.total, sums[id(plain)], abs_tol=1e-9)
    full = [n for n in everything if letters(n)]
    if not full:
        assert chosen == []
        return
    favour = lambda n: 1.5 if n[0] == "article" else 1
    best = max(full, key=lambda n: sums[id(n)] * favour(n))
    best = best if sums[id(best)] > 0 else max(full, key=lambda n: dense[id(n)])
    above = [n for n in everything if any(x is best for x in below(n))]  # from the body down
    outer = next((n for n in [*above, best] if n[0] == "article"), best)
    path = [n for n in above if any(x is outer for x in below(n))]
    limit = min(dense[id(n)] for n in [*path, outer])
    kept = [outer]
    for n in path:
        for x in n[1]:
            if not isinstance(x, str) and letters(x) and not any(x is y for y in [*path, outer]):
                if x[0] == "h2" or (dense[id(x)] * favour(x) >= limit and 2 * linked(x) <= letters(x)):
                    kept.append(x)
    assert [nodes.index(n) for n in chosen] == sorted(next(i for i, y in enumerate(everything) if y is x) for x in kept)
