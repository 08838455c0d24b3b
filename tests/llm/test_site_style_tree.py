import math
import random
from collections import Counter, defaultdict

from tramline.llm import html_blocks, site_style_tree
from tramline.llm.html_blocks import blocks_of

SCHEMA = "page_id long, url string, html string, host string, parts string, text string"


def texts(spark, pages, **options):
    rows = [(i, u, h, "x", "y", "z") for i, (u, h) in enumerate(pages)]
    return {r.page_id: r.text for r in site_style_tree.extract_main_text(spark.createDataFrame(rows, SCHEMA), **options).collect()}


def test_blocks():
    got = [(b.text, b.noise) for b in blocks_of("<p>a &amp; b<br>c <b>d</b>\n e<p>f<div class='side-nav'>g</div><script>var x = '<p>no</p>'</script>h < i<!-- <p>no --><ul><li>j<li>k</ul>")]
    assert got == [("a & b c d e", False), ("f", False), ("g", True), ("h < i", False), ("j", False), ("k", False)]


def test_attributes_behind_long_ones_count():
    long, words = "x" * 600, "alpha hidden beta " * 40
    got = [(b.text, b.noise, b.scope) for b in blocks_of(f"<div data-a='{long}' class=advert>a</div><div style=\"{long}\" role='navigation'>b</div><div href={long} itemprop=articleBody>c</div><div data-config=\"{words}\">d</div><p>e")]
    assert got == [("a", True, ""), ("b", True, ""), ("c", False, "article"), ("d", False, ""), ("e", False, "")]
    inner = [(b.text, b.noise) for b in blocks_of(f"<body><div data-config='{words}'><p>f</p></div><div data-a={long} hidden>g</div>")]
    assert inner == [("f", False), ("g", True)]


def test_articles_without_what_surrounds_them(spark):
    page = """<html><head><title>t</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><a href=/>Home</a></nav>
    <div class="cookie-notice">We use cookies</div><article><header><h1>Head &eacute;</h1></header><p>First  para&shy;</p><div class="ad-slot"><p>Buy</p></div>
    <p>Second <a href=x>link</a>.</p><form>name<input></form><section id="comments"><p>nice!</p></section></article><aside>more</aside><footer>(c)</footer></body></html>"""
    assert texts(spark, [("http://a.b/1", page)]) == {0: "Head é\n\nFirst para\xad\n\nSecond link."}


def test_what_a_site_repeats_is_dropped_by_entropy(spark):
    def page(i):
        return f"<body><div class=top>Welcome to our site</div><div class=text>Story {i} is about {i * i} things</div><div class=end>All rights kept</div></body>"

    pages = [(f"http://one.org/{i}", page(i)) for i in range(12)] + [("http://two.org/", page(0))]
    got = texts(spark, pages)
    assert all(got[i] == f"Story {i} is about {i * i} things" for i in range(12))
    assert got[12] == "Welcome to our site\n\nStory 0 is about 0 things\n\nAll rights kept"  # too few pages to judge by


def neutral_page(i):
    """Class names that say nothing: links that vary, an article of its own, a notice, a line that varies a little."""
    rng = random.Random(i)
    words = lambda n: " ".join(rng.choices([f"w{k}" for k in range(3000)], k=n))
    links = "".join(f"<li><a href=/{k}>{words(1)}</a></li>" for k in range(rng.choice([5, 6, 6])))
    gold = [words(8), *(words(rng.randrange(8, 400)) for _ in range(rng.randrange(1, 9)))]
    body = f"<h2>{gold[0]}</h2>" + "".join(f"<p>{x}</p>" for x in gold[1:])
    page = f"<body><div class=c1><ul>{links}</ul></div><div class=c2><p>Keep <a href=/r>the rules</a>.</p></div><div class=c3>{body}</div><div class=c4><span>Made in {i % 2 + 2024}</span></div></body>"
    return page, "\n\n".join(gold)


def test_a_site_of_neutral_names_is_told_apart_by_entropy(spark):
    pages = [neutral_page(i) for i in range(60)]
    got = texts(spark, [(f"http://n.org/{i}", p) for i, (p, _) in enumerate(pages)])
    assert got == {i: gold for i, (_, gold) in enumerate(pages)}


def test_pages_that_are_copies_are_not_emptied(spark):
    page, gold = neutral_page(3)
    got = texts(spark, [("http://copies.org/x", page)] * 20)
    assert all(gold in t for t in got.values())


def test_names_that_only_hold_such_a_word_are_no_noise():
    noisy = ["ad", "ad-slot", "adSlot", "site-header", "main-nav", "cookie-notice", "comments", "comment-42", "post-comments", "right-rail", "newsletter-form", "related-posts", "shareButtons"]
    fine = ["search-and-rescue", "rail-news", "post-header", "article-header", "headerless", "no-sidebar", "with-comments", "alert-mountain", "shared-history", "menu-of-the-day-recipe", "load", "reading"]
    assert [x for x in noisy if not html_blocks._noisy_name(x)] == [] and [x for x in fine if html_blocks._noisy_name(x)] == []
    inside = [(b.text, b.noise) for b in blocks_of("<article><div class='search-and-rescue'><p>a</div><div class=rail-news><p>b</div><div class='x comments'><p>c</div></article>")]
    assert inside == [("a", False), ("b", False), ("c", True)]


def test_importances_are_those_of_a_tree_in_memory(spark):
    pages = [("h", neutral_page(i)[0]) for i in range(30)] + [("g", f"<div class=a><p>x {i}<p>same</div>") for i in range(9)]
    made = [(h, *site_style_tree.parts_of(p)) for h, p in pages]
    schema = "host string, parts array<struct<text:string,said:long,chars:long,linked:long,nodes:array<long>>>, nodes array<struct<node:long,makeup:long,kids:int,first:boolean>>"
    got = {(r.host, r.node): r.importance for r in site_style_tree.importances(spark.createDataFrame(made, schema)).collect()}

    def spread(values):
        n = len(values)
        return -sum(k / n * math.log(k / n) for k in Counter(values).values()) / math.log(n) if n > 1 else 1

    want = {}
    for host in ("h", "g"):
        own = [m for m in made if m[0] == host]
        leaves, elements, on = defaultdict(list), defaultdict(list), defaultdict(set)
        for i, (_, parts, nodes) in enumerate(own):
            for p in parts:
                leaves[tuple(p["nodes"])].append(p["said"])
            for n in nodes:
                elements[n["node"]].append(n)
                on[n["node"]].add(i)
        for node, found in elements.items():
            below = [(len(v), spread(v)) for k, v in leaves.items() if node == 0 or node in k]
            if len(on[node]) >= 8 and below:
                content = sum(n * s for n, s in below) / sum(n for n, _ in below)
                weight = 1 - 0.8 ** (sum(n["kids"] for n in found) / len(found))
                want[host, node] = weight * spread([n["makeup"] for n in found]) + (1 - weight) * content
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_edge_cases(spark):
    got = texts(spark, [(None, None), (None, ""), ("not a url", "plain text"), ("http://u@H.x:8/", "<p>one</p>" * 3), ("http://h.x", "<div" + " a" * 9000), ("http://h.x", "<div>" * 9000 + "deep"), ("http://h.x", "<p>" + "w " * 50_000)])
    assert (got[0], got[1], got[2], got[3], got[4], got[5]) == ("", "", "plain text", "one\n\none\n\none", "", "deep") and got[6] == ("w " * 50_000).strip()
    assert texts(spark, []) == {}


def test_query(spark, folder):
    rows = site_style_tree.op9_site_style_tree(spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/pages.parquet").count() and all(r.n_chars == len(r.text) for r in rows) and any(r.text for r in rows)
