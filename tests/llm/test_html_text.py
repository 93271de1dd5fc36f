from hypothesis import given, settings
from hypothesis import strategies as st

import numpy as np

from panelloom.llm import html_text as H

PAGE = """<!DOCTYPE html><html><head><title>T&amp;</title><script>var t="</p><article>no</article>";</script></head><body>
<nav><ul><li><a href="/a">menu</a></li></ul></nav><!-- <p>gone</p> --><div class="ad">buy</div>
<article class="post"><h1>Head&amp;line</h1><p><b>One   two<br><p>three <i>f</i>our&nbsp;&lt;5&gt;</p><aside>side</aside><p class="comment">c</p><p>end</p></article>
<div id="comments"><p>first!</p></div><form><p>mail</p></form><footer>&copy; x</footer></body>"""


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=14), st.lists(st.integers(0, 4), max_size=14))
def test_alignment_is_longest(a, b):
    p, q = H.aligned(a, b)
    assert p == sorted(set(p)) and q == sorted(set(q)) and [a[i] for i in p] == [b[j] for j in q]
    assert len(p) == lcs(a, b)


def test_zones():
    lines, zones = H.page_lines(PAGE)
    assert [x for x, z in zip(lines, zones, strict=True) if z == H.ARTICLE] == ["Head&line", "One two", "three four <5>", "end"]
    assert all(z == H.FURNITURE for x, z in zip(lines, zones, strict=True) if x in ("menu", "buy", "side", "c", "first!", "mail", "© x"))
    assert H.page_lines(None) == H.page_lines("") == ([], [])
    assert H.page_lines("a < b <p")[0] == ["a < b <p"]
    assert len(H.page_lines("<div>" * 5000 + "x")[0]) == 1


def test_differencing(spark):
    page = lambda x: f"<body><div>Top line</div><div>{x}</div><div>Bottom line</div></body>"
    rows = [
        (1, "http://h.com/a/1", page("alpha")),
        (2, "http://h.com/a/2", page("beta")),
        (3, "http://h.com/b/9", page("gamma &amp; more")),
        (4, "http://lone.com/", page("delta")),
        (5, None, page("epsilon")),
        (6, "http://h.com/c", None),
        (7, "http://h.com/d", ""),
        (8, "http://x.org/1", PAGE),
        (8, "http://x.org/1", PAGE),
        (9, "http://c.org/1", page("copy")),
        (10, "http://c.org/2", page("copy")),
        (11, "http://z.org/2", "<p>" + "long " * 50000),
    ]
    pages = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, text string")
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in H.main_text(pages).collect())
    text = {i: t for i, t, _ in got}
    assert len(got) == len(rows) and all(n == len(t) for _, t, n in got)
    assert (text[1], text[2], text[3]) == ("alpha", "beta", "gamma & more")
    assert text[4] == "Top line delta Bottom line" and text[5] == "Top line epsilon Bottom line"
    assert text[6] == text[7] == "" and text[8] == "Head&line One two three four <5> end"
    assert text[9] == text[10] == "Top line copy Bottom line"
    assert len(text[11]) == 50000 * 5 - 1
    assert H.main_text(pages.limit(0)).count() == 0


def test_articles_within_wrappers():
    own = lambda page: [x for x, z in zip(*H.page_lines(page), strict=True) if z == H.ARTICLE]
    story = "<article><p>story</p><div class=share>tweet</div><aside>side</aside><p>end</p></article>"
    for wrap in (
        '<div class="page with-sidebar">%s</div>', "<form id=aspnetForm><div>top</div>%s</form>", '<form class="search"><div class="social menu-open">%s</div></form>',
        '<div class="post comments-open">%s</div>', '<div role="form"><section id="cookie-page">%s</section></div>',
    ):
        assert own(wrap % story) == own(wrap % story.replace("article", "main")) == ["story", "end"]
        assert own(f"<body>{wrap % 'none'}</body>") == []
    for wrap in (
        "<nav>%s</nav>", "<aside>%s</aside>", "<footer><form>%s</form></footer>", '<div id="comments" class="comments-area">%s</div>', '<ol class="comment-list"><li>%s</li></ol>',
        '<div class="sidebar">%s</div>', '<div role="complementary">%s</div>', "<div hidden>%s</div>", '<aside><div class="promo">%s</div></aside>',
    ):
        assert own(wrap % story) == []


def test_wrapped_pages_keep_their_text(spark):
    page = lambda x: f'<body><form><div class="page with-sidebar"><div class="sidebar">links</div><article><p>{x}</p></article></div></form></body>'
    pages = spark.createDataFrame([(1, "http://h.com/1", page("alpha")), (2, "http://h.com/2", page("beta"))], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in H.main_text(pages).collect()} == {1: "alpha", 2: "beta"}


def test_alignment_of_many_lines_takes_little_memory():
    import tracemalloc

    rng = np.random.default_rng(2)
    a = [int(x) for x in rng.permutation(6000)]
    b = [x for x in a if x % 7] + [int(x) for x in rng.permutation(300)]
    tracemalloc.start()
    p, q = H.aligned(a, b)
    assert tracemalloc.get_traced_memory()[1] < 6_000_000
    tracemalloc.stop()
    assert [a[i] for i in p] == [b[j] for j in q] and len(p) >= sum(x % 7 > 0 for x in a)


def test_lines_of_one_polynomial_hash_are_told_apart(spark):
    def thue_morse(a, b):
        text = a
        while len(text) < 2048:
            text += text.translate(str.maketrans(a + b, b + a))
        return text

    x, y = thue_morse("a", "b"), thue_morse("b", "a")
    pages = [(1, "http://h.com/a", f"<p>{x}</p><p>same</p>"), (2, "http://h.com/b", f"<p>{y}</p><p>same</p>")]
    got = {r["page_id"]: r["text"] for r in H.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {1: x, 2: y}


def article(page):
    return [x for x, z in zip(*H.page_lines(page), strict=True) if z == H.ARTICLE]


def test_raw_elements_end_their_names():
    """Custom elements whose names begin like a raw one's are elements like any other, and unclosed ones swallow nothing."""
    for name in (*H._RAW.split("|"), *H._PAIRED.split("|")):
        for tag in (f"<{name}-card></{name}-card>", f"<{name}-card>", f"<{name}x/>", f"<{name}>gone</{name}>", f"<{name} a='b'>gone</{name} >"):
            assert article(f"<article><p>Before.</p>{tag}<p>After one.</p><p>After two.</p></article>") == ["Before.", "After one.", "After two."], tag
    for tag in ("<svg>", '<svg class="x"/>', "<template>", "<noscript>"):
        assert article(f"<article><p>Before.</p>{tag}<p>After.</p></article>") == ["Before.", "After."], tag
    assert article("<article><p>Before.</p><svg/><p>Between.</p><svg><text>gone</text></svg><p>After.</p></article>") == ["Before.", "Between.", "After."]


def test_attributes_are_read_whole():
    for tag in ('<a href="/page?id=share">', '<a title="my class=menu item">', "<a data-id=banner-3>", "<span data-class='menu'>", "<a href=/x?class=nav>", '<a title="hidden">', "<a href='a hidden b'>"):
        end = tag[1:].split()[0]
        assert article(f"<article><p>See the {tag}linked words</{end}> here.</p></article>") == ["See the linked words here."], tag
    assert article('<article><div data-id="banner-3">content</div></article>') == ["content"]
    for tag in ("<div hidden>", '<div HIDDEN="">', "<div title='a' hidden=until-found>", '<div class="x" role="navigation">', "<aside>", "<div class=ad>", '<div class="post-end comments-area">', "<div id=comments>"):
        end = tag[1:].split(">")[0].split()[0]
        assert article(f"<article><p>a</p>{tag}gone</{end}><p>b</p></article>") == ["a", "b"], tag


def test_names_within_an_article_are_decided_by_differencing(spark):
    names = ['class="related-work"', 'class="share-price"', 'id="search"', 'id="reply-to-critics"', 'class="social"', "class=promo"]
    page = lambda k: "<body><div>top</div><article><p>story %d</p>%s<div class=share>tweet this</div><p>end %d</p></article></body>" % (k, "".join(f"<div {n}>own {j} of {k}</div>" for j, n in enumerate(names)), k)
    rows = [(k, f"http://h.com/{k}", page(k)) for k in range(4)] + [(9, "http://lone.org/", page(9))]
    got = {r["page_id"]: r["text"] for r in H.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k, _, _ in rows:
        own = " ".join(f"own {j} of {k}" for j in range(len(names)))
        assert got[k] == (f"story {k} {own} end {k}" if k < 9 else f"story {k} {own} tweet this end {k}")


def test_whole_query_equals_brute_force(spark):
    """Generated hosts, whose pages are told by an independent rule: lines by their generator, sharing by sets of neighbours' lines
    (all lines of a page differ, and shared ones keep their order, so that the longest common subsequence is what they share)."""
    rng = np.random.default_rng(7)
    pages, want = [], {}
    for host in range(6):
        common = [f"common {host} {k}" for k in range(6)]
        for k in range(int(rng.integers(1, 12))):
            i, lines = len(pages), []  # (text, kind)
            has_article = rng.random() < 0.6
            for c in common:
                if rng.random() < 0.6:
                    lines.append((c, str(rng.choice(["body", "doubt", "nav"]))))
                lines.append((f"own {i} {len(lines)}", str(rng.choice(["body", "doubt", "nav", "ad"]))))
            out = []
            for text, kind in lines:
                wrap = {"body": "<p>%s</p>", "doubt": "<div class='related x'>%s</div>", "nav": "<nav>%s</nav>", "ad": "<div class=ad>%s</div>"}[kind]
                out.append(wrap % text)
            body = "".join(out)
            pages.append((i, f"http://h{host}.com/{k:03d}", f"<html><head><title>t</title></head><body>{'<article>' if has_article else ''}{body}{'</article>' if has_article else ''}</body></html>", lines, has_article, host))
    for n, (i, _, _, lines, has_article, host) in enumerate(pages):
        # What may be aligned: all lines but the plain ones of an article.
        loose = lambda p: {t for t, kind in p[3] if not (p[4] and kind == "body")}
        near = [p for p in (pages[n - 1] if n else None, pages[n + 1] if n + 1 < len(pages) else None) if p and p[5] == host]
        shared = set().union(*(loose(p) for p in near)) & loose(pages[n])
        if has_article:
            own = [t for t, kind in lines if kind == "body" or kind == "doubt"]
            left = [t for t, kind in lines if kind == "body" or kind == "doubt" and t not in shared]
        else:  # names decide outside an article
            own = [t for t, kind in lines if kind == "body"]
            left = [t for t in own if t not in shared]
        want[i] = " ".join(left or own)
    df = spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, html string").repartition(3)
    assert {r["page_id"]: r["text"] for r in H.main_text(df).collect()} == want


def test_all_lines_are_aligned_and_articles_stay(spark):
    """Lines that the pages' articles share count as shared, but stay; what one page protects isn't furniture in the other."""
    page = lambda k, cls: f"<body><p>top</p><article><h1>Series</h1><p>story {k}</p><div{cls}>note</div></article></body>"
    rows = [(1, "http://h.com/1", page(1, "")), (2, "http://h.com/2", page(2, " class=related")), (3, "http://x.com/1", page(3, " class=related")), (4, "http://x.com/2", page(4, " class=related"))]
    got = {r["page_id"]: (r["text"], r["n_shared"]) for r in H.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: ("Series story 1 note", 3), 2: ("Series story 2 note", 3), 3: ("Series story 3", 3), 4: ("Series story 4", 3)}
