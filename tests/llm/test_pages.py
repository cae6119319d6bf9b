"""Operator 10 on pages whose article is known, and its edge cases."""

from graphloom.llm.html_text import extract_pages, main_text

ARTICLE = ["The river had risen for three days, and the lower fields, the mill, and the old road were under water.", "Nobody in the village, from the baker to the smith, remembered such a spring &amp; such a flood.", "By evening the\n  first boats came, slow, heavy, and late."]


def page(body, around=""):
    return f"<!doctype html><html><head><title>River</title><style>p {{color: red}}</style><script>var a = '<p>no</p>';</script></head><body>{around}{body}</body></html>"


def test_article_without_boilerplate():
    body = "<div class='content'><h1>Flood</h1>" + "".join(f"<p>{x}</p>" for x in ARTICLE) + "</div>"
    around = "<nav><ul><li><a href='/'>Home</a></li><li><a href='/b'>News, sports, weather</a></li></ul></nav><div class='cookie-notice'>We use cookies, and more, to give you a better experience on this site.</div>"
    text = main_text(page(body + "<div id='comments'><p>Great article, thanks, all of you, for this very long comment!</p></div><footer>© 2024, all rights reserved</footer>", around))
    assert text == "Flood\n" + "\n".join(" ".join(x.replace("&amp;", "&").split()) for x in ARTICLE)


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "<p>only, one, paragraph of some length here"), (4, "u", "<div><p>broken <b>markup, never closed, of a page"), (5, "u", "plain text, no tags, but long enough to be read"), (6, "u", "<script>x</script><!-- <p>no</p>"), (7, "u", "<p>" + "long, " * 50_000 + "</p>"), (3, None, "<p>only, one, paragraph of some length here")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'clash' as text", "1 as n_chars")
    got = extract_pages(spark, df).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows) and by[1].text == by[2].text == by[6].text == "" and by[3].text == "only, one, paragraph of some length here"
    assert by[4].text == "broken markup, never closed, of a page" and by[5].text.startswith("plain text") and by[7].n_chars == 6 * 50_000 - 1
    assert extract_pages(spark, df.limit(0)).count() == 0


def test_pages_table(spark, sf_dir):
    rows = extract_pages(spark, spark.read.parquet(f"{sf_dir}/pages.parquet")).collect()
    assert rows and all(r.n_chars == len(r.text) and "<" not in r.text[:1] for r in rows)


def test_hints_that_do_not_drop_an_article():
    from graphloom.llm.html_text import main_text

    body = "".join(f"<p>Paragraph {k} of the article has words, commas, and a length that counts for something here.</p>" for k in range(4))
    rest = "<div class='comment-list'><p>Nice one, thanks for it all.</p></div>"
    for opening, close in (("<div class='entry-content overflow-hidden'>", "</div>"), ("<div class='post comments-open'>", "</div>"), ("<div class='wrap overflow-hidden'>", "</div>"), ("<form action='x'><div>", "</div></form>")):
        got = main_text(f"<html><body>{opening}{body}{close}{rest}</body></html>")
        assert got.count("Paragraph") == 4 and "Nice" not in got, opening
    assert main_text(f"<html><body><div class='hidden'>{body}</div></body></html>") == ""
    end = "One closing paragraph, which stands alone in its section but is still a part of the text above it."
    got = main_text(f"<html><body><div><section>{body * 4}</section><h2>The end</h2><section><p>{end}</p></section></div></body></html>")
    assert got.endswith(f"The end\n{end}")


PARAS = [f"Paragraph {k} of the article has words, commas, and a length that counts for something in the end." for k in range(4)]
BODY = "".join(f"<p>{x}</p>" for x in PARAS)
OPENINGS = [
    "<div class='overflow-hidden rounded'>", "<div class='no-sidebar'>", "<div class='with-comments'>", "<div class='post has-comments'>", "<div id='page' class='hfeed has-header-image'>",
    "<div data-id='nav'>", "<div title='a hidden gem'>", "<div data-role=menu class=wrap>", "<div class='entry-content'>", "<div class='col-md-8 content'>", "<section id='main-content'>", "<article>", "<main>",
    "<main class='site-main has-sidebar'>", "<div class='layout-sidebar-right'>", "<form action='x'><div>", "<div class='td-post-content tagdiv-type'>", "<div id=story class='story comments-enabled'>", "<div>", "<table><tr><td>",
    "<div class='prose alert-free'>", "<center>", "<section class='u-hide-ads'>",
]
BOILERPLATE = [
    "<nav><ul><li><a href='/'>Home, news, and more of the links here</a></li></ul></nav>", "<div class='cookie-notice'><p>We use cookies, all of them, and ask you to accept, please.</p></div>", "<footer><p>All rights reserved, by us, since long ago, and for ever.</p></footer>",
    "<aside><p>Read also, if you like, these other pages, and more.</p></aside>", "<div id='comments'><p>Great article, thanks, all of you, for this one!</p></div>", "<div class='site-footer'><p>Imprint, privacy, and terms of this page, in short.</p></div>",
    "<div style='display: none'><p>Hidden, and not seen by anyone, ever, at all.</p></div>", "<div class='newsletter-signup'><p>Sign up, today, for our letter, and get mail.</p></div>", "<div aria-hidden=true><p>Not for readers, at all, of any page.</p></div>",
    "<ul class='social-share'><li><a href=x>Share this, please</a></li></ul>", "<div role='navigation'><p>One, two, three, four, five, six.</p></div>", "<script>var x = '<p>no, no, no</p>';</script>",
]


def test_layouts():
    """Every opening with every kind of boilerplate before and after it gives the article and nothing else."""
    for opening in OPENINGS:
        names = [x.split()[0].strip("<>") for x in opening.split("><")]
        close = "".join(f"</{x}>" for x in reversed(names))
        for rest in BOILERPLATE:
            for html in (f"<body>{rest}{opening}{BODY}{close}</body>", f"<body>{opening}{BODY}{close}{rest}</body>"):
                assert main_text(html) == "\n".join(PARAS), (opening, rest)


def test_titles_beside_the_container():
    for html in (f"<body><h1>Flood</h1><div>{BODY}</div></body>", f"<body><div><h1>Flood</h1><div class=meta>by me</div><div><div>{BODY}</div></div></div></body>", f"<body><div class=a><h1>Flood</h1></div><article><h1>Flood</h1>{BODY}</article></body>"):
        assert main_text(html) == "\n".join(["Flood", *PARAS]), html


def test_tree_scores_equal_a_plain_scorer():
    """The best container of random trees, scored by walking up from every block."""
    import random
    import xml.etree.ElementTree as ET

    rng = random.Random(4)

    def tree(depth):
        if depth == 0 or rng.random() < 0.3:
            words = ", ".join("word" * rng.randrange(1, 4) for _ in range(rng.randrange(1, 20)))
            return f"<p>{words}</p>" if rng.random() < 0.7 else f"<p><a href='x'>{words}</a> tail</p>"
        return "<div>" + "".join(tree(depth - 1) for _ in range(rng.randrange(1, 4))) + "</div>"

    for _ in range(60):
        html = f"<body>{tree(5)}{tree(4)}</body>"
        root = ET.fromstring(html)
        up = {c: p for p in root.iter() for c in p}
        order = {e: k for k, e in enumerate(root.iter())}
        points, size, linked = {}, {}, {}
        for p in root.iter("p"):
            text, link = "".join(p.itertext()), sum(len(a.text) for a in p.iter("a"))
            score, level, e = (1 if len(text) >= 25 else 0.25) + text.count(",") + min(len(text) / 100, 3), 0, up[p]
            while e is not None:
                if level < 8:
                    points[e] = points.get(e, 0) + score / (1 if level == 0 else 2 if level == 1 else 3 * level)
                e, level = up.get(e), level + 1
            e = p
            while e is not None:
                size[e], linked[e], e = size.get(e, 0) + len(text), linked.get(e, 0) + link, up.get(e)
        best = max(points, key=lambda e: (points[e] * (1 - linked[e] / size[e]), -order[e]))
        got = main_text(html)
        want = ["".join(p.itertext()) for p in best.iter("p")]
        assert points[best] * (1 - linked[best] / size[best]) <= 0 or "\n".join(want) in got
        if best is root:
            assert got == "\n".join(want)


def test_damaged_pages_take_linear_time():
    import time

    for html in ("<a " * 16_000, "<div>" * 8_000 + "<p>some text, here</p>" * 8_000, "<b>" * 16_000 + "x", '<a "' * 16_000, "<script>" + "</script " * 16_000):
        began = time.perf_counter()
        main_text(html)
        assert time.perf_counter() - began < 4


def sentences(n):
    return [f"Paragraph {k} of the article has words, commas, and a length that counts for something in the end." for k in range(n)]


def test_paragraphs_in_wrappers_of_their_own():
    for n in (2, 3, 5, 7, 20):
        for depth in range(5):
            inner = "".join("<div>" * depth + f"<p>{x}</p>" + "</div>" * depth for x in sentences(n))
            for html in (f"<body><div id=c>{inner}</div></body>", f"<body><nav><a href=x>Home</a></nav><div class=page><div id=c>{inner}</div></div><footer>All rights reserved, by us.</footer></body>", f"<body>{inner}</body>"):
                assert main_text(html) == "\n".join(sentences(n)), (n, depth, html[:80])
    blocks = "".join(f"<div class=block><div class=text><p>{x}</p></div></div>" for x in sentences(8))
    assert main_text(f"<body><div class=cms>{blocks}</div></body>") == "\n".join(sentences(8))


def test_threads_longer_than_their_article():
    article = "".join(f"<p>{x}</p>" for x in sentences(3))
    remarks = "".join(f"<div class=c{k}><p>I think, as a reader, that remark number {k} is worth many words, and more of them, and even more.</p></div>" for k in range(20))
    for opening, close in (("<div class='comments-area'>", "</div>"), ("<div class='comments-list'>", "</div>"), ("<section class='user-comments'>", "</section>"), ("<ul class='commentlist'>", "</ul>"), ("<div class='discussion'>", "</div>"), ("<div id=respond>", "</div>"), ("<div id='disqus_thread'>", "</div>")):
        for html in (f"<body><div class=post>{article}</div>{opening}{remarks}{close}</body>", f"<body><article>{article}{opening}{remarks}{close}</article></body>"):
            assert main_text(html) == "\n".join(sentences(3)), (opening, main_text(html)[-80:])
    assert main_text(f"<body><div class='site-comments'>{article}</div></body>") == "\n".join(sentences(3))  # nothing else is there


def test_markup_that_is_cut_off():
    article = "".join(f"<p>{x}</p>" for x in sentences(3))
    for end in ("<!-- hidden remark, and more", "<a href='http://x.example/abc", "</di", "<?php echo 1"):
        assert main_text(f"<body><div>{article}{end}") == "\n".join(sentences(3)), end
    assert main_text(f"<body><div>{article}<p>As 5 < 6, it ends here, with some words").endswith("As 5 < 6, it ends here, with some words")
