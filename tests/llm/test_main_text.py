"""Extraction on pages whose article is known."""

from placewright.llm import main_text as M
from placewright.llm.main_text import extract, main_text

P1 = "The first paragraph, which is long enough, tells of a house, a road and a bridge that was built in 1890."
P2 = "The second one has &lt;signs&gt; &amp; references&nbsp;like &#8212; and &eacute;, over\n   two lines, with a <a href='/x'>link</a> inside."
P2_TEXT = "The second one has <signs> & references like — and é, over two lines, with a link inside."
LINKS = "".join(f"<li><a href='/{i}'>Item {i}, more, and more of it</a></li>" for i in range(30))


def page(body: str) -> str:
    return f"<!doctype html><html><head><title>T</title><style>p{{}}</style><script>if (a<b) document.write('<p>no, no, no, never, ever</p>')</script></head><body>{body}</body></html>"


def test_article_without_the_rest():
    body = f"""<header><h1>Site</h1></header><nav><ul>{LINKS}</ul></nav><div class="cookie-notice"><p>We use cookies, as all do, and more.</p></div>
    <div id="wrap"><div class="content"><h2>Title of it</h2><p>{P1}<p>{P2}</p><!-- <p>gone, gone, gone, gone</p> --><ul><li>one<li>two</ul><div class="ad"><p>Buy, buy, buy this now, it is cheap, and good.</p></div>
    <form><p>Your name, your mail, your wish, and all of that:</p><input></form><p>Short.</p></div><aside><p>Other, and other, things that stand aside here.</p></aside></div>
    <div class="comments"><p>I think, as a reader, that this is great, really, really great and long.</p></div><footer><p>&copy; Site, all rights, reserved, and so on.</p></footer>"""
    assert main_text(page(body)) == f"Title of it\n{P1}\n{P2_TEXT}\none\ntwo\nShort."


def test_siblings_and_lists_of_links():
    body = f"<div><p>{P1}</p><p>{P1}</p></div><div><p>{P2}</p><p>{P1}</p></div><div><ul>{LINKS}</ul></div>"
    assert main_text(page(body)) == f"{P1}\n{P1}\n{P2_TEXT}\n{P1}"


def test_broken_markup():
    assert main_text("<article><h1>A</h1><p>" + P1 + "<p>b<br>c</div></i> d") == f"A\n{P1}\nb c d"
    assert main_text(f"<body><div><p>{P1}</p><p>x < y and <b>bold, <i>both</b></p></div><!-- never ends <p>{P1}</p>") == f"{P1}\nx < y and bold, both"
    assert main_text(f"<div><p>{P1}</p><p title=\"a>b\" class='x'>in</p><p broken\" >out</p></div>") == f"{P1}\nin\nout"
    assert main_text("") == main_text("<<<>>") [:0] == ""
    deep = "<div>" * 3000 + P1 + "</div>" * 3000
    assert main_text(deep) == P1


def test_rows(spark):
    rows = [(1, "u", None, "clash"), (2, None, "", "x"), (3, "u", page(f"<article><p>{P1}</p></article>"), "x"), (3, "u", page(f"<article><p>{P1}</p></article>"), "x"), (4, "v", page("<article>" + f"<p>{P1}</p>" * 5000 + "</article>"), "x")]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in extract(docs).collect() if r["page_id"] != 2)
    assert got[0] == (1, "u", "", 0) and got[1] == got[2] == (3, "u", P1, len(P1)) and got[3][3] == 5000 * (len(P1) + 1) - 1
    assert extract(docs.limit(0)).count() == 0


def labelled_pages(n, seed=3):
    """Pages with the text that should be left, made of parts that sites put around and into articles."""
    import random

    rng = random.Random(seed)
    word = lambda: rng.choice("the river was seen by many people who came from old towns and then they spoke, at length, of what had been".split()).strip()
    sentence = lambda k: (" ".join(word() for _ in range(k)).capitalize() + ".").replace(",.", ".")
    inside = ["post-comments", "entry-comments", "article-sidebar", "main-nav", "content-ads", "story-promo", "post-footer", "sidebar-content", "related-posts", "share-buttons", "newsletter-box"]
    kept = ["notice-board", "social-history", "entry-content", "post-body", "text"]
    for _ in range(n):
        title, blocks = sentence(5)[:-1], [sentence(rng.randint(20, 60)) for _ in range(rng.randint(3, 8))]
        noise = lambda: f'<div class="{rng.choice(inside)}"><p>{sentence(rng.randint(12, 40))}</p></div>'
        body = "".join(f"<p>{b}</p>" + (noise() if rng.random() < 0.3 else "") for b in blocks)
        shape = rng.randrange(3)
        if shape == 0:
            article = f'<article><header class="entry-header"><h1>{title}</h1></header><div class="{rng.choice(kept)}">{body}</div></article>'
        elif shape == 1:
            article = f'<div id="content"><h1>{title}</h1><div class="{rng.choice(kept)}">{body}</div></div>'
        else:
            article = f'<main><h1>{title}</h1>{body}</main>'
        links = "".join(f'<li><a href="/{i}">{word()} {word()}</a></li>' for i in range(6))
        page = f'<html><head><title>{title}</title><style>p{{}}</style></head><body><header id="site-header"><a href="/">Home</a></header><nav><ul>{links}</ul></nav>{noise() if rng.random() < 0.5 else ""}{article}<aside><p>{sentence(30)}</p></aside><footer><p>{sentence(25)}</p></footer></body></html>'
        yield page, "\n".join([title, *blocks])


def test_labelled_pages():
    pages = list(labelled_pages(240))
    right = [M.main_text(page) == want for page, want in pages]
    assert sum(right) >= 0.98 * len(pages)


def test_names_tell_by_their_last_part():
    for name in ("post-comments", "entry-comments", "article-sidebar", "main-nav", "content-ads", "story-promo", "post-footer", "sidebar-content", "adBox", "cookie-banner", "nav-links"):
        assert M.boilerplate(name), name
    for name in ("notice-board", "social-history", "entry-header", "article-body", "post-content", "uploads", "header-image", ""):
        assert not M.boilerplate(name), name


def test_a_page_that_names_would_leave_empty():
    assert M.main_text('<body><div class="notice"><p>The whole page is one notice, and nothing else is there to be read.</p></div></body>').startswith("The whole page")


def test_extra_columns_and_repeated_rows(spark):
    rows = [(1, "u", "<p>Some text that is long enough to be scored here.</p>", "x", 9)] * 2 + [(None, None, None, None, None)]
    got = M.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in got) == [(0, 0), (1, 48), (1, 48)]


def test_an_article_in_a_form_stays():
    form = f'<form id="aspnetForm"><input type="hidden" value="x"><div><h1>Title</h1><p>{P1}</p><p>{P1}</p><p>{P1}</p></div><input name="q"></form>'
    assert main_text(page(form)) == f"Title\n{P1}\n{P1}\n{P1}"
    assert main_text(page(f'<div><h1>Title</h1><p>{P1}</p></div><form><p>Write to us, with your name, and what you think of it all.</p><input><textarea></textarea><select></select></form>')) == f"Title\n{P1}"
    assert main_text(page(f'<form><nav><a href="/">{P1}</a></nav><main><h1>Title</h1><p>{P1}</p></main><p>Not, ever, a, short, aside.</p><input></form>')).startswith(f"Title\n{P1}")


def test_names_never_cost_the_article():
    comment = "<div class='comments'>" + "".join(f"<p>I think, as reader {i}, that this is great, really, really great and long.</p>" for i in range(3)) + "</div>"
    for name in ("with-sidebar content", "comments-policy-article", "has-sidebar", "no-comments main", "widget", "ad"):
        assert main_text(page(f'<div class="{name}"><h1>Title</h1><p>{P1}</p><p>{P1}</p><p>{P1}</p></div>{comment}')) == f"Title\n{P1}\n{P1}\n{P1}", name
    # Readers may have said more than the article.
    assert main_text(page(f"<div><h1>Title</h1><p>{P1}</p></div>" + comment * 9)) == f"Title\n{P1}"


def test_headlines_in_headers_stay():
    assert main_text(page(f"<header><h1>Site</h1></header><main><header><h1>Title</h1></header><div><p>{P1}</p><p>{P1}</p></div></main>")) == f"Title\n{P1}\n{P1}"
    assert main_text(page(f'<div id="post"><header class="entry-header"><h1>Title</h1></header><div><p>{P1}</p><p>{P1}</p></div></div>')) == f"Title\n{P1}\n{P1}"


def test_comments_by_other_names_go():
    for name in ("comment-thread", "responses", "reader-feedback", "comment-area"):
        assert main_text(page(f'<article><h1>Title</h1><p>{P1}</p></article><div class="{name}"><p>{P1}</p><p>{P1}</p></div>')) == f"Title\n{P1}", name
