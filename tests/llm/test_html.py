import random
import time

from inkwell.llm import html

SITE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar">
<header class="site-header"><a href="/">Home</a> Site name</header>
<nav><ul><li><a href="/a">A</a></li></ul></nav>
<div class="cookie-notice">We use cookies. Accept them all, please, they are very good cookies indeed.</div>
<div id="wrap-%d"><div class="post-content p%d"><h1>Title &amp; more</h1><div class="share-buttons">Share this</div>
<p>First   <b>bold</b>&nbsp;text&eacute;.<p>Second<br>line <a href="#">linked</a>.
<ul><li>one<li>two</ul><blockquote>Quoted.</blockquote><table><tr><td>a</td><td>b</td></tr></table>
<form><input name=q><p>Subscribe to our letter</p></form><script>var x = "<p>no</p>";</script></div>
<aside class="sidebar"><p>Popular posts and a long list of other things that one could read here.</p></aside></div>
<section id="comments"><h2>Comments</h2><article class="comment"><p>A reader says a great many words here, far more than the article itself has, on and on and on and on and on.</p></article></section>
<footer>(c) site</footer></body></html>"""
WANT = "Title & more\n\nFirst bold texté.\n\nSecond line linked.\n\none\n\ntwo\n\nQuoted.\n\na\n\nb"


def test_article_of_a_site_without_article_elements(spark):
    pages = [(i, f"https://Host.example/{i}", SITE % (i, i * 7), 1) for i in range(5)]
    out = html.main_text(spark.createDataFrame(pages, "page_id long, url string, html string, text int")).collect()
    assert len(out) == 5 and {r.text for r in out} == {WANT}
    paths = html.host_paths(spark.createDataFrame(pages, "page_id long, url string, html string, host int")).collect()
    assert [(r.host, r.path, r.votes) for r in paths] == [("host.example", "div>div.p#.post-content", 5)]


def test_consensus_overrides_one_page_and_a_page_without_the_path_falls_back():
    long = "<p>" + "words " * 60 + "</p>"
    odd = f"<body><div class=main><p>Short.</p></div><div class=other>{long}</div></body>"
    assert html.extract(odd, "div.main") == "Short."
    assert html.extract(odd, "div.none").startswith("words")
    assert html.extract(odd, None).startswith("words")


def test_header_of_an_article_keeps_its_heading():
    page = "<body><header><h1>Site</h1></header><article><header><h1>Head</h1></header><p>Body text.</p><footer>By x</footer></article></body>"
    assert html.extract(page, "article") == "Head\n\nBody text."


def test_malformed_empty_and_deep_pages(spark):
    rows = [(1, None, "<p>a"), (2, "http://h/1", None), (3, "http://h/2", ""), (4, "not a url", "plain text only"), (4, "not a url", "plain text only"), (5, "http://h/3", "<div>" * 5000 + "deep" + "</div>" * 5000), (None, "http://h/4", "<p><b>x<br><p>y</div></b> &lt;z&gt; &#x41;&bogus;"), (6, "http://h/5", "<!-- never closed <p>x</p>"), (7, "http://h/6", "<script>only"), (8, "h", "<b>" * 20000 + "bold")]
    out = sorted((str(r.page_id), r.text) for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert out == sorted([("1", "a"), ("2", ""), ("3", ""), ("4", "plain text only"), ("4", "plain text only"), ("5", "deep"), ("None", "x\n\ny <z> A&bogus;"), ("6", ""), ("7", ""), ("8", "bold")])
    assert html.main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_a_large_table_of_paths_is_joined_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(html, "BROADCAST_BYTES", -1)
    pages = [(i, "https://host.example/", SITE % (i, i)) for i in range(3)]
    assert {r.text for r in html.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()} == {WANT}


def test_a_title_above_the_text_belongs_to_the_article():
    text = "<p>" + "word " * 100 + "</p>"
    page = f"<body><div class=post><h1>Title</h1><div class=entry>{text}{text}</div></div><div class=related>{text}</div></body>"
    assert html.vote(page)[0] == "div.post" and html.extract(page, None).startswith("Title\n\nword")


def test_parts_that_are_not_the_article():
    text = "<p>" + "word " * 40 + "</p>"
    inside = "".join(f'<div {a}><p>unwanted text</p></div>' for a in ('class="site-header"', 'id="header"', 'class="alert alert-info"', 'class="ad-slot"', 'id="disqus_thread"', 'class="adsbygoogle"', 'class="userComments"', 'role="search"', 'style="display:none"', "hidden"))
    page = f'<body><div class="container with-sidebar"><div class="content"><div class="entry-header"><h1>Title</h1></div>{inside}{text}<ol class="commentlist"><li>unwanted</li></ol></div><div class="sidebar">{text}</div></div></body>'
    assert html.extract(page, None) == "Title\n\n" + ("word " * 40).strip()


def test_an_element_around_the_whole_page_is_not_left_out():
    text = "<p>" + "word " * 60 + "</p>"
    side = '<div class="sidebar"><p>Popular posts of other days.</p></div>'
    want = "Title\n\n" + ("word " * 60).strip()
    for wrapper in ('form id="aspnetForm"', 'div class="layout sidebar-right"', 'div class="two-column-sidebar"', 'div id="page-nav-top"'):
        page = f'<body><{wrapper}><div class="post"><h1>Title</h1>{text}<form><p>Subscribe to our letter</p></form></div>{side}</{wrapper.split()[0]}></body>'
        assert html.extract(page, None) == want, wrapper
        assert html.vote(page) is not None, wrapper
        assert html.extract(page, html.vote(page)[0]) == want, wrapper
    nested = f'<body><form id="f"><div class="layout sidebar-right"><div class="post"><h1>Title</h1>{text}</div>{side}</div></form><div>Site name</div></body>'
    assert html.extract(nested, None) == want


def test_a_page_without_anything_left_is_read_without_class_and_form_filters():
    text = "<p>" + "word " * 60 + "</p>"
    assert html.extract(f'<body><div class="popup-open modal">{text}</div><nav>Menu of the site</nav></body>', None) == ("word " * 60).strip()
    assert html.extract("<body><nav>Menu of the site</nav><div hidden>secret</div></body>", None) == ""


def test_comments_stay_out_however_long():
    text = "<p>" + "word " * 100 + "</p>"
    page = f'<body><div class="post"><h1>Title</h1><p>A short text.</p></div><div id="comments">{text}{text}</div></body>'
    assert html.extract(page, None) == "Title\n\nA short text."


def _plain_tokens(page):
    """The same tokens, sign by sign."""
    blank, out, i, n = " \t\n\r\f", [], 0, len(page)

    def text(t):
        if out and out[-1][0] == "text":
            t = out.pop()[1] + t
        out.append(("text", t, {}, False))

    while i < n:
        if page[i] != "<":
            text(page[i])
            i += 1
            continue
        closing = page[i + 1 : i + 2] == "/"
        j = i + 1 + closing
        if j < n and page[j] in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":
            name = ""
            while j < n and page[j] not in blank + "/>":
                name += page[j]
                j += 1
            attributes, bare = {}, None
            while True:
                while j < n and page[j] in blank + "/":
                    j += 1
                if j >= n:
                    return out
                if page[j] == ">":
                    break
                key, value = page[j], ""
                j += 1
                while j < n and page[j] not in blank + "/>=":
                    key += page[j]
                    j += 1
                k = j
                while k < n and page[k] in blank:
                    k += 1
                if k < n and page[k] == "=":
                    k += 1
                    while k < n and page[k] in blank:
                        k += 1
                    j = k
                    if j < n and page[j] in "\"'":
                        rest = page[j + 1 :]
                        if page[j] in rest:
                            value = rest[: rest.index(page[j])]
                            j += len(value) + 2
                        elif ">" in rest:
                            value = rest[: rest.index(">")]
                            j += len(value) + 1
                        else:
                            return out
                    else:
                        while j < n and page[j] not in blank + ">":
                            value += page[j]
                            j += 1
                        bare = j
                attributes.setdefault(key.lower(), value)
            alone, name = page[j - 1] == "/" and j != bare, name.lower()
            i = j + 1
            if not closing and not alone and name in {*html._RAW, "svg", "math"}:
                tail = "".join(c.lower() if c.isascii() else c for c in page[i:])
                ends = [k for k in range(len(tail)) if tail.startswith("</" + name, k) and tail[k + len(name) + 2 : k + len(name) + 3] in [*blank, "/", ">"]]
                if not ends:
                    alone = name not in ("script", "style")
                elif name in html._RAW:
                    i += ends[0]
                if not ends and not alone:
                    return out
            out.append(("end" if closing else "start", name, attributes, alone))
        elif page[i + 1 : i + 4] == "!--":
            rest = page[i + 4 :]
            if rest[:1] == ">" or rest[:2] == "->":
                i += 4 + rest.index(">") + 1
                continue
            ends = [rest.index(e) + len(e) for e in ("-->", "--!>") if e in rest]
            if not ends:
                return out
            i += 4 + min(ends)
        elif page[i + 1 : i + 2] in ("!", "?", "/"):
            if ">" not in page[i:]:
                return out
            i = page.index(">", i) + 1
        else:
            text("<")
            i += 1
    return out


def test_tokens_equal_a_plain_reader_on_random_pages():
    rng = random.Random(11)
    bits = ["<", "</", ">", "/>", "<p", "<div class=", "<script>", "</script>", "</SCRIPT x", "<!--", "-->", "--!>", "<!-->", "<?x", '"', "'", "=", " ", "\n", "a", "İ", "title", "<title>", "</title >", "text", "<svg>", "</svg>", "<math", "<iframe ", "&amp;", "<b/>", "x=y", 'id="q"', "/"]
    for _ in range(4000):
        page = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 25)))
        got = []
        for token in html.tokens(page):
            if token[0] == "text" and got and got[-1][0] == "text":
                token = ("text", got.pop()[1] + token[1], {}, False)
            got.append(token)
        assert got == _plain_tokens(page), page


def test_letters_that_grow_when_lowered_lose_nothing():
    text = "İstanbul " * 20
    page = f"<body><article><p>{text}</p><script>if (a < b) x();</script><p>Next paragraph.</p><style>İ</style><p>Last one.</p></article></body>"
    assert html.extract(page, None) == f"{text.strip()}\n\nNext paragraph.\n\nLast one."


def test_unclosed_tags_and_quotes_take_linear_time():
    for page in ("<i a " * 200_000, "<i a='" * 100_000, "<i a=\"'>x" * 50_000, "<!-- " * 200_000, "<script>" * 100_000, "</" * 200_000, "<p>" * 50_000, "<a href='x>y" * 50_001):
        began = time.perf_counter()
        list(html.tokens(page))
        assert time.perf_counter() - began < 3, page[:20]
    assert html.extract('<body><article><p>One <a href="x>two</a> three.</p><p>Four words stand here.</p></article></body>', None) == "One two three.\n\nFour words stand here."


def test_nothing_behind_icons_and_unfinished_elements_is_lost():
    inside = {
        '<svg class="i"/>': "", "<svg class=i/ ><path d='M0'/></svg>": "", "<svg><path d='M0'/><title>x</title><text>t</text></svg>": "", "<svg class=i>": "", "<math/>": "", "<script src='a.js'/>": "",
        "<iframe src=x/>": "", "<iframe src=x>": "", "<textarea>": "", "<template/>": "", "<noscript>": "", "<title>": "", "<script src=/a/>var x = '<p>';</script>": "", "<svg><p>In": "In\n\n", "<math><mi>x</mi><mo>=</mo><mn>1</mn></math>": "x=1",
        "<math><semantics><mi>y</mi><annotation encoding='tex'>\\y</annotation></semantics></math>": "y", "<svg><foreignObject><p>no</p></foreignObject></svg>": "",
    }
    for mark, text in inside.items():
        page = f"<body><nav><p>menu</p></nav><article><p>First <b>one</b>.</p>{mark}<p>Second {mark} two.</p></article></body>"
        got = html.extract(page, None)
        assert got.startswith("First one.") and got.endswith("two."), (mark, got)
        assert "".join(got.split()) == "".join(f"First one. {text} Second {text} two.".split()), (mark, got)


def _random_article(rng, depth=0):
    """Markup of an article and the blocks that it must give, made together."""
    word = lambda: rng.choice(["alpha", "beta", "gamma &amp; delta", "ünï", "x &lt; y", "omega"])
    plain = {"gamma &amp; delta": "gamma & delta", "x &lt; y": "x < y"}

    def inline(d=0):
        kind = rng.randrange(9)
        if kind == 0 and d < 3:
            inner, text = inline(d + 1)
            tag = rng.choice(["b", "i", "span", "em", "code"])
            return f"<{tag} class='c{rng.randrange(9)}'>{inner}</{tag}>", text
        if kind == 1:
            return rng.choice(["<svg class='icon'/>", "<svg><path d='M 0 1'/></svg>", "<img src=a.png>", "<!-- <p>no</p> -->", "<script>if (a<b) '</p>'</script>", "<style>p{}</style>", "<button>Click</button>", "<iframe src=a/>"]), ""
        if kind == 2:
            return "<br>", " "
        w = word()
        return w + rng.choice([" ", "\n", "\t "]), plain.get(w, w) + " "

    def line():
        made = [inline() for _ in range(rng.randint(2, 9))]
        return "".join(m for m, _ in made), " ".join("".join(t for _, t in made).split())

    def block(d):
        kind = rng.randrange(8)
        if kind < 4:
            markup, text = line()
            return f"<p>{markup}" + rng.choice(["</p>", "", "</p>\n"]), [text]
        if kind == 4:
            items = [line() for _ in range(rng.randint(1, 3))]
            return "<ul>" + "".join(f"<li>{m}" + rng.choice(["</li>", ""]) for m, _ in items) + "</ul>", [t for _, t in items]
        if kind == 5:
            return rng.choice(["<nav><p>menu words</p></nav>", "<aside>Other things</aside>", "<div class='share-links'>Share</div>", "<div class=newsletter><p>Sign</p></div>", "<form><input name=q></form>", "<footer>By them</footer>", "<div class='ad slot'><p>Buy</p></div>"]), []
        if kind == 6 and d < 3:
            made = [block(d + 1) for _ in range(rng.randint(1, 3))]
            return f"<div class='w{rng.randrange(99)}'>" + "".join(m for m, _ in made) + "</div>", [t for _, ts in made for t in ts]
        markup, text = line()
        return f"<h2>{markup}</h2>", [text]

    made = [block(0) for _ in range(rng.randint(4, 12))]
    return "".join(m for m, _ in made), [t for _, ts in made for t in ts if t]


def test_random_articles_give_all_their_blocks_and_no_others():
    rng = random.Random(12)
    for i in range(400):
        markup, want = _random_article(rng)
        tag = rng.choice(["article", "main"])
        page = f"<html><head><title>T</title></head><body><header><h1>Site</h1></header><nav><a href=/>Home</a></nav><{tag}>{markup}</{tag}><section id=comments><p>A comment</p></section><footer>(c)</footer></body></html>"
        assert html.extract(page, tag) == "\n\n".join(want) or not want, (i, page)


def test_time_grows_with_the_page_not_with_its_depth():
    deep = "<div>" * 250 + "".join(f"<p>some words {i}</p>" for i in range(8000)) + "</div>" * 250
    nested = "<div>" * 8000 + "deep" + "</div>" * 8000
    beside = "".join(f"<div class=sidebar><article><p>{i}</p></article>" for i in range(250)) + "</div>" * 250
    for page in (deep, nested, beside):
        began = time.process_time()
        assert html.extract(page, None)
        assert time.process_time() - began < 2


def test_a_kept_column_must_not_have_the_results_name(spark):
    import pytest

    with pytest.raises(ValueError):
        html.main_text(spark.createDataFrame([(1, "u", "x", "y")], "page_id long, url string, html string, Text string"), keep=("page_id", "Text"))
