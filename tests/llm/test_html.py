import html
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from labwave.llm import html_text
from labwave.llm.queries import op7_html_text

PAGES = T.StructType([T.StructField(c, T.LongType() if c == "page_id" else T.StringType()) for c in ("page_id", "url", "html", "host", "paths", "path")])


def pages(spark, rows):
    return spark.createDataFrame([(*r, "h", "p", "q") for r in rows], PAGES)


def texts(spark, rows):
    return {r.page_id: r.text for r in html_text.main_text(pages(spark, rows)).collect()}


BLOG = """<html><head><title>T</title><style>p{{}}</style></head><body><div id="cookie-notice"><p>We use cookies, a very long notice about cookies
and more cookies</p></div><header><h1>Site name</h1></header><div class="wrap"><div class="post post-{n}"><h2>Head &amp; shoulders</h2>
<p>First   paragraph\n with <b>bold</b> &eacute; and &#8211; dash.<br>Next line</p><ul><li>item one</li><li>item <a href="x">two</a></li></ul>
<p>{body}</p></div><div class="sidebar"><p>{side}</p></div><section class="comments"><p>I disagree with this article, said a reader</p></section></div>
<form><p>Sign up now</p></form><footer>&copy; 2020</footer><script>var x = "<p>no</p>";</script></body></html>"""


def test_blog_template(spark):
    rows = [(i, f"https://Blog.example.com:80/{i}", BLOG.format(n=i, body="Body text that is long enough. " * (1 if i else 20), side="Side " * 60)) for i in range(6)]
    got = texts(spark, rows)
    assert got[1] == "Head & shoulders\nFirst paragraph with bold é and – dash. Next line\nitem one\nitem two\nBody text that is long enough."
    assert html_text.blocks_of(rows[3][2])[0][0].endswith("div.post.post-#")


def test_host_votes_decide(spark):
    """A short page whose largest container is a list of teasers follows its host."""
    page = "<body><div class='text'><p>{}</p></div><div class='teasers'><p>{}</p></div></body>"
    rows = [(i, "http://h.org/a", page.format("story " * 50, "teaser")) for i in range(5)] + [(9, "http://h.org/b", page.format("short story", "teaser " * 50))]
    got = texts(spark, rows)
    assert got[9] == "short story"
    assert texts(spark, [(9, "http://other.org/b", rows[-1][2])])[9].startswith("teaser teaser")


def test_article_header_keeps_its_heading(spark):
    got = texts(spark, [(1, "u", "<body><header>Logo</header><article><header><p>by A. Writer</p><h1>Title</h1></header><p>Text here.</p></article></body>")])
    assert got[1] == "Title\nText here."


def test_headers_and_layout_names(spark):
    page = ("<body class='has-sidebar'><div id='top-header'><p>Logo and slogan</p><h1>Site</h1></div><div class='wrap with-sidebar'>"
            "<div class='post'><div class='post-header'><span>by someone</span><div><h2>Title</h2></div></div><p>Words of the post.</p>"
            "<div class='related-posts'><p>Other posts</p></div></div></div></body>")
    assert texts(spark, [(1, "http://x/", page)])[1] == "Title\nWords of the post."


def test_odd_pages(spark):
    deep = "<div>" * 3000 + "<p>deep</p>"
    long = "<article>" + "<p>word word</p>" * 30_000 + "</article>"
    rows = [(1, None, None), (2, "", ""), (3, "http://[bad", "plain words"), (4, "http://x/", "<p>a<p>b</div></p>c<"), (5, "http://x/", deep),
            (6, "http://y/", long), (6, "http://y/", long), (None, "http://z/", "<article>t &am &amp z</article>"), (8, "http://w/", "<nav>only menu</nav>")]
    out = html_text.main_text(pages(spark, rows))
    assert set(out.columns) == {"page_id", "url", "host", "paths", "path", "text"}
    got = [(r.page_id, r.text) for r in out.collect()]
    assert len(got) == 9
    by = dict(got)
    assert by[1] == by[2] == by[8] == "" and by[3] == "plain words" and by[5] == "deep" and by[6].count("\n") == 29_999
    assert by[4] == "a\nb\nc<" and by[None] == "t &am & z"
    assert html_text.main_text(pages(spark, [])).count() == 0


def test_wrappers_with_boilerplate_names_keep_the_article(spark):
    """A form or name around the article doesn't silence it; names count as a whole."""
    article = "<article><h1>Title</h1><p>Words of the article.</p></article>"
    wrappers = ["<form action='x'>{}</form>", "<div class='content-sidebar-wrap'>{}</div>", "<div class='sidebar-right'>{}</div>",
                "<div class='elementor-widget-container'>{}</div>", "<div class='sidebar'>{}</div>", "<div id='header'>{}</div>",
                "<form><div class='widget'><p>side note</p></div>{}<div class='sidebar'><article>Tease</article></div></form>"]
    rows = [(i, f"http://w{i}.org/", f"<body><p>Skip</p>{w.format(article)}<footer>f</footer></body>") for i, w in enumerate(wrappers)]
    parts = "".join(f"<section {x}><p>Part {k}.</p></section>" for k, x in enumerate(
        ["id='side-effects'", "class='related-work'", "id='discussion'", "id='menu-planning'"]))
    rows.append((50, "http://p.org/", f"<article>{parts}<div class='related-posts'>x</div><section class='comments'>{'no ' * 99}</section></article>"))
    rows.append((51, "http://q.org/", f"<form><div><p>{'long text ' * 30}</p></div></form><div class='menu'>m</div>"))
    got = texts(spark, rows)
    assert {got[i] for i in range(len(wrappers))} == {"Title\nWords of the article."}
    assert got[50] == "Part 0.\nPart 1.\nPart 2.\nPart 3." and got[51] == ("long text " * 30).strip()


def test_pages_without_article_tags_keep_titles_and_leads(spark):
    body = "Words of the text. " * 20
    bodies = ["<div class='post'><h1>Title</h1><div class='entry'><p>{}</p></div><div class='share'>Share</div></div><div class='extra'>Tease</div>",
              "<div class='page'><nav>m</nav><div class='inner'><div class='lead'><p>Title</p></div><div class='body'><p>{}</p></div></div><div class='extra'>Tease</div></div>",
              "<div class='text'><h1>Title</h1><ul><li>{}</li></ul></div><div class='extra'>Tease</div>",
              "<div class='text'><h1>Title</h1><table><tbody><tr><td>{}</td></tr></tbody></table></div>",
              "<div class='hull'><div class='menu'>m</div><h1>Title</h1><div class='a'><div class='b'><p>{}</p></div></div></div>",
              "<h1>Title</h1><div class='entry'><p>{}</p></div><div class='sidebar'>side</div>"]
    rows = [(10 * k + i, f"http://h{k}.org/{i}", f"<html><body>{b.format(body)}</body></html>") for k, b in enumerate(bodies) for i in range(3)]
    got = texts(spark, rows)
    assert {k: t for k, t in got.items() if t != "Title\n" + body.strip()} == {}


def test_votes_of_other_templates_and_pages_without_a_host(spark):
    """A caption under the most voted path doesn't stand for the article under another."""
    a = "<body><div class='news'><p>{0}</p></div><div class='x'>{1}</div></body>"
    b = "<body><div class='blog'><p>{0}</p></div><div class='news'><p>Caption</p></div><div class='x'>{1}</div></body>"
    rows = [(i, "http://h.org/a", a.format("news " * 50, "tease")) for i in range(6)]
    rows += [(10 + i, "http://h.org/b", b.format("blog " * 50, "tease")) for i in range(3)]
    for k in range(25):  # 25 templates of one host, all above with a caption under the first
        c = "<body><div class='t{0}'><p>{1}</p></div><div class='s'><p>Caption</p></div></body>"
        rows += [(100 + 3 * k + i, "http://many.org/", c.format("abcdefghijklmnopqrstuvwxyz"[k], "text " * 50)) for i in range(2)]
        rows += [(102 + 3 * k, "http://many.org/", c.format("abcdefghijklmnopqrstuvwxyz"[k], "short " * 4))]
    rows += [(300 + i, u, a.format("news " * 50, "tease")) for i, u in enumerate([None, "/rel", "x:y", None])]
    rows += [(310, None, "<body><div class='news'>cap</div><div class='own'><p>" + "own " * 50 + "</p></div></body>")]
    got = texts(spark, rows)
    assert {got[i] for i in range(6)} == {got[i] for i in range(300, 304)} == {("news " * 50).strip()}
    assert {got[10 + i] for i in range(3)} == {("blog " * 50).strip()}
    assert {got[102 + 3 * k] for k in range(25)} == {("short " * 4).strip()}
    assert got[310] == ("own " * 50).strip()


LONG = "These are the words of the article, and there are many of them. "


def test_a_voted_path_replaces_the_choice_only_without_loss(spark):
    """Two thirds of a page beside the path that its host votes for stay; what the host leaves out goes."""
    lead, body = LONG * 5, "Another part of the same article, which no other page of this host has. " * 10
    rows = [(i, "http://h.org/a", f"<body><div class='lead'><p>{lead}</p></div></body>") for i in range(5)]
    rows.append((9, "http://h.org/b", f"<body><div class='lead'><p>{lead}</p></div><div class='body'><p>{body}</p></div></body>"))
    rows += [(20 + i, "http://t.org/a", f"<body><div class='text'><p>{LONG * 20}</p></div><div class='teasers'><p>Teaser</p></div></body>") for i in range(5)]
    rows.append((29, "http://t.org/b", f"<body><div class='text'><p>{LONG * 4}</p></div><div class='teasers'><p>{'Teaser of others. ' * 40}</p></div></body>"))
    got = texts(spark, rows)
    assert got[0] == lead.strip() and got[9] == lead.strip() + "\n" + body.strip()
    assert got[29] == (LONG * 4).strip()


def test_elements_without_an_end_do_not_swallow_the_article(spark):
    parts = ["<nav><ul><li><a href='x'>Menu</a></li></ul>", "<footer><a href='x'>Menu</a>", "<menu><a href='x'>Menu</a>",
             "<select><option>One</option>", "<button>", "<nav><button><a href='x'>Menu</a>"]
    bodies = ["<article><h1>Title</h1><p>{}</p></article>", "<div class='post'><h1>Title</h1><p>{}</p></div>"]
    rows = [(10 * k + i, f"http://h{k}x{i}.org/", f"<html><head><title>x</title><body>{p}{b.format(LONG * 3)}") for k, p in enumerate(parts) for i, b in enumerate(bodies)]
    rows += [(100 + k, f"http://c{k}.org/", f"<body>{p}<p>Words.</p></{p[1:].partition('>')[0]}><div class='post'><p>{LONG}</p></div><aside><article>Tease</article></aside>")
             for k, p in enumerate(parts)]
    got = texts(spark, rows)
    assert {k: t for k, t in got.items() if k < 100 and t != "Title\n" + (LONG * 3).strip()} == {}
    assert {t for k, t in got.items() if k >= 100} == {LONG.strip()}


def test_names_inside_an_article(spark):
    """Comments, adverts, sidebars and notices go by the heads of their names; parts of sentences stay where a name fits an article too."""
    gone = ("user-comments reader-comments author-comments comments-wrapper comment-section ad-container ad-wrapper google-ad adsbygoogle left-sidebar "
            "right-sidebar sidebar-left cookie-notice-wrap userComments sponsored-content newsletter-box").split()
    unless = "related-content social-icons share-tools pagination-wrapper related-posts share widget banner".split()
    stay = "banner side post-form login-post story-share ad-story main-side related-work side-effects discussion menu-planning elementor-widget-container".split()
    rows = []
    for k, name in enumerate(gone):
        rows.append((k, f"http://g{k}.org/", f"<article><p>{LONG}</p><section class='{name}'><p>{LONG}</p></section></article>"))
    for k, name in enumerate(unless):
        rows.append((100 + k, f"http://u{k}.org/", f"<article><p>{LONG}</p><div class='{name}'><a href='x'>{LONG}</a><p>Share</p></div></article>"))
    for k, name in enumerate(stay):
        rows.append((200 + k, f"http://s{k}.org/", f"<article><p>{LONG}</p><section class='{name}'><p>{LONG}</p></section></article>"))
    got = texts(spark, rows)
    names = dict(enumerate(gone)) | {100 + k: n for k, n in enumerate(unless)} | {200 + k: n for k, n in enumerate(stay)}
    assert [names[k] for k, t in got.items() if t != LONG.strip() and k < 200] == []
    assert [names[k] for k, t in got.items() if t != LONG.strip() + "\n" + LONG.strip() and k >= 200] == []


def test_doubtful_blocks_that_recur_on_a_host_go(spark):
    page = "<article><p>{0}</p><div class='share'><p>Share this article with all of your friends now.</p></div><p>End {1}.</p></article>"
    rows = [(i, "http://h.org/", page.format(LONG, i)) for i in range(4)] + [(9, "http://one.org/", page.format(LONG, 9))]
    got = texts(spark, rows)
    assert got[0] == f"{LONG.strip()}\nEnd 0." and "friends" in got[9]


def test_long_odd_pages_take_linear_time():
    marks = ["<div>", "<div class='a'>text ", "<nav>", "<button>x", "<!--", "<a ", "<a href=\"", "</", "<?", "&", "<select><div>"]
    pages = [m * 40_000 for m in marks] + [m * 40_000 + ">end" for m in marks] + ["<div>" * 40_000 + "</section>" * 40_000]
    for page in pages:
        start = time.process_time()
        keys, sides, best, doubts, body = html_text.parsed(page)
        html_text.extract(body, best, None, None)
        assert time.process_time() - start < 10, page[:20]


@given(st.lists(st.tuples(st.integers(0, 8), st.integers(0, 50)), min_size=1, max_size=9), st.data())
@settings(max_examples=300, deadline=None)
def test_choice_against_brute_force(tree, data):
    """A path wins by votes among those without which little of the own choice's text is lost, dismissed parts aside."""
    up = [-1] + [min(p, i) for i, (p, _) in enumerate(tree[1:])]
    own = [n for _, n in tree]
    best = data.draw(st.integers(0, len(up) - 1))
    paths = [{"number": i, "votes": data.draw(st.integers(0, 3)), "left": data.draw(st.integers(-1, 3))} for i in range(len(up)) if data.draw(st.booleans())]

    def chain(i):
        return [] if i < 0 else [i, *chain(up[i])]

    gone = {p["number"] for p in paths if p["left"] >= html_text.DISMISSED}
    whole = sum(n for i, n in enumerate(own) if best in chain(i))
    fit = []
    for p in paths:
        lost = sum(n for i, n in enumerate(own) if best in chain(i) and p["number"] not in chain(i) and not gone & set(chain(i)))
        if p["votes"] and lost <= html_text.LOST * whole:
            fit.append((-p["votes"], -sum(n for i, n in enumerate(own) if p["number"] in chain(i)), p["number"]))
    assert html_text.chosen(up, own, best, paths) == (min(fit)[2] if fit else best)


def test_query_equals_the_articles(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.page_id: r for r in op7_html_text(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?(b|br)>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        want = "\n".join(b for b in blocks if b)
        assert (got[r.page_id].url, got[r.page_id].text, got[r.page_id].n_chars) == (r.url, want, len(want))
