import pytest
from pyspark.sql import functions as F

from earshot.llm.html_text import extracted, main_text

LONG = "Here is a sentence of the article that is long enough to stand out from its surroundings, as main text does."


@pytest.mark.parametrize(
    "page,want",
    [
        (None, ""),
        ("", ""),
        ("no markup at all", "no markup at all"),
        (f"<p>{LONG}</p>", LONG),
        (f"<nav><a href=x>Home</a></nav><article><h1>T</h1><p>{LONG}<p>a &amp; b&nbsp;&lt;c&gt; <b>d</b>e</article><footer>x</footer>", f"T {LONG} a & b <c> de"),
        (f"<header>Site</header><main><p>{LONG}</p><div class='ad-box'>Buy</div><p>End.</p></main><aside>Side</aside>", f"{LONG} End."),
        (f"<div id=sidebar>s</div><div class='post'><p>{LONG}</p><p>Short.</p></div><div class='comments'><p>{LONG} says a reader</p></div>", f"{LONG} Short."),
        (f"<article><p>{LONG}</p><section class=comments><article class=comment><p>nice {LONG}</p></article></section></article>", LONG),
        (f"<div class='cookie-notice'>We use cookies</div><p>{LONG}</p><form><p>Name</p><input name=q></form>", LONG),
        (f"<script>var t='</p><p>{LONG}';</script><style>p{{}}</style><p>{LONG}</p><!-- <p>{LONG}</p> -->", LONG),
        (f"<p>{LONG} 1 < 2 and 3 > 2</p>", f"{LONG} 1 < 2 and 3 > 2"),
        (f"<article><p>{LONG}</p><nav>open <p>more", LONG),
        (f"<article><nav>unclosed</article><p>{LONG}</p>", LONG),
        (f"<p title=\"a>b\">{LONG}</p><p hidden>no</p>", LONG),
        (f"<article><p>{LONG}</p><p>x<br>y\n\t z</p></article>", f"{LONG} x y z"),
        (f"<article><p>{LONG}</p></article><article><p>{LONG} 2</p></article>", f"{LONG} {LONG} 2"),
        ("<article><h1>Tiny.</h1><p>A.</p></article><footer>&copy; long line of a footer with many words in it</footer>", "Tiny. A."),
    ],
)
def test_pages(page, want):
    assert main_text(page) == want


def test_short_lines_apart_from_the_text_are_left(spark):
    page = f"<div><a href=1>One</a></div><div><a href=2>Two</a></div><div></div><div></div><div></div><div></div><div></div><div><p>{LONG}</p><p>No.</p><p>{LONG}</p></div><div></div><div></div><div></div><div></div><div></div><div></div><div></div><div>Imprint</div>"
    assert main_text(page) == f"{LONG} No. {LONG}"


def test_rows_and_other_columns(spark):
    df = spark.createDataFrame([(1, "u", f"<p>{LONG}</p>"), (1, "u", f"<p>{LONG}</p>"), (None, None, None)], "page_id long, url string, html string")
    got = extracted(df.withColumn("text", F.lit(7)).withColumn("__x", F.lit("y")))
    assert got.columns == ["page_id", "url", "__x", "text", "n_chars"]
    assert sorted((r["text"], r["n_chars"]) for r in got.collect()) == [("", 0), (LONG, len(LONG)), (LONG, len(LONG))]
    assert extracted(df.limit(0)).count() == 0


def test_hostile_pages_end_soon():
    for page in ("<a " * 20_000, '<a "' * 20_000, "<" * 50_000, "<nav>" * 20_000, "<!--" * 20_000, "<script>" * 5_000):
        main_text(page)


@pytest.mark.parametrize("tail", ["<p><a href=x>Read the source.</a></p>", "<p><a href=x>A link.</a></p><p>Short end.</p>"])
def test_links_within_an_article_are_kept(tail):
    text = main_text(f"<nav><a href=y>Home</a></nav><article><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p><p><a href=a>One.</a></p><p><a href=b>Two.</a></p><p><a href=c>Three.</a></p>{tail}</article>")
    assert text.startswith(f"{LONG} {LONG} {LONG} One. Two. Three.") and text.endswith(("Three. Read the source.", "Three. A link. Short end.")) and "Home" not in text


BODY = f"<h1>Title</h1><p>{LONG}</p><p>{LONG} Again.</p>"
KEPT = f"Title {LONG} {LONG} Again."


@pytest.mark.parametrize(
    "page",
    [
        f"<div class='layout has-sidebar'><article>{BODY}</article></div>",
        f"<div id=page class='navbar-fixed'><main>{BODY}</main></div>",
        f"<form id=aspnetForm><article>{BODY}</article></form>",
        f"<form id=aspnetForm><div class=nav><a href=x>Home</a></div><div>{BODY}</div></form>",
        f"<div class='sidebar'><div class='content'>{BODY}</div></div>",
        f"<div class='widget'><article>{BODY}</article></div><div class='widget'><p>More</p></div>",
        f"<div role=form>{BODY}</div>",
        f"<article class='post share'>{BODY}</article><p>Copyright and so on</p>",
        f"<div class='cookie-consent'><p>{LONG[:40]}</p></div><div class='post'>{BODY}</div>",
        f"<div class='site-header'><div class='top-bar menu'><a href=a>A</a></div></div><div id=story>{BODY}</div>",
        f"<div class=post>{BODY}</div><div id=comments><div class=comment><p>{LONG[:50]}</p></div></div>",
        f"<article>{BODY}</article><section class=comments><article><p>{LONG[:50]}</p></article></section>",
        f"<div class=page>{BODY}<ul class='share-buttons'><li><a href=a>Share</a></li></ul></div>",
        f"<table><tr><td class=menu><a href=a>A</a></td><td>{BODY}</td></tr></table>",
        f"<div>{BODY}</div><div class='newsletter-signup'><p>Sign up here, please do.</p><form><input></form></div>",
        f"<header class=masthead><h2>Paper</h2></header><div>{BODY}</div>",
        f"<div>{BODY}</div><footer><p>{LONG}</p></footer>",
        f"<div>{BODY}</div><div class='related posts'><a href=a>{LONG}</a></div>",
        f"<body class='single page-with-navbar'><div>{BODY}</div></body>",
        f"<div class=breadcrumbs><a href=a>a</a></div><section>{BODY}</section>",
        f"<main>{BODY}</main><div>Imprint</div>",
    ],
)
def test_templates(page):
    assert main_text(page) == KEPT


def test_parts_of_an_article_with_telling_names():
    page = f"<article>{BODY}<section class='related-work'><p>{LONG} Related.</p></section><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li><li><a href=3>Three</a></li><li><a href=4>Four</a></li><li><a href=5>Five</a></li></ul></article>"
    assert main_text(page) == f"{KEPT} {LONG} Related. One Two Three Four Five"
    assert main_text(f"<article class=teaser><p>Read on</p></article><div>{BODY}</div>") == f"Read on {KEPT}"


def test_line_blocks_decide_where_no_name_does():
    """Against the rule by hand: windows of three lines, lengths outside links, kept from a surge to the next empty window."""
    far = "<div></div>" * 10
    page = f"<div><a href=1>{LONG}</a></div>{far}<div>Short words here</div>{far}<div><p>{LONG}</p><p>Tiny.</p><p>{LONG}</p></div>{far}<div><a href=2>{LONG}</a></div>{far}<div>Also short</div>"
    assert main_text(page) == f"{LONG} Tiny. {LONG}"


def test_very_long_page(spark):
    page = "<article>" + "".join(f"<p>{LONG} {k}</p>" for k in range(20_000)) + "</article>"
    assert main_text(page) == " ".join(f"{LONG} {k}" for k in range(20_000))
