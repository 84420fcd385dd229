"""Main text of whole pages: names that only look like furniture, edges, nesting, and the defined cases of the table."""

import time

import pytest
from pyspark.sql import Row

from veridiff.llm import html_extraction

LONG = "This is a long paragraph with many words in it, of which the article consists. " * 3
TEXT = LONG.strip()


@pytest.mark.parametrize(
    "html, want",
    [
        (f'<div class="content with-sidebar"><p>{LONG}</p><p>{LONG}</p></div>', [TEXT, TEXT]),
        (f'<div id="main" class="no-comments layout"><p>{LONG}</p></div>', [TEXT]),
        (f'<div class="search-engine-guide"><p>{LONG}</p></div>', [TEXT]),
        (f'<section class="alert-fatigue"><p>{LONG}</p></section>', [TEXT]),
        (f"<h1>Title of page</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p><p>The end.</p>", ["Title of page", TEXT, "Short.", TEXT, "The end."]),
        (f'<div class="site-header">Site</div><ul><li><a href="/">one</a><li><a href="/">two</a></ul><div><h1>T</h1><p>{LONG}<p>{LONG}</div><div class="comment-list"><p>{LONG * 9}</div><p>© 2024 me</p>', ["T", TEXT, TEXT]),
        (f'<nav>a</nav><article><header><h1>T &amp; T</h1></header><p>{LONG}<br>more\n text</p><div class="ad">buy</div><form>x</form></article><aside>b</aside><footer>c</footer>', ["T & T", TEXT + " more text"]),
        (f'<div class="widget"><p>{LONG}</p></div>', [TEXT]),
        ("<script>var a = 1;</script><style>p {}</style>", []),
    ],
)
def test_pages(html, want):
    assert html_extraction.extract(html) == "\n".join(want)


def test_table(spark):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, "v", "<p>a  b</p>", "x"), (3, "w", f"<p>{LONG}</p>", "y"), (3, "w", f"<p>{LONG}</p>", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(map(tuple, html_extraction.main_text(pages).collect()), key=str)
    assert got == sorted([(1, "u", "", 0), (2, None, "", 0), (None, "v", "a b", 3), (3, "w", TEXT, len(TEXT)), (3, "w", TEXT, len(TEXT))], key=str)
    assert html_extraction.main_text(pages.limit(0)).count() == 0


def test_cost_grows_with_depth_and_not_with_its_square():
    took = []
    for n in (4000, 16000):
        begun = time.process_time()
        html_extraction.extract("<div><p>x" * n)
        took.append(time.process_time() - begun)
    assert took[1] < 10 * max(took[0], 0.05)


LINE = "Lorem ipsum dolor sit amet, consetetur sadipscing elitr, sed diam nonumy eirmod tempor invidunt ut labore."
MANY = "".join(f"<p>{LINE} {i}</p>" for i in range(6))


@pytest.mark.parametrize(
    "html, want",
    [
        (f"<body><form><input type=hidden><div><h1>T</h1><p>{LINE}</p><p>{LINE}</p></div><input name=q></form></body>", f"T\n{LINE}\n{LINE}"),
        (f"<body><nav>menu</nav><form><article><h1>T</h1><p>{LINE}</p></article></form></body>", f"T\n{LINE}"),
        (f"<body><h1>T</h1><p>{LINE}</p><form>{'<label>Your name</label><input>' * 9}</form></body>", f"T\n{LINE}"),
        (f"<body><article><h1>A</h1><p>{LINE} one</p></article><div>x</div><article><h2>B</h2><p>{LINE} two</p></article><footer>f</footer></body>", f"A\n{LINE} one\nB\n{LINE} two"),
        (f"<body><article><h1>A</h1><p>{LINE}</p></article><article><a href=x>Read this next</a></article></body>", f"A\n{LINE}"),
        (f"<article><h1>T</h1><p>{LINE}</p><h2 class='recipe-banner'>Soup</h2><p>{LINE}</p><section class=related><h3>Related work</h3><p>{LINE}</p></section></article>", f"T\n{LINE}\nSoup\n{LINE}\nRelated work\n{LINE}"),
        (f"<article><h1>T</h1><p>{LINE}</p><section id=menu><p>Pasta 9, Pizza 8</p></section><div class=ad>Buy now</div><ul class=related><li><a href=x>More of it</a></li></ul></article>", f"T\n{LINE}\nPasta 9, Pizza 8"),
        (f"<body><div class=post><h1>T</h1><p>{LINE}</p></div><div class=sidebar>{MANY}</div></body>", f"T\n{LINE}"),
        (f"<body><div class=post><h1>T</h1><p>{LINE}</p></div><div class=ad>{MANY}</div><div class=user-reviews>{MANY}</div></body>", f"T\n{LINE}"),
        (f"<body><div class=widget><h1>T</h1><p>{LINE}</p><div class=sidebar><p>{LINE}</p></div></div></body>", f"T\n{LINE}"),
        (f"<body><p>{LINE}</p><aside><p>beside</p></aside></body>", LINE),
    ],
)
def test_marks_yield_to_text(html, want):
    assert html_extraction.extract(html) == want


def test_main_text_against_extract(spark):
    """The query's function over a table, row by row."""
    rows = [(1, "u", f"<article><h1>T</h1><p>{LINE}</p></article>", 5), (None, None, None, None), (3, "u", "", 1), (1, "u", f"<p>{LINE}</p>", 2)]
    got = sorted(map(str, html_extraction.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()))
    assert got == sorted(str(Row(page_id=i, url=u, text=html_extraction.extract(h), n_chars=len(html_extraction.extract(h)))) for i, u, h, _ in rows)
