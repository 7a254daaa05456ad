import itertools
import random
import re
import time

import pandas as pd
import pytest

from statloom.llm import html
from statloom.llm.html import main_text

LONG = "This paragraph is long enough to look like the main text of a page, as it has many words and no links at all."


def cost(weights, edges, labels):
    return sum(abs(w) for w, k in zip(weights, labels, strict=True) if w and (w > 0) != k) + sum(c for a, b, c in edges if labels[a] != labels[b])


def test_minimum_cut_against_all_labellings():
    random.seed(5)
    for _ in range(200):
        n = random.randint(1, 8)
        weights = [random.choice([0, random.uniform(-2, 2)]) for _ in range(n)]
        edges = [(a, b, random.uniform(0, 1.5)) for a in range(n) for b in range(a + 1, n) if random.random() < 0.5]
        best = min(cost(weights, edges, x) for x in itertools.product([False, True], repeat=n))
        assert cost(weights, edges, html.minimum_cut(weights, edges)) == pytest.approx(best)


PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body class="single-post">
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Menu one</a><li><a href='/b>c'>Menu two</a></ul></nav>
<div class="cookie-notice">{LONG}</div><article><h1>Title &amp; &eacute;</h1><p>{LONG} <b>bold</b>er&nbsp;  x<br>next<p>Short.
<div class="ad">{LONG}</div><form><label>Name</label><button>Send</button></form><p style="display:none">Hidden {LONG}</p>
<blockquote>Quoted words.</blockquote><section id="comments"><p>{LONG}</p></section></article><aside>{LONG}</aside><!-- {LONG} -->
<footer>&copy; site</footer></body></html>"""


def test_article_without_the_rest():
    assert main_text(PAGE) == f"Title & é {LONG} bolder x next Short. Quoted words."


def test_pages_without_semantic_elements():
    page = f"<div><a href=x>Home</a> <a href=y>News</a></div><div><p>{LONG}</p><p>Yes.</p><p>{LONG}</p></div><div><a href=z>Imprint</a></div>"
    assert main_text(page) == f"{LONG} Yes. {LONG}"
    assert main_text(LONG) == LONG


@pytest.mark.parametrize("page", [None, "", " ", "<", "<p", "<!--", "</p></p>", "<script>", "<a href='x", "&#0;&#x110000;", "<p>" * 3000 + "x" + "</div>" * 3000])
def test_broken_pages(page):
    assert isinstance(main_text(page), str)


def test_operator(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "x"), (None, "v", f"<main>{LONG * 500}</main>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html.extract(df).orderBy("page_id").collect()
    assert [len(r["text"]) for r in got] == [r["n_chars"] for r in got] and len(got) == 4
    assert got[0]["text"] == " ".join((LONG * 500).split()) and got[1]["text"] == got[2]["text"] and got[3]["text"] == ""
    assert html.extract(df.limit(0)).count() == 0


def test_test_pages_against_their_articles():
    import html as entities

    for page in pd.read_parquet("/root/testdata/sf0.01/pages.parquet").html:
        article = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        plain = entities.unescape(re.sub(r"</?(h1|p|br)>", " ", re.sub(r"</?b>", "", article)))
        assert main_text(page) == " ".join(plain.split())


def test_slash_does_not_close_a_script():
    assert main_text(f'<article><p>{LONG}</p><script src="a.js"/>var leaked = 1;</script><style/>p {{}}</style><svg/><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p></article>') == f"{LONG} So x=2 holds."


def test_deep_nesting_takes_linear_time():
    pages = ["<div>" * 40_000 + "x" + "</p>" * 40_000, "<dl><dt>" + "<div>" * 40_000 + "x" + "<dt></dt><b>" * 40_000, "<b>" * 40_000 + "x<br>" * 40_000]
    began = time.process_time()
    for page in pages:
        assert isinstance(main_text(page), str)
    assert time.process_time() - began < 20


SENTENCE = "A sentence of the article that is long enough to be told from the menus and the notes around it on the page."


@pytest.mark.parametrize("stray", ['<video src="x">', "<select><option>one", "<object data=x>", "<canvas>", "<audio controls>"])
def test_elements_that_never_end_keep_the_article(stray):
    page = f"<body><article><p>{SENTENCE}</p>{stray}<p>Then {SENTENCE}</p></article></body>"
    assert f"{SENTENCE} " in html.main_text(page) and html.main_text(page).endswith(f"Then {SENTENCE}")


def test_embedded_elements_are_no_text():
    page = f"<article><p>{SENTENCE}</p><object><object>inner</object>no plugin</object><video><source src=a>no video</video><p>{SENTENCE}</p></article>"
    assert html.main_text(page) == f"{SENTENCE} {SENTENCE}"


@pytest.mark.parametrize("piece", ["<a ", '<a "', '<a ">', "<a '>x", "<", "</a", "<!--", "<!", "<p <", "<video>", "&lt", "<script "])
def test_long_tag_soup_is_read_in_linear_time(piece):
    began = time.time()
    html.main_text(f"<article><p>{SENTENCE}</p></article>" + piece * (400_000 // len(piece)))
    assert time.time() - began < 5


def test_quotes_hide_the_end_of_a_tag():
    assert html.main_text(f'<article><p title="a > b">{SENTENCE}</p></article>') == SENTENCE
    assert html.main_text(f'<article><p title="a>{SENTENCE}</p></article>') == SENTENCE
    assert html.main_text(f"<article><p>{SENTENCE}<!-- no > text --></p></article><!-- to the end {SENTENCE}") == SENTENCE


def test_embedded_elements_after_lists_and_paragraphs():
    page = f"<ul><li>a<li>b</ul><article><p>{SENTENCE}<p>{SENTENCE}<svg><text>drawn</text></svg><video src=x></video></article>"
    assert html.main_text(page) == f"{SENTENCE} {SENTENCE}"


def bare(page):
    """The same page without what it says of its parts."""
    page = re.sub(r"</?(article|main|nav|aside|footer|header|form|section)\b[^>]*>", lambda m: "</div>" if m[0][1] == "/" else "<div>", page)
    return re.sub(r"""\s(class|id|role|style)="[^"]*\"""", "", page)


def test_learned_costs_and_the_cut_on_bare_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    learned = html.fit(pages.where("page_id % 2 = 0"))
    assert html.fit(pages.where("page_id % 2 = 0").repartition(7)) == learned
    alone = html.Costs(learned.evidence, (0.0, 0.0, 0.0))
    wrong = {"cut": 0, "alone": 0}
    turned = n = 0
    for (page,) in pages.where("page_id % 2 = 1").select("html").collect():
        # between paragraphs stand headings that link to themselves; alone they look like a menu's
        head, article, rest = re.fullmatch(r"(.*)<article>(.*?)</article>(.*)", page, re.S).groups()
        words = re.split(r"\s+", re.sub(r"<[^>]*>", " ", article).strip())
        lines = [" ".join(x) for i in range(0, len(words), 33) for x in (words[i : i + 30], words[i + 30 : i + 33]) if x]
        marked = "".join(f"<p>{x}</p>" if k % 2 == 0 else f"<h2><a href='#s{k}'>{x}</a></h2>" for k, x in enumerate(lines))
        plain = f"{bare(head)}<div>{marked}</div>{bare(rest)}"
        kept, edges, has_content = html._network(plain)
        first = len(html._network(bare(head))[0])
        truth = [first <= k < first + len(lines) for k in range(len(kept))]
        assert not has_content
        found = {"cut": html.labels(kept, edges, False, learned), "alone": html.labels(kept, edges, False, alone)}
        for name, got in found.items():
            wrong[name] += sum(a != b for a, b in zip(got, truth, strict=True))
        turned += sum(a != b for a, b in zip(found["cut"], found["alone"], strict=True))
        n += len(truth)
    print(wrong, turned, n)
    assert turned > 0.2 * n and wrong["cut"] < 0.05 * wrong["alone"]


def test_bare_pages_give_their_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    learned = html.fit(pages.where("page_id % 2 = 0"))
    rows = [r["html"] for r in pages.where("page_id % 2 = 1").collect()]
    assert sum(html.main_text(bare(p), learned) == html.main_text(p) for p in rows) >= 0.95 * len(rows)


def test_costs_without_pages_that_label_themselves(spark):
    df = spark.createDataFrame([("<p>x</p>",), (None,), ("",)], "html string")
    assert html.fit(df) == html.PRIOR and html.fit(df.limit(0)) == html.PRIOR


def test_many_undecided_blocks_take_little_time():
    random.seed(1)
    for weights in ([random.uniform(-2, 2) for _ in range(20_000)], [0.5 if i % 2 else -0.5 for i in range(20_000)], [0.5 if i < 10_000 else -0.5 for i in range(20_000)]):
        edges = [(i - 1, i, 1.5) for i in range(1, 20_000)] + [(i - 2, i, 0.5) for i in range(2, 20_000)]
        began = time.process_time()
        html.minimum_cut(weights, edges)
        assert time.process_time() - began < 5
