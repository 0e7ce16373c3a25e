from __future__ import annotations

import html
import re

from panelstats.llm.html import blocks_of, extract, main_blocks

SENTENCE = "This is the sentence that the reader of the article will find in it, and it is as long as it has to be. "


def text(page):
    return " ".join(main_blocks(page))


def test_pages_of_the_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r for r in extract(pages).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        inside = re.search("<article>(.*?)</article>", r.html, re.S)[1].replace("<br>", " ")
        inside = re.sub("<[a-zA-Z/][^>]*>", "", re.sub("</?(?:p|h1)>", "\n", inside))
        want = " ".join(html.unescape(inside).split())
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want) and got[r.page_id].url == r.url


def test_boilerplate_goes_and_short_blocks_inherit():
    page = f"""<html><body><header>Site of the year</header><nav><a href=/>home</a> <a href=/a>about us</a></nav>
    <div class="cookie-notice">{SENTENCE * 3}</div><main><h2>Short</h2><p>{SENTENCE * 3}</p><p>Well.</p><ul><li>one<li>two</ul>
    <form>Name <input name=q> {SENTENCE * 3}</form><script>var a = "<p>{SENTENCE * 3}</p>"</script><p>{SENTENCE * 4}</p>
    <section id="comments"><p>{SENTENCE * 5}</p></section></main><aside>{SENTENCE * 3}</aside><footer>{SENTENCE * 3}</footer>"""
    assert text(page) == " ".join(["Short", (SENTENCE * 3).strip(), "Well. one two", (SENTENCE * 4).strip()])


def test_names_don_t_condemn_the_article():
    body, aside = f"<p>{SENTENCE * 3}</p><p>Well.</p>", f"<p>{SENTENCE * 9}</p>"
    want = f"{(SENTENCE * 3).strip()} Well."
    for name in ("has-sidebar", "no-sidebar", "share-enabled", "ad-free", "with-newsletter promo"):
        side = f"<div class='sidebar'>{aside}</div><section id='comments'><article class='comment'>{aside}</article></section>"
        assert text(f"<main class='{name}'><article>{body}</article></main>{side}") == want
        assert text(f"<article class='{name}'>{body}</article>{side}") == want
        assert text(f"<main><article id='{name}'>{body}</article></main>{side}") == want
        assert text(f"<div class='{name}'><article>{body}</article>{side}</div>") == want
        assert text(f"<div class='{name}'><div class='x {name}'><main>{body}</main></div></div>{side}") == want
        assert text(f"<div class='{name}'>{body}</div><div class='ad'>Buy</div>") == want
    # names still condemn what isn't the article
    assert text(f"<article>{body}</article><div class='newsletter'>{aside}</div>") == want
    assert text(f"<main>{body}<div class='related'><article class='teaser'><p>{SENTENCE * 4}</p></article></div></main>").startswith(want)
    assert text(f"<article>{body}<div class='share'>{aside}</div></article><ol class='comment-list'><li><article>{aside}</article></ol>") == want


def test_pages_without_an_article():
    page = f"<div>Menu</div><div><a href=1>one link</a> <a href=2>and another</a></div><p>Title</p><p>{SENTENCE * 3}</p><p>So.</p><p>{SENTENCE * 3}</p><div><a href=3>more</a></div><p>Imprint</p>"
    assert text(page) == f"Title {(SENTENCE * 3).strip()} So. {(SENTENCE * 3).strip()}"


def test_references_white_space_and_broken_markup():
    assert text("<article><p>a&amp;b &lt;i&gt; &#233;&nbsp;&#x1F642;  c\n\td &am x</article>") == "a&b <i> é 🙂 c d &am x"
    assert text("<article>x < y <b>bo</b>ld <p title='a>b'>two<p title=\"x>three") == "x < y bold two three"
    assert text("<article>a<!-- <p>no</p> -->b<script>never closed <p>text") == "ab"
    assert text("<article><style>p{}</style><p>k</p></article><!-- open") == "k"
    assert [text(p) for p in (None, "", "   ", "<p></p>", "<nav>menu</nav>")] == [""] * 5


def test_article_without_stop_words_is_kept():
    words = " | ".join(f"xq{i}zz" for i in range(90))
    assert text(f"<article><h1>Head</h1><p>{words}</p></article><footer>{SENTENCE * 3}</footer>") == f"Head {words}"


def test_very_long_and_hostile_pages():
    assert len(text("<article>" + "<p>word " * 50_000)) == 50_000 * 5 - 1
    assert text('<article>ok<p a="' * 3000) == " ".join(["ok"] * 3000)
    assert len(blocks_of("<div>" * 5000 + "x")) == 1


def test_odd_rows(spark):
    rows = [(None, None, None, "t"), (1, "u", "", "t"), (1, "u", "<article>a</article>", "t"), (1, "u", "<article>a</article>", "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((str(r.page_id), str(r.url), r.text, r.n_chars) for r in extract(df).collect())
    assert got == [("1", "u", "", 0), ("1", "u", "a", 1), ("1", "u", "a", 1), ("None", "None", "", 0)]
    assert extract(df.limit(0)).collect() == []
