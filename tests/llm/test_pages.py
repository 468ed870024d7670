import html
import re
import time

import pytest

from labelflow.llm.pages import extract, main_text, op10_html
from tests.conftest import SF01

LONG = ("This is the text of a page and it is long enough to be read as a good block by itself, as it has many of the "
        "words that are in all texts of the language, and there is no link in it. ") * 2


def wanted(page):
    article = page[page.index("<article>") + 9:page.index("</article>")]
    blocks = (re.sub(r"</?b>|<br>", " ", b) for b in re.split(r"</?(?:p|h1)>", article))
    return "\n".join(b for b in (" ".join(html.unescape(b).split()) for b in blocks) if b)


def test_pages_of_the_test_data(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF01}/pages.parquet").collect()}
    rows = op10_html(spark, SF01).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == wanted(pages[r.page_id]) and r.n_chars == len(r.text)


@pytest.mark.parametrize("outside", [
    "<nav><a href='/x'>Home</a></nav>", "<header><h2>Site</h2></header>", f"<aside><p>{LONG}</p></aside>",
    f"<footer>{LONG}</footer>", f"<div class='ad banner'>{LONG}</div>", f"<div id=\"cookie-notice\"><p>{LONG}</p></div>",
    f"<section class='comments'><p>{LONG}</p></section>", f"<form><p>{LONG}</p><button>Go</button></form>",
    f"<script>var a = '<p>{LONG}</p>';</script>", f"<style>p {{ }} /* {LONG} */</style>", f"<!-- <p>{LONG}</p> -->",
    f"<noscript>{LONG}</noscript>", f"<ul class=menu><li><a href='#'>{LONG}</a></ul>",
    f"<div class='related'><p>{LONG}</p></div>", f"<div role='navigation'>{LONG}</div>"])
@pytest.mark.parametrize("marked", [True, False])
def test_only_the_article_is_left(outside, marked):
    body = f"<h1>A title</h1><p>{LONG}</p>{outside}<p>Short end.</p><p>{LONG}&amp; &#233;nd</p>"
    article = f"<article>{body}</article>" if marked else f"<div class='content'>{body}</div>"
    page = f"<html lang='en'><head><title>T</title></head><body>{outside}{article}{outside}</body></html>"
    assert main_text(page) == f"A title\n{LONG.strip()}\nShort end.\n{LONG}& énd"


def test_second_pass_labels_short_blocks_by_neighbours():
    links = "".join(f"<li><a href='/{i}'>Link {i} of the menu</a></li>" for i in range(9))
    page = f"<body><ul>{links}</ul><p>Lost.</p><ul>{links}</ul><p>{LONG}</p><p>Found.</p><p>{LONG}</p><ul>{links}</ul></body>"
    assert main_text(page) == f"{LONG.strip()}\nFound.\n{LONG.strip()}"


def test_titles_bylines_and_links_of_an_article_stay():
    page = ("<html lang=en><body class='menu-open'><article class='post related-x'><header class='entry-header'>"
            "<h1>Title</h1><p>Section name</p></header><div class='article-header'><h1>Second</h1></div>"
            f"<p class='byline'>By one of us</p><p>{LONG}</p><p>It is all in <a href='x'>the text of the page</a> as it was"
            " when it was written and read by all of us.</p><ul><li><a href='/a'>Archive overview page</a></li></ul>"
            "</article></body></html>")
    assert main_text(page).split("\n") == [
        "Title", "Second", "By one of us", LONG.strip(),
        "It is all in the text of the page as it was when it was written and read by all of us."]


TEASER = f"<h3>Other</h3><p>{LONG[:150]}</p>"


@pytest.mark.parametrize("other", [
    f"<article class='related'>{TEASER}</article>" * 3, f"<article class='comment'><p>{LONG}</p></article>",
    f"<div><article id=comment-1><p>{LONG}</p><article class=reply><p>{LONG[:150]}</p></article></article></div>"])
@pytest.mark.parametrize("story", ["div class='content'", "article", "article class='post'", "main"])
def test_named_articles_do_not_replace_the_story(story, other):
    body = f"<h1>A title</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p>"
    page = f"<html lang=en><body><{story}>{body}</{story.split()[0]}>{other}<p>Outside of all.</p></body></html>"
    text = main_text(page)
    assert text.startswith(f"A title\n{LONG.strip()}\nShort.\n{LONG.strip()}")
    assert text.count(LONG.strip()) == 2 and "Other" not in text and LONG[:150].strip() not in text.split("\n")


def test_a_story_beside_unnamed_articles_stays():
    page = (f"<html lang=en><body><div class=content><h1>A title</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div>"
            f"<article><h3>Teaser</h3><p>{LONG[:150]}</p></article></body></html>")
    assert main_text(page).startswith(f"A title\n{LONG.strip()}\nShort.\n{LONG.strip()}")


ITALIAN = ("Il governo presenta oggi una nuova legge sulla scuola pubblica, mentre i sindacati annunciano scioperi in tutte "
           "le regioni; secondo il ministro, servono risorse maggiori e insegnanti meglio pagati entro settembre. ") * 2
RUSSIAN = "Правительство представило сегодня новый закон о школах, а профсоюзы объявили забастовки во всех регионах страны. " * 3
CHINESE = "政府今天公布了一项关于公立学校的新法律，工会宣布将在全国各地举行罢工，部长表示需要更多的资金和教师。" * 2


@pytest.mark.parametrize("text", [ITALIAN, RUSSIAN, CHINESE])
@pytest.mark.parametrize("lang", [" lang='xx'", ""])
def test_languages_without_a_list_of_stop_words(text, lang):
    links = "".join(f"<li><a href='/{i}'>{text[:20]} {i}</a></li>" for i in range(9))
    page = (f"<html{lang}><body><ul>{links}</ul><div class='content'><h1>{text[:15]}</h1><p>{text}</p><p>{text[:9]}.</p>"
            f"<p>{text}</p></div><ul>{links}</ul><div class='cookie'>{text}</div></body></html>")
    assert main_text(page) == "\n".join([text[:15].strip(), text.strip(), f"{text[:9]}.", text.strip()])


def test_article_of_short_blocks_only():
    page = "<body><nav><a href=x>Home</a></nav><article><h1>Of.</h1><p>That it.</p></article><footer>&copy; x</footer>"
    assert main_text(page) == "Of.\nThat it."


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("<", ""), ("<article>", ""), ("<article><p>a<b>b</b>\n c&nbsp;&lt;d&gt;</p>", "ab c <d>"),
    ("<article><p>one<p>two<br>three</article>", "one\ntwo three"), ("<article><p title='a>b'>x</p><!-- > --></article>", "x"),
    ("<article><p data=it's>x</p><p>y</p></article>", "x\ny"), ("<article>a < b and c</article>", "a < b and c"), ("<article><p>x</p><script>if (a < b) '</p>'", "x"),
    ("<p>" * 3000, ""), ("<article>" + "<div>" * 2000 + "deep", "deep")])
def test_odd_markup(page, text):
    assert main_text(page) == text


def test_columns_nulls_and_repeats(spark):
    rows = [(1, "u", "<article><p>x</p></article>", 7, 3), (1, "u", "<article><p>x</p></article>", 7, 3), (None, None, None, 0, 0)]
    frame = extract(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars long, lang long"))
    assert frame.columns == ["page_id", "url", "lang", "text", "n_chars"]
    assert sorted(map(str, (tuple(r) for r in frame.collect()))) == sorted(map(str, [
        (1, "u", 3, "x", 1), (1, "u", 3, "x", 1), (None, None, 0, "", 0)]))
    assert extract(frame.limit(0).withColumnRenamed("text", "html")).collect() == []


@pytest.mark.parametrize("piece", ["<a x ", "<div><b>", "<div>", "<html ", "<!-- x ", "<", '<a x="', "<aaaa b='c", "<li><p>", "&amp"])
def test_a_megabyte_of_odd_markup_in_linear_time(piece):
    for page in (piece * (1_000_000 // len(piece)), piece * (1_000_000 // len(piece)) + ">", piece * 100_000 + "</i>" * 100_000):
        began = time.time()
        main_text(page)
        assert time.time() - began < 15


def test_text_behind_the_last_tag():
    story = "There is a house in the town and it was the house of my mother, who was a tailor there for all of her days. " * 3
    assert main_text(f"<p>{story}</p><p>{story} &amp; more <b").split("\n")[1] == story + "& more <b"
    assert main_text(f"<p>{story}</p><p>{story} more <!-- never {story}").split("\n")[1] == story + "more"
    assert main_text(f"{story}<!-- a -->{story}") == f"{story}{story}".strip()
