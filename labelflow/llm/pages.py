"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass classifies each
block by itself: link density, length and stop-word density make it *good*,
*bad*, *near-good* or *short*; blocks inside navigation, adverts, notices,
forms, comments and the like are bad. The second pass lets near-good and short
blocks inherit from the nearest decided neighbours. In a page that marks its
article (``<article>`` or ``<main>``) the blocks of that part are neighbours of
each other only, and there a long block with few stop words is undecided
instead of bad; blocks outside it are judged by the plain rules among
themselves and need a good block beside them. An ``<article>`` whose class, id
or role names comments, teasers or the like is bad unless it holds more good
text than all that is not so named. Where no list of stop words fits the page (its
declared language has none, or no block is dense enough in any) length and link
density decide alone.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import read_table, ship

# Tag names, class words, thresholds and common words.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center col colgroup dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 header hr html legend li link main menu "
    "meta nav noframes noscript ol optgroup option p pre section select summary table tbody td tfoot th thead "
    "title tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SKIPPED_TAGS = frozenset("script style".split())
BAD_TAGS = frozenset(
    "nav footer aside form button select option noscript template iframe svg canvas object menu dialog head title "
    "textarea audio video math".split())
CONTENT_TAGS = frozenset("article main".split())
#: Elements that hold the page or the article itself; class words on them say nothing about their text.
WHOLE_TAGS = frozenset("html body article main".split())
BAD_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial adsense adslot alert alertdialog banner banners "
    "breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies copyright "
    "dialog disqus footer gdpr login masthead menu menus modal nav navbar navigation newsletter notice notices "
    "pagination pager popup promo promos promotion recommended related respond share sharing shoutbox sidebar "
    "sidebars signup skip social sponsor sponsored sponsors subscribe subscription toolbar widget widgets".split())
HEADER = "header"
MAX_LINK_DENSITY, MAX_ARTICLE_LINK_DENSITY = 0.2, 0.8
SHORT_LENGTH, LONG_LENGTH = 70, 200
STOP_LOW, STOP_HIGH = 0.30, 0.32
STOP_WORDS = {
    "en": frozenset("a about all also an and are as at be been but by can do for from had has have he her his i if in "
                    "into is it its like more my no not of on one or other our out she so some than that the their "
                    "them then there these they this to up was we were what when which who will with would you "
                    "your".split()),
    "de": frozenset("aber als am an auch auf aus bei bis das dass dem den der des die durch ein eine einem einen einer "
                    "er es für hat ich ihr im in ist mit nach nicht noch nur oder sich sie sind so über um und uns "
                    "vom von vor war was wenn werden wie wir wird zu zum zur".split()),
    "fr": frozenset("à au aux avec ce ces cette comme d dans de des du elle elles en entre est et été il ils je l la "
                    "le les leur lui mais me ne nos nous on ont ou où par pas plus pour qu que qui sa sans se ses si "
                    "son sont sur un une vos vous y".split()),
    "es": frozenset("a al como con cuando de del desde donde e el ella en entre era es esta este esto fue ha han hay la "
                    "las le lo los más me mi muy no nos o para pero por porque que se ser si sin sobre son su sus "
                    "también te un una y ya yo".split()),
}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*|[^>]*)>"
    r"|(?P<text>[^<]+|<)", re.S)
CLASS_OR_ID = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
NAME_PART = re.compile(r"[a-z]+")
HTML_TAG = re.compile(r"<html\b[^>]*", re.I)
LANG = re.compile(r"\blang\s*=\s*[\"']?([a-zA-Z]{2})", re.I)
UNCLOSED = re.compile(r"<[!?]")
#: Letters of scripts written without spaces count as this many in lengths where no stop words are known.
DENSE = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\U00020000-\U0003ffff]")
DENSE_FACTOR = 3
EDGE = re.compile(r"^\W+|\W+$")


@dataclass
class Block:
    text: str
    links: int
    heading: bool
    bad: bool
    content: int
    named_bad: int  # the innermost <article> around it with a bad class word, or 0


def _class_words(attributes: str) -> set[str]:
    return {w for groups in CLASS_OR_ID.findall(attributes) for w in NAME_PART.findall("".join(groups).lower())}


def _mark(name: str, attributes: str) -> str:
    """``bad`` or ``header`` for an element whose tag, class, id or role rules out its text."""
    if name == HEADER:
        return HEADER
    if name in BAD_TAGS:
        return "bad"
    if name in WHOLE_TAGS:
        return ""
    words = _class_words(attributes)
    return "bad" if words & BAD_WORDS else HEADER if HEADER in words else ""


def blocks_of(page: str) -> list[Block]:
    """Blocks in page order with their text, link characters and surroundings."""
    blocks: list[Block] = []
    stack: list[tuple[str, str, int, int]] = []
    bad_depth = header_depth = link_depth = 0
    content = contents = named_bad = 0
    parts: list[str] = []
    link_parts: list[str] = []
    heading = title = False

    def flush() -> None:
        nonlocal heading, title
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                links = len(" ".join("".join(link_parts).split()))
                own_title = title and content and bad_depth == header_depth  # an article's title in its own header
                blocks.append(Block(text, links, heading, bad_depth > 0 and not own_title, content, named_bad))
        parts.clear()
        link_parts.clear()
        heading = title = False

    open_names: Counter = Counter()
    position, last = 0, page.rfind(">")
    while match := TOKEN.match(page, position) if position <= last else None:
        position = match.end()
        name = match["name"]
        if name is None:
            if (text := match["text"]) is not None:
                if "&" in text:
                    text = html_lib.unescape(text)
                parts.append(text)
                if link_depth:
                    link_parts.append(text)
            continue
        name = name.lower()
        if name in SKIPPED_TAGS and not match["close"]:
            end = re.compile(rf"</{name}\s*>|\Z", re.I).search(page, position)
            position = end.end()
            continue
        if name == "br":
            parts.append(" ")
            link_parts.append(" " if link_depth else "")
            continue
        if name == "a":
            link_depth = 0 if match["close"] else 1
            continue
        marked = "" if match["close"] else _mark(name, match["rest"])
        if marked or name in BLOCK_TAGS or name in BAD_TAGS:
            flush()
        if match["close"]:
            if open_names[name]:
                while stack:
                    open_name, was_marked, was_content, was_named = stack.pop()
                    open_names[open_name] -= 1
                    if was_marked or open_name in CONTENT_TAGS:
                        flush()
                    bad_depth -= was_marked != ""
                    header_depth -= was_marked == HEADER
                    content, named_bad = was_content, was_named
                    if open_name == name:
                        break
            if name in HEADINGS:
                heading = title = False
        elif name not in VOID_TAGS and not match["rest"].endswith("/"):
            if name == "p" or name in HEADINGS:  # a paragraph ends where the next begins
                while stack and stack[-1][0] in ("p", "b", "i", "em", "strong", "span", "u", "font"):
                    open_name, was_marked, content, named_bad = stack.pop()
                    open_names[open_name] -= 1
                    bad_depth -= was_marked != ""
                    header_depth -= was_marked == HEADER
            stack.append((name, marked, content, named_bad))
            open_names[name] += 1
            bad_depth += marked != ""
            header_depth += marked == HEADER
            if name in CONTENT_TAGS and not bad_depth:
                contents += 1
                content = contents
                if name == "article" and _class_words(match["rest"]) & BAD_WORDS:
                    named_bad = contents
            heading, title = name in HEADINGS, name == "h1"
    # no tag ends behind the last ">": the rest is text, up to a comment or declaration that is never closed
    rest = html_lib.unescape(UNCLOSED.split(page[position:], maxsplit=1)[0])
    parts.append(rest)
    if link_depth:
        link_parts.append(rest)
    flush()
    return blocks


def stop_density(text: str, lists: list[frozenset]) -> float:
    if not lists:
        return 0.0
    words = [EDGE.sub("", w) for w in text.lower().split()]
    words = [w for w in words if w]
    return max(sum(w in words_of for w in words) for words_of in lists) / len(words) if words else 0.0


def drop_named_articles(blocks: list[Block], lists: list[frozenset]) -> None:
    """Blocks of articles named as comments, teasers or the like become bad, but
    for an article with more good text than all blocks outside such articles."""
    if not any(b.named_bad for b in blocks):
        return
    held: dict[int, tuple[int, int]] = {0: (0, 0)}
    for b in blocks:
        if not b.bad:
            good = len(b.text) if classify(b, lists, b.content > 0) == "good" else 0
            before = held.get(b.named_bad, (0, 0))
            held[b.named_bad] = (before[0] + good, before[1] + (len(b.text) if b.content else 0))
    for b in blocks:
        if b.named_bad and held.get(b.named_bad, (0, 0)) <= held[0]:
            b.bad, b.content = True, 0


def classify(block: Block, lists: list[frozenset], marked_article: bool) -> str:
    """First pass: a block by itself; without lists by length and links alone."""
    length = len(block.text)
    if block.bad:
        return "bad"
    if block.links > (MAX_ARTICLE_LINK_DENSITY if marked_article else MAX_LINK_DENSITY) * length:
        return "bad"
    if marked_article and block.links > MAX_LINK_DENSITY * length and stop_density(block.text, lists) < STOP_LOW:
        return "bad"
    if not marked_article and ("©" in block.text and length < LONG_LENGTH):
        return "bad"
    size = length if lists else length + (DENSE_FACTOR - 1) * len(DENSE.findall(block.text))
    if size < SHORT_LENGTH:
        return "bad" if block.links and not marked_article else "short"
    if not lists:
        return "good" if size > LONG_LENGTH else "near"
    density = stop_density(block.text, lists)
    if density >= STOP_HIGH:
        return "good" if length > LONG_LENGTH else "near"
    if density >= STOP_LOW:
        return "near"
    return "near" if marked_article else "bad"


def settle(blocks: list[Block], labels: list[str], marked_article: bool, alone: bool = True) -> list[bool]:
    """Second pass: undecided blocks take the labels of decided neighbours.
    ``alone`` is false for what stands outside a page's marked article.

    Blocks that their markup rules out are no part of the text's flow and so
    no neighbours: an advert between two paragraphs says nothing about them."""
    n = len(labels)
    decides = [label in ("good", "bad") and not b.bad for b, label in zip(blocks, labels, strict=True)]
    before, after = [""] * n, [""] * n
    last = ""
    for i in range(n):
        before[i] = last
        if decides[i]:
            last = labels[i]
    last = ""
    for i in reversed(range(n)):
        after[i] = last
        if decides[i]:
            last = labels[i]
    keep = []
    for i, label in enumerate(labels):
        around = {before[i], after[i]} - {""}
        if label in ("good", "bad"):
            keep.append(label == "good")
        elif marked_article:  # only an article's own parts surround it
            keep.append("good" in around or not before[i] or not after[i])
        elif label == "near":
            keep.append("good" in around or (alone and not around))
        elif blocks[i].heading:
            keep.append(after[i] == "good")
        else:
            keep.append(around == {"good"})
    return keep


def main_text(page: str | None) -> str:
    """The article's blocks in page order, one per line; empty if there is none."""
    if not page:
        return ""
    language = next((found[-1] for tag in HTML_TAG.finditer(page) if (found := LANG.findall(tag[0]))), None)
    named = STOP_WORDS.get(language.lower()) if language else None
    lists = [named] if named else [] if language else list(STOP_WORDS.values())
    blocks = blocks_of(page)
    if not any(len(b.text) >= SHORT_LENGTH and not b.bad and stop_density(b.text, lists) >= STOP_LOW for b in blocks):
        lists = []  # none of the known languages
    drop_named_articles(blocks, lists)
    marked_article = any(b.content for b in blocks)
    kept: set[int] = set()
    for inside in (True, False):
        at = [i for i, b in enumerate(blocks) if (b.content > 0) == inside]
        part = [blocks[i] for i in at]
        labels = [classify(b, lists, inside) for b in part]
        kept.update(i for i, keep in zip(at, settle(part, labels, inside, not marked_article), strict=True) if keep)
    return "\n".join(b.text for i, b in enumerate(blocks) if i in kept)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """All columns of ``pages`` but the markup, plus ``text`` and ``n_chars``.

    A narrow pass without a shuffle; each page is parsed whole. A null or empty
    page gives an empty text; repeated rows each get their own result; input
    columns called ``text`` or ``n_chars`` are replaced."""
    ship(pages.sparkSession)
    kept = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    source = pages.select(*[pages[c] for c in kept], pages[html])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = [main_text(value.as_py()) for value in part.column(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=[*part.schema.names[:-1], "text", "n_chars"])

    schema = ", ".join([f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]]
                       + ["text string", "n_chars bigint"])
    return source.mapInArrow(run, schema)


def op10_html(spark, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
