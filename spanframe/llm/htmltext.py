"""Main text of web pages: structure first, then a host's repeated passages.

A page is cut into blocks of text. Blocks inside an article or main element, other than menus, notices, adverts, comments
and the like in it, are the page's own text. Structure leaves undecided: the blocks of a page without such an element; those
outside it where they hold more text than it does, as beside a teaser; and paragraphs and other elements of text whose
class is a word that may as well name what they tell (``alert``, ``search``). There the host decides: the token streams of
a host's undecided blocks form a suffix array, and substrings of at least so many tokens that occur on several distinct
pages are boilerplate, as are shorter blocks beside a page's own text that do so as a whole. What they cover goes, and runs
of tokens that are unique stay.

The suffix array is made by prefix doubling, by the tokens themselves: suffixes are rows, sorted by host and first tokens;
their ranks, paired with the ranks of the suffixes so many tokens further on, sort them by twice as many, until no repeat is
longer. Equal ranks are the runs of neighbours that share so many tokens. So no host's stream is gathered anywhere, and
suffixes leave the array as soon as what they share stands on too few pages.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanframe.llm import jaccard
from spanframe.llm.common import bound_batches, saved, unsaved

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
VALUE = re.compile(r"""([A-Za-z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
#: Elements whose content is no markup, and is no text of the page.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "math", "object", "canvas", "xmp"}
#: Of these, what is left open runs to the page's end.
CODE = {"script", "style", "xmp"}
#: A slash that closes a tag, not one that ends a value without quotes.
CLOSED = re.compile(r"(?:^|[\s\"'])/\s*\Z")
DROP = {"nav", "header", "footer", "aside", "form", "button", "select", "dialog", "menu", "head", "audio", "video", "label", "fieldset"}
MAIN = {"article", "main"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "br", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td",
    "tfoot", "th", "thead", "tr", "ul",
}
#: An opening block element ends an open p; so does a new item end an item.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words in the class or id of an element that is no part of the article. A word with a prefix or a suffix of its own, as in
#: has-sidebar or share-price, tells something else, so it must stand alone or with a word that doesn't change what it is.
BOILER = re.compile(
    r"(?:^|\s)(?:(?:site|page|main|top|bottom|global|primary|secondary|left|right|user|reader|web|inline|sticky|article|related|author|email|cookie|privacy|social)[_-]{1,2})*(?:ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|promo(?:tion)?|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|sidebar|side-bar|widget|menu|nav|navbar|"
    r"navigation|breadcrumbs?|footer|header|masthead|comments?|comment-list|replies|reply|disqus|respond|related|recommended|share|sharing|social|newsletter|subscribe|signup|login|search|pagination|pager|skip-link)(?:[_-]{1,2}(?:box|bar|area|block|container|wrap|wrapper|inner|outer|section|list|item|items|links?|menu|nav|content|top|bottom|left|right|main|message|form|slot|unit|banner|notice|title|body|text|\d+))*(?:$|\s)",
    re.I,
)
#: Of these, words that leave an element of text undecided, since they may name what it tells.
DOUBT = re.compile(r"(?<!\S)(?:alert|search)(?!\S)", re.I)
#: Elements that hold text rather than parts of a page; phrases in them are part of the text.
TEXTUAL = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "td", "th", "blockquote", "pre", "figcaption"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar", "alertdialog"}
SPACE = re.compile(r"\s+")
#: The suffix array is first sorted by strings of so many tokens; ranks take over from there.
FIRST = 4


def blocks(page: str | None) -> list[tuple[bool, str]]:
    """(own, text) of the page's blocks in order, boilerplate left out; own: it is in a main element, and not in doubt.

    Where a page has main elements, blocks outside them are left out unless they hold more text than these. Character
    references are decoded, white space within a block becomes one space.
    """
    page = page or ""
    found: list[tuple[bool, str, bool]] = []  # own, text, whether it is in a main element
    stack: list[tuple[str, bool, bool, bool]] = []  # name, whether it drops, whether it is main, whether it is in doubt
    opened: dict[str, int] = {}  # how many elements of a name are open
    parts: list[str] = []
    dropping = own = doubts = 0
    at, size = 0, len(page)
    endless: set[str] = set()  # names that no end tag follows any more

    def end_block() -> None:
        text = SPACE.sub(" ", html.unescape("".join(parts))).strip()
        if text:
            found.append((own > 0 and not doubts, text, own > 0))
        parts.clear()

    def close(upto: int) -> None:
        nonlocal dropping, own, doubts
        while len(stack) > upto:
            name, drop, is_main, doubt = stack.pop()
            opened[name] -= 1
            if name in BLOCK or drop:
                end_block()
            dropping -= drop
            own -= is_main
            doubts -= doubt

    while at < size:
        tag = TAG.search(page, at)
        if not dropping:
            parts.append(page[at : tag.start() if tag else size])
        if not tag:
            break
        at = tag.end()
        name = (tag[2] or tag[5] or "").lower()
        if not name:
            continue
        if tag[1] or tag[4]:  # an end tag
            if not opened.get(name):
                if name in BLOCK:
                    end_block()
                continue
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    close(k)
                    break
            continue
        attributes = tag[3] or tag[6] or ""
        closed = CLOSED.search(attributes) is not None
        if name in RAW:
            if not closed:
                end = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(page, at) if name not in endless else None
                if not end:
                    endless.add(name)
                if end:
                    at = page.find(">", end.start()) + 1 or size
                elif name in CODE:  # left open, the rest of the page is code
                    at = size
                # other elements left open hold nothing: the page goes on behind the tag
            continue
        if name in BLOCK:
            if stack and stack[-1][0] == "p" and not stack[-1][1]:
                close(len(stack) - 1)
            end_block()
        for k in range(len(stack) - 1, -1, -1) if name in ENDS else ():
            if stack[k][0] in ENDS[name]:
                close(k)
                break
            if stack[k][0] in {"ul", "ol", "dl", "table", "select"}:
                break
        if name in VOID or closed:
            continue
        values = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in VALUE.finditer(attributes)} if attributes else {}
        role = values.get("role", "").lower()
        hidden = re.search(r"(?:^|\s)hidden(?:\s|=|$)", VALUE.sub(" ", attributes)) is not None or "hidden" in values or values.get("aria-hidden") == "true" or "display:none" in values.get("style", "").replace(" ", "")
        marks = [values[k] for k in ("class", "id") if k in values and BOILER.search(values[k])] if name not in ("html", "body") else []
        phrase = name not in BLOCK and (name == "label" or name not in DROP) and any(opened.get(n) for n in TEXTUAL)
        mild = (phrase or name in TEXTUAL) and not any(BOILER.search(DOUBT.sub(" ", m)) for m in marks)
        drop = (name in DROP and not (phrase and mild)) or role in ROLES or hidden or (bool(marks) and not mild)
        doubt = bool(marks) and not drop and not phrase
        is_main = not drop and (name in MAIN or role == "main")
        if drop:
            end_block()
        stack.append((name, drop, is_main, doubt))
        opened[name] = opened.get(name, 0) + 1
        dropping += drop
        doubts += doubt
        own += is_main and not dropping
        if is_main and dropping:
            stack[-1] = (name, drop, False, doubt)
    close(0)
    end_block()
    beside = sum(len(text) for _, text, inside in found if not inside)
    whole = beside > sum(len(text) for _, text, inside in found if inside)  # so too where nothing is inside
    return [(o, text) for o, text, inside in found if inside or whole]


def cut(pages: DataFrame) -> DataFrame:
    """(row_id, page_id, url, owns, texts) of each page; row_id is the same for rows that repeat a page."""
    bound_batches(pages.sparkSession, 256)

    @F.pandas_udf("owns array<boolean>, texts array<string>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [blocks(page) for page in batch]
            yield pd.DataFrame({"owns": [[o for o, _ in b] for b in found], "texts": [[t for _, t in b] for b in found]})

    row = F.xxhash64("page_id", "url", "html").alias("row_id")
    return pages.select(row, "page_id", "url", of("html").alias("b")).select("row_id", "page_id", "url", "b.*")


def host_of(url) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def without_repeats(undecided: DataFrame, tokens: int, pages_at_least: int) -> DataFrame:
    """``undecided`` (row_id, page_id, url, owns, texts) with texts rid of passages that the host repeats; own ones stay.

    Pages that are copies or near copies as a whole (jaccard.classes) differ in little but the passages they share, so they
    count once.
    """
    pages = undecided.dropDuplicates(["row_id"]).select("row_id", host_of(F.col("url")).alias("host"), "owns", "texts")
    streams = pages.select("row_id", F.array_join("texts", " ").alias("stream"))
    alike = saved(jaccard.classes(streams, "row_id", "stream").select(F.col("id").alias("row_id"), "class"), "html-alike")
    pages = saved(pages.join(alike, "row_id"), "html-undecided")
    passages = repeats(pages, tokens, pages_at_least).unionByName(repeated_blocks(pages, tokens, pages_at_least))
    longest = passages.groupBy("row_id", "at").agg(F.max("length").alias("length"))
    covered = longest.groupBy("row_id").agg(F.collect_list(F.struct("at", "length")).alias("c"))  # at most a page's own suffixes

    @F.pandas_udf("array<string>")
    def unique(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, owns, firsts, lengths in batches:
            yield pd.Series([_uncovered(t, o, () if a is None else zip(a, n)) for t, o, a, n in zip(texts, owns, firsts, lengths)])

    joined = undecided.join(covered, "row_id", "left")
    return joined.select("row_id", "page_id", "url", unique("texts", "owns", "c.at", "c.length").alias("texts"))


def repeats(pages: DataFrame, tokens: int, pages_at_least: int) -> DataFrame:
    """(row_id, at, length): the suffixes of ``pages`` (row_id, host, class, owns, texts) that begin a repeated passage.

    at: the suffix's first word, counted over the page's undecided blocks. length: the greatest of tokens, 2 * tokens,
    4 * tokens and so on of its words that stand on so many distinct pages (classes) of the host; what a repeat has beyond
    that, the suffixes after it begin.
    """
    depth = min(FIRST, tokens)

    @F.pandas_udf("stream array<int>, at array<int>, head array<string>")
    def heads(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, owns in batches:
            found = [list(_suffixes(t, o, depth)) for t, o in zip(texts, owns)]
            yield pd.DataFrame({name: [[suffix[k] for suffix in page] for page in found] for k, name in enumerate(("stream", "at", "head"))})

    suffixes = pages.select("row_id", "host", "class", heads("texts", "owns").alias("s"))
    suffixes = suffixes.select("row_id", "host", "class", F.inline(F.arrays_zip("s.stream", "s.at", "s.head")))
    suffixes = saved(suffixes, "html-suffixes")
    array = ranked(suffixes, ["head"], pages_at_least)
    unsaved(suffixes)
    found = array.where("false").select("row_id", "at", F.lit(depth).alias("length"))
    while array.take(1):
        if depth >= tokens:
            found = found.unionByName(array.select("row_id", "at", F.lit(depth).alias("length")))
        step = depth if depth >= tokens else min(depth, tokens - depth)
        ahead = Window.partitionBy("row_id", "stream").orderBy("at").rangeBetween(step, step)
        deeper = array.withColumn("then", F.first("rank").over(ahead)).where("then IS NOT NULL")
        shallow, array = array, ranked(deeper, ["rank", "then"], pages_at_least)
        if depth < tokens:
            unsaved(shallow)
        depth += step
    return found


def ranked(suffixes: DataFrame, by: list[str], pages_at_least: int) -> DataFrame:
    """(row_id, host, class, stream, at, rank) of the suffixes in runs of the sorted array that so many classes of a host are in.

    by: what the suffixes of a host are sorted by, so that ranks ascend as it does and those of a run are equal. A suffix whose
    words as yet compared stand on fewer pages can begin no repeat, nor can one that reaches it, so it leaves the array.
    """
    runs = suffixes.select("host", *by, "class").distinct().groupBy("host", *by).count().where(F.col("count") >= pages_at_least)
    ranks = saved(runs.orderBy("host", *by).select("host", *by, F.monotonically_increasing_id().alias("new")), "html-ranks")
    array = saved(suffixes.join(ranks, ["host", *by]).select("row_id", "host", "class", "stream", "at", F.col("new").alias("rank")), "html-array")
    unsaved(ranks)
    return array


def repeated_blocks(pages: DataFrame, tokens: int, pages_at_least: int) -> DataFrame:
    """(row_id, at, length) of undecided blocks beside own ones that are too short for a repeat, but are repeated as a whole."""

    @F.pandas_udf("at array<int>, length array<int>, block array<string>")
    def short(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, owns in batches:
            found = [list(_short_blocks(t, o, tokens)) for t, o in zip(texts, owns)]
            yield pd.DataFrame({name: [[block[k] for block in page] for page in found] for k, name in enumerate(("at", "length", "block"))})

    mixed = pages.where("exists(owns, o -> o)").select("row_id", "host", "class", short("texts", "owns").alias("s"))
    blocks_of = saved(mixed.select("row_id", "host", "class", F.inline(F.arrays_zip("s.at", "s.length", "s.block"))), "html-short")
    often = blocks_of.select("host", "block", "class").distinct().groupBy("host", "block").count().where(F.col("count") >= pages_at_least)
    return blocks_of.join(often, ["host", "block"]).select("row_id", "at", "length")


def _suffixes(texts: Iterable[str], owns: Iterable[bool], depth: int) -> Iterator[tuple[int, int, str]]:
    """(stream, first word, first ``depth`` words) of the suffixes of undecided blocks, words counted over these blocks.

    Blocks that follow each other are one stream; suffixes with fewer words are left out.
    """
    at = number = 0
    stream: list[str] = []
    for text, own in zip([*texts, ""], [*owns, True]):
        if not own:
            stream += text.split()
            continue
        for i in range(len(stream) - depth + 1):
            yield number, at + i, " ".join(stream[i : i + depth])
        at += len(stream)
        number += 1
        stream = []


def _short_blocks(texts: Iterable[str], owns: Iterable[bool], tokens: int) -> Iterator[tuple[int, int, str]]:
    """(first word, number of words, block) of undecided blocks with fewer than ``tokens`` words."""
    at = 0
    for text, own in zip(texts, owns):
        words = [] if own else text.split()
        if 0 < len(words) < tokens:
            yield at, len(words), " ".join(words)
        at += len(words)


def _uncovered(texts: Iterable[str], owns: Iterable[bool], gone: Iterable[tuple[int, int]]) -> list[str]:
    """The texts without the words of undecided blocks that ``gone`` (first word, number of words) covers."""
    texts, owns = list(texts), list(owns)
    stay = [True] * sum(len(t.split()) for t, own in zip(texts, owns) if not own)
    done = 0  # words before it are settled, so nested passages take no time in the square of their length
    for first, count in sorted(gone):
        first, upto = max(first, done), first + count
        if first < upto:
            stay[first:upto] = [False] * (upto - first)
            done = upto
    out, at = [], 0
    for text, own in zip(texts, owns):
        if own:
            out.append(text)
            continue
        words = text.split()
        left = [w for w, s in zip(words, stay[at : at + len(words)]) if s]
        at += len(words)
        if left:
            out.append(" ".join(left))
    return out


def main_text(pages: DataFrame, tokens: int = 12, pages_at_least: int = 3) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html).

    tokens, pages_at_least: a passage of a host's undecided blocks is boilerplate if that long and on that many distinct
    pages. A null or empty page has an empty text. Repeated rows, copies and near copies of a page, under whatever ids, are one page to the host and each get a row. Pages
    without an address share one nameless host. Other columns are ignored; an empty table gives an empty result.
    """
    rows = saved(cut(pages), "html-blocks")
    decided = rows.where("forall(owns, o -> o)").select("page_id", "url", "texts")
    open_rows = rows.where("exists(owns, o -> NOT o)")
    if open_rows.take(1):
        decided = decided.unionByName(without_repeats(open_rows, tokens, pages_at_least).select("page_id", "url", "texts"))
    text = F.array_join("texts", " ")
    return decided.select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"))
