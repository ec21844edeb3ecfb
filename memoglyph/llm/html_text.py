"""Main text of web pages by differencing each page against its nearest neighbour of the same host.

A page is cut into lines of text with the elements around them. It is aligned, by the longest common subsequence of lines,
with the page whose URL path is nearest in the order of the host's paths. Lines that both share are the host's template and
go; only a passage that both pages hold inside a marked article stays, as articles quote each other. What differs from page
to page and still is no article (menus, headers, footers, sidebars, notices, adverts, forms, comments) goes by its markup. A
copy of a page says nothing about a template: equal pages of a host are one, and the search for a mate goes past near
copies, which share most of the lines that aren't on most pages of the host.
"""

from __future__ import annotations

import bisect
import html
import re
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from memoglyph.llm.common import arrow_columns, checkpointed, free_names, joined_small, table

#: Elements whose content is no markup, up to their end tag.
RAW = {"script", "style", "textarea", "title"}
#: Elements that hold no blocks: the next block ends them, closed or not.
CONTROLS = {"button", "select", "head"}
#: Elements that never hold an article, if they are closed.
ASIDE = {"nav", "footer", "aside", "form", "menu", "dialog", "fieldset", "noscript", "template", "svg", "iframe", "object", "math", "canvas", "audio", "video"}
#: Elements that end a block.
BLOCK = {"p", "div", "br", "hr", "li", "ul", "ol", "dl", "dt", "dd", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "main", "header", "footer", "nav", "aside", "table", "tr", "td", "th", "thead", "tbody", "tfoot", "caption", "blockquote", "pre", "figure", "figcaption", "form", "fieldset", "address", "body", "html", "details", "summary", "center", "dialog", "menu", "title"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
#: What an opening tag closes, if it is the innermost open block.
CLOSES = {t: {"p"} for t in BLOCK - {"br", "body", "html"}} | {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}
#: Words in a class, id or role that mark an element as no part of an article.
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|adbox|advert|banner|sponsor(?:ed)?|promo(?:tion)?|sidebar|side-bar|menu|nav(?:bar|igation)?|breadcrumbs?|footer|foot|header|masthead|topbar|"
    r"cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|related|recommend(?:ed|ations)?|comments?|comment-list|disqus|replies|reply|respond|"
    r"pagination|pager|toolbar|search|widget|skip-link|complementary|contentinfo|dialog|form|tags|copyright|legal|disclaimer)(?=$|[\s_-]|\d)",
    re.I,
)
#: Those of them that count inside an article, on elements that group others.
MARKS_INSIDE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|adbox|sponsor(?:ed)?|comments?|comment-list|disqus|newsletter|cookies?|consent|popup|modal|share|sharing|social|related|recommend(?:ed|ations))(?=$|[\s_-]|\d)", re.I
)
#: A marked element that holds more than this part of the text is the frame of the page, as a layout with a sidebar, and no part of it.
FRAME = 0.5
GROUPS = {"div", "section", "aside", "ul", "ol", "ins"}
_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r">|=\s*([\"'])")
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][\w:.-]*)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
_RAW_END = {name: re.compile(f"</{name}(?![^\\s/>])", re.I | re.A) for name in RAW}
_END_OF = {name: re.compile(f"</{name}(?![^\\s/>])", re.I | re.A) for name in ASIDE}
_SPACE = re.compile(r"\s+")
#: Pages that share more than this part of the shorter one's characters, without the lines on most pages of the host, are copies.
COPY = 0.8
#: Distinct pages of a host that a line on most of them is on at least.
WIDE = 3
#: Pairs of equal lines that an alignment lists.
MOST_PAIRS = 2_000_000
#: Where a line is: outside a marked article, inside it, or set aside by its markup.
OUTSIDE, INSIDE, SET_ASIDE = 0, 1, 2
#: What an element's attributes say of it.
MARKED, HIDDEN = 1, 2


def _tags(page: str):
    """(text before, tag or None at the end) of a page, in one pass that never reads back.

    A quotation mark opens a value only after =, as browsers read it. Where such a value or a tag doesn't end, tags of the
    rest of the page end at the next >; a < without any > after it is text, an open comment goes to the end.
    """
    at, n, plain = 0, len(page), False
    begun = 0  # where the text before the next tag starts
    while True:
        at = page.find("<", at)
        if at < 0:
            break
        follows = page[at + 1 : at + 2]
        if follows in ("!", "?"):
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                end = n if end < 0 else end + 3
            elif page.startswith("<![CDATA[", at):
                end = page.find("]]>", at)
                end = n if end < 0 else end + 3
            else:
                end = page.find(">", at)
                end = n if end < 0 else end + 1
            yield page[begun:at], None, end
            at = begun = end
            continue
        if not (follows.isascii() and follows.isalpha() or follows == "/" and page[at + 2 : at + 3].isalpha() and page[at + 2].isascii()):
            at += 1
            continue
        end, seek = -1, at + 1
        while not plain:
            m = _STOP.search(page, seek)
            if m is None:
                plain = True
            elif m[1] is None:
                end = m.end()
                break
            else:
                close = page.find(m[1], m.end())
                if close < 0:
                    plain = True
                seek = close + 1
        if plain:
            end = page.find(">", at) + 1
            if not end:
                break
        going = yield page[begun:at], page[at:end], end
        at = begun = end if going is None else going
    yield page[begun:], None, n


def _set_aside(name: str, tag: str, inside_article: bool) -> int:
    """0, MARKED by a word of its attributes (or as a header), HIDDEN by them."""
    found = MARKED if name == "header" and not inside_article else 0
    if " " not in tag and "\n" not in tag and "\t" not in tag:
        return found
    for key, value in _ATTRIBUTE.findall(tag[len(name) + 1 :]):
        key, value = key.lower(), value.strip("\"'")
        if key in ("class", "id", "role", "aria-label") and name not in ("body", "html", "article", "main"):
            if (name in GROUPS and MARKS_INSIDE.search(value)) if inside_article else MARKS.search(value):
                found = MARKED
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return HIDDEN
    return found


def _framed(found: list[tuple[str, int, int, int]], above: list[int]) -> list[tuple[str, int, bool]]:
    """Blocks (text, article, aside, mark) with whether they are set aside; above has the mark around each mark.

    Where no article is free of marks, those of elements that hold most of the articles' text (of all text, if there is no
    article) don't count: they say something of the page around it.
    """
    own = [(len(t), article, mark) for t, article, aside, mark in found if not aside]
    frame = [True] + [False] * (len(above) - 1)
    if not any(article and not mark for _, article, mark in own):
        own = [(n, mark) for n, article, mark in own if article] or [(n, mark) for n, _, mark in own]
        under = [0] * len(above)
        for n, mark in own:
            under[mark] += n
        for mark in range(len(above) - 1, 0, -1):
            under[above[mark]] += under[mark]
        for mark in range(1, len(above)):
            frame[mark] = frame[above[mark]] and under[mark] > FRAME * under[0]
    return [(t, article, aside > 0 or not frame[mark]) for t, article, aside, mark in found]


def blocks(page: str | None) -> list[tuple[str, int, bool]]:
    """(text, 2 inside an article or 1 inside main only or 0, set aside by its markup) of each block of a page, in its order.

    Character references are decoded once, white space is one space; a page that isn't HTML is one block. Script, style,
    textarea and title swallow what is up to their end tag. An element that is set aside and never closed isn't; a button,
    a list of choices and the head end at the next block. A form around an article or main doesn't set it aside, nor does a
    word in the class, id or role of an element (or a header) that holds most of a page's articles or, without any, of its text.
    Time and memory are linear in the page.
    """
    page = page or ""
    out: list[tuple[str, int, int, int]] = []
    open_: list[tuple[str, int, int, int]] = []  # name, article, aside (1 by a form only, 2 else), mark
    above = [0]  # the mark around each mark; 0 is none
    count: dict[str, int] = {}
    block_at: list[int] = []  # where open_ has block elements
    last_end: dict[str, int] = {}
    article = aside = mark = 0
    held: list[str] = []

    def flush():
        if held:
            text = _SPACE.sub(" ", html.unescape("".join(held))).strip()
            held.clear()
            if text:
                out.append((text, article, aside, mark))

    def close(i: int):
        nonlocal article, aside, mark
        left = open_[i - 1][1:] if i else (0, 0, 0)
        # the end of an inline element is no end of a block
        if (left[0], left[1] > 0, left[2]) != (article, aside > 0, mark) or any(o[0] in BLOCK for o in open_[i:]):
            flush()
        for o in open_[i:]:
            count[o[0]] -= 1
        del open_[i:]
        while block_at and block_at[-1] >= i:
            block_at.pop()
        article, aside, mark = left

    def ends_after(name: str, at: int) -> bool:
        if name not in last_end:
            last_end[name] = max((m.start() for m in _END_OF[name].finditer(page)), default=-1)
        return last_end[name] >= at

    tags = _tags(page)
    step = next(tags)
    while True:
        text, tag, at = step
        if text:
            held.append(text)
        going = None
        if tag is not None:
            name = _NAME.match(tag, 1)[1].lower()
            if tag[1] == "/":
                if name in BLOCK:
                    flush()
                if count.get(name):
                    i = len(open_) - 1
                    while open_[i][0] != name:
                        i -= 1
                    close(i)
            elif name in RAW:
                if not tag.endswith("/>"):
                    end = _RAW_END[name].search(page, at)
                    going = len(page) if end is None else (page.find(">", end.end()) + 1 or len(page))
            else:
                if name in BLOCK:
                    flush()
                    if name != "br":
                        for control in CONTROLS:
                            if count.get(control):
                                close(next(i for i in range(len(open_) - 1, -1, -1) if open_[i][0] == control))
                if name not in VOID:
                    if block_at and open_[block_at[-1]][0] in CLOSES.get(name, ()):
                        close(block_at[-1])
                    now_article = max(article, {"article": 2, "main": 1}.get(name, 0))
                    now_aside = 0 if aside == 1 and name in ("article", "main") else aside
                    said, now_mark = _set_aside(name, tag, article > 0), mark
                    if name in CONTROLS or name in ASIDE and ends_after(name, at) or said == HIDDEN or said and article:
                        now_aside = max(now_aside, 1 if name == "form" else 2)
                    elif said and not tag.endswith("/>") and name not in ASIDE:
                        above.append(mark)
                        now_mark = len(above) - 1
                    if (now_article, now_aside > 0, now_mark) != (article, aside > 0, mark):
                        flush()
                    if not tag.endswith("/>"):
                        if name in BLOCK:
                            block_at.append(len(open_))
                        open_.append((name, now_article, now_aside, now_mark))
                        count[name] = count.get(name, 0) + 1
                        article, aside, mark = now_article, now_aside, now_mark
        try:
            step = tags.send(going)
        except StopIteration:
            break
    flush()
    return _framed(out, above)


def zones(page: list[tuple[str, int, bool]]) -> list[int]:
    """Where each block is; the marked article is the innermost kind that the page has, article or else main."""
    kind = max((b[1] for b in page if not b[2]), default=0)
    return [SET_ASIDE if b[2] else INSIDE if kind and b[1] == kind else OUTSIDE for b in page]


def aligned(a: list, b: list) -> list[int]:
    """For each line of a, the line of b that a longest common subsequence pairs it with, or -1.

    By the pairs of equal lines (Hunt and Szymanski, 1977); where lines repeat so often that these are too many, by bit
    vectors, halving a (Crochemore and others, 2001; Hirschberg, 1975), in memory linear in both.
    """
    places: dict = {}
    for j, line in enumerate(b):
        places.setdefault(line, []).append(j)
    if sum(len(places.get(line, ())) for line in a) > MOST_PAIRS:
        out = [-1] * len(a)
        _halved(a, b, 0, 0, out)
        return out
    tails: list[int] = []
    ends: list[tuple] = []
    for i, line in enumerate(a):
        for j in reversed(places.get(line, ())):
            k = bisect.bisect_left(tails, j)
            node = (i, j, ends[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                ends.append(node)
            else:
                tails[k], ends[k] = j, node
    out = [-1] * len(a)
    node = ends[-1] if ends else None
    while node is not None:
        out[node[0]] = node[1]
        node = node[2]
    return out


def _lengths(a: list, b: list) -> np.ndarray:
    """The length of a longest common subsequence of a and each beginning of b."""
    places: dict = {}
    for j, line in enumerate(b):
        places.setdefault(line, []).append(j)

    def mask(at: list[int]) -> int:
        if len(at) <= 64:
            return sum(1 << j for j in at)
        bits = np.zeros(len(b), np.uint8)
        bits[at] = 1
        return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")

    often = {line: mask(at) for line, at in places.items() if len(at) > 64}
    whole = (1 << len(b)) - 1
    v = whole
    for line in a:
        at = places.get(line)
        if at:
            u = v & (often.get(line) or mask(at))
            v = ((v + u) | (v - u)) & whole
    raw = np.frombuffer(v.to_bytes((len(b) + 7) // 8 or 1, "little"), np.uint8)
    return np.concatenate([[0], np.cumsum(1 - np.unpackbits(raw, bitorder="little")[: len(b)].astype(np.int64))])


def _halved(a: list, b: list, i: int, j: int, out: list[int]) -> None:
    """aligned() of a and b, which start at i and j of the whole, into out."""
    least, k = min(len(a), len(b)), 0
    while k < least and a[k] == b[k]:
        out[i + k] = j + k
        k += 1
    a, b, i, j, least = a[k:], b[k:], i + k, j + k, least - k
    k = 0
    while k < least and a[-1 - k] == b[-1 - k]:
        k += 1
        out[i + len(a) - k] = j + len(b) - k
    a, b = a[: len(a) - k], b[: len(b) - k]
    if not a or not b:
        return
    if len(a) == 1:
        if a[0] in b:
            out[i] = j + b.index(a[0])
        return
    half = len(a) // 2
    cut = int(np.argmax(_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]))
    _halved(a[:half], b[:cut], i, j, out)
    _halved(a[half:], b[cut:], i + half, j + cut, out)


def common_lines(a: list, b: list) -> list[bool]:
    """For each line of a, whether it is in the longest common subsequence with b that aligned() finds."""
    return [j >= 0 for j in aligned(a, b)]


def are_copies(a: dict, b: dict) -> bool:
    """Whether two pages (_lines, _sizes, and _wide, the lines on most pages of their host) share most of what isn't on most pages.

    Lines that markup sets aside have no size.
    """
    wide = set(a["_wide"] or ())
    own = [(line, n) for line, n in zip(a["_lines"], a["_sizes"], strict=True) if line not in wide]
    other = [(line, n) for line, n in zip(b["_lines"], b["_sizes"], strict=True) if line not in wide]
    there = {line for line, n in other if n}
    return sum(n for line, n in own if line in there) > COPY * min(sum(n for _, n in own), sum(n for _, n in other))


def shared_lines(row: dict, before: dict | None, after: dict | None) -> list[int] | None:
    """Positions of row's template lines: those that the nearer of its neighbours has too, or either one if equally near.

    A line inside the marked article is template only if the neighbour has it outside of any, and not set aside there
    (menus name other articles). None without a neighbour that isn't a copy.
    """
    mates = [m for m in (before, after) if m is not None and not are_copies(row, m)]
    if not mates:
        return None
    near = max(_near(m["_path"], row["_path"]) for m in mates)
    gone = set()
    for m in mates:
        if _near(m["_path"], row["_path"]) == near:
            for i, j in enumerate(aligned(row["_lines"], m["_lines"])):
                if j >= 0 and (row["_zones"][i] != INSIDE or m["_zones"][j] == OUTSIDE):
                    gone.add(i)
    return sorted(gone)


def gone_lines(row: dict, before: dict | None, after: dict | None) -> list[int] | None:
    """shared_lines() that markup doesn't set aside anyway."""
    gone = shared_lines(row, before, after)
    return None if gone is None else [i for i in gone if row["_zones"][i] != SET_ASIDE]


def is_open(page: list[tuple[str, int, bool]]) -> bool:
    """Whether a page's text depends on its having a mate: it has a marked article and text outside of it that isn't set aside."""
    at = zones(page)
    return INSIDE in at and OUTSIDE in at


def main_text(page: list[tuple[str, int, bool]], gone: list[int] | None) -> str:
    """The blocks without those set aside and those at the positions in gone.

    Without a mate (gone is None) markup alone decides: only what is inside article or main is left, if there is any.
    """
    at, left = zones(page), set(gone or ())
    if gone is None and any(b[1] and not b[2] for b in page):
        return "\n".join(b[0] for b in page if b[1] and not b[2])
    return "\n".join(b[0] for i, b in enumerate(page) if at[i] != SET_ASIDE and i not in left)


def path_of(url: str | None) -> tuple[str, str]:
    """(host, path) of a URL; host in lower case without www. and port, path without query and fragment."""
    try:
        parts = urlsplit((url or "").strip())
        host = (parts.hostname or "").removeprefix("www.")
    except ValueError:
        return "", (url or "")
    return host, parts.path.rstrip("/")


def _near(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


#: A run of near copies at the start of a range, at its end, or filling it.
HEAD, TAIL, WHOLE = 1, 2, 3
_LINE_FIELDS = [T.StructField("_host", T.StringType()), T.StructField("_path", T.StringType()), T.StructField("_open", T.BooleanType()), T.StructField("_same", T.LongType()), T.StructField("_lines", T.ArrayType(T.LongType())), T.StructField("_sizes", T.ArrayType(T.IntegerType())), T.StructField("_zones", T.ArrayType(T.IntegerType()))]
_PAGE = ("_host", "_same", "_path", "_open", "_lines", "_sizes", "_zones", "_wide")


def extract(pages: DataFrame, page: str = "html", url: str = "url", order: str = "page_id") -> DataFrame:
    """pages without the html, with text and n_chars: the main text of each whole page and its code points.

    First each page becomes the hashes and lengths of its lines, which are all that a neighbour needs. Equal pages of a host
    are one. A page's mates are the nearest pages before and after it in the order of (host, path, order) beyond the run of
    near copies around it; the one with the longer common path beginning counts, equally near ones both do. Pages are dealt
    by ranges of that order, so a host of any size is spread. Then the positions of template lines join their pages. A null
    or empty page has the empty text; a null or broken URL belongs to the host ""; pages of equal URL, id and html have
    equal texts; an empty table gives an empty result. Columns of pages named text or n_chars are replaced, all others stay.
    """
    kept = [c for c in pages.columns if c not in (page, "text", "n_chars")]
    own = free_names([*pages.columns, "text", "n_chars"])
    needed = list(dict.fromkeys([*kept, page, url, order]))
    names = {c: f"{own}{i}" for i, c in enumerate(needed)}
    keyed = pages.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    keyed = keyed.withColumn("_key", F.xxhash64(names[order], names[url], names[page]))
    gone = template_lines(keyed.select(F.col(names[url]).alias("url"), F.col(names[page]).alias("html"), F.col(names[order]).alias("order"), "_key"))

    def make_text():
        def step(htmls, gone_):
            texts = [main_text(blocks(h.as_py()), g.as_py()) for h, g in zip(htmls, gone_, strict=True)]
            return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

        return step

    fields = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    made = arrow_columns(joined_small(keyed, gone, ["_key"]), [names[page], "_gone"], fields, make_text, [names[c] for c in kept])
    return made.select(*(F.col(names[c]).alias(c) for c in kept), "text", "n_chars")


def template_lines(keyed: DataFrame) -> DataFrame:
    """(_key, _gone): the positions of template lines of the pages whose text isn't what markup alone gives.

    keyed: url, html, order, _key. Only hashes, sizes and zones of lines are shuffled.
    """

    def make_lines():
        def step(urls, htmls):
            where = [path_of(u.as_py()) for u in urls]
            cut = [blocks(h.as_py()) for h in htmls]
            zone = [zones(c) for c in cut]
            return [
                pa.array([w[0] for w in where], pa.string()), pa.array([w[1] for w in where], pa.string()), pa.array([is_open(c) for c in cut], pa.bool_()),
                pa.array([xxhash.xxh3_64_intdigest(repr([(b[0], z) for b, z in zip(c, at, strict=True)]).encode()) - (1 << 63) for c, at in zip(cut, zone, strict=True)], pa.int64()),
                pa.array([[xxhash.xxh3_64_intdigest(b[0]) - (1 << 63) for b in c] for c in cut], pa.list_(pa.int64())),
                pa.array([[0 if b[2] else len(b[0]) for b in c] for c in cut], pa.list_(pa.int32())), pa.array(zone, pa.list_(pa.int32())),
            ]

        return step

    lined = checkpointed(arrow_columns(keyed, ["url", "html"], _LINE_FIELDS, make_lines, ["order", "_key"]))
    first_of = F.min(F.struct("_path", "order", "_key", "_open", "_lines", "_sizes", "_zones")).alias("x")
    distinct = checkpointed(lined.groupBy("_host", "_same").agg(first_of).select("_host", "_same", "x.*"))
    on = distinct.select("_host", F.explode(F.array_distinct("_lines")).alias("_line")).groupBy("_host", "_line").agg(F.count("*").alias("_n")).where(F.col("_n") >= WIDE)
    hosts = distinct.groupBy("_host").agg(F.count("*").alias("_pages")).where(F.col("_pages") >= WIDE)
    wide = joined_small(on, checkpointed(hosts), ["_host"], "inner").where("2 * _n > _pages").groupBy("_host").agg(F.collect_list("_line").alias("_wide"))
    ordered = joined_small(distinct, checkpointed(wide), ["_host"]).repartitionByRange(F.col("_host"), F.col("_path"), F.col("order"), F.col("_key")).sortWithinPartitions("_host", "_path", "order", "_key")
    ordered = checkpointed(ordered.select(*_PAGE, F.monotonically_increasing_id().alias("_at")))
    found = _differenced(ordered).where(F.col("_open") | (F.size("_gone") > 0)).select("_host", "_same", "_gone")
    return checkpointed(joined_small(lined.select("_key", "_host", "_same"), checkpointed(found), ["_host", "_same"], "inner").select("_key", "_gone").dropDuplicates(["_key"]))


def _differenced(ordered: DataFrame) -> DataFrame:
    """_host, _same, _open, _gone of each page with a mate. ordered: pages in ranges, with _at rising over all of them.

    A run of near copies inside a range has its mates there. Of a run at an end of a range, the mates are found from one
    short row of numbers a range, and only the mates themselves then travel to the run's pages.
    """
    spark = ordered.sparkSession
    page = [ordered.schema[c] for c in _PAGE]
    schema = T.StructType([*page, T.StructField("_gone", T.ArrayType(T.IntegerType())), T.StructField("_part", T.LongType()), T.StructField("_role", T.IntegerType()), T.StructField("_before", T.LongType()), T.StructField("_after", T.LongType()), T.StructField("_first", T.LongType()), T.StructField("_last", T.LongType())])

    def run(batches):
        before, known, now, part, first, last = None, False, [], None, None, None
        slim = dict.fromkeys(_PAGE)

        def ended(after, after_known):
            if known and after_known:
                return [slim | {c: r[c] for c in ("_host", "_same", "_open")} | {"_gone": gone, "_role": 0} for r in now if (gone := gone_lines(r, before, after)) is not None]
            role = HEAD if after_known else TAIL if known else WHOLE
            at = lambda r: -1 if r is None else r["_at"]
            return [{c: r[c] for c in _PAGE} | {"_part": part, "_role": role, "_before": at(before), "_after": at(after), "_first": first, "_last": r["_at"] if r is now[-1] else None} for r in now]

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if part is None:
                    part, first = row["_at"] >> 33, row["_at"]
                same_host = bool(now) and now[-1]["_host"] == row["_host"]
                if same_host and are_copies(now[-1], row):
                    now.append(row)
                    continue
                if now:
                    out += ended(row if same_host else None, True)
                    before, known = now[-1] if same_host else None, True
                now = [row]
            if out:
                yield _batch(out, schema)
        if now:
            yield _batch(ended(None, False), schema)

    passed = checkpointed(ordered.mapInArrow(run, schema))
    runs = passed.where("_role > 0")
    # one row a range: where it and its outer runs begin and end
    ends = {r["_part"]: r for r in runs.groupBy("_part").agg(
        F.max("_first").alias("first"), F.max("_last").alias("last"), F.max(F.col("_role") == WHOLE).alias("whole"),
        F.max(F.when(F.col("_role") == HEAD, F.col("_after"))).alias("head_after"), F.max(F.when(F.col("_role") == TAIL, F.col("_before"))).alias("tail_before"),
    ).collect()}
    parts = sorted(ends)
    meets = spark.createDataFrame([(ends[a]["last"], ends[b]["first"], b) for a, b in zip(parts, parts[1:], strict=False)], "_l long, _f long, _part long")

    def make_relation():
        def step(left, right):
            pairs = zip(left.to_pylist(), right.to_pylist(), strict=True)
            return [pa.array([0 if a["_host"] != b["_host"] else 2 if are_copies(a, b) else 1 for a, b in pairs], pa.int32())]

        return step

    whole_page = F.struct(*_PAGE)
    sides = ordered.join(F.broadcast(meets), F.col("_at") == F.col("_l")).select("_part", "_f", whole_page.alias("a"))
    sides = sides.join(ordered.select(F.col("_at").alias("_f"), whole_page.alias("b")), "_f")
    relation = {r["_part"]: r["rel"] for r in arrow_columns(sides, ["a", "b"], [T.StructField("rel", T.IntegerType())], make_relation, ["_part"]).collect()}
    head_before, tail_after = _outer_mates(parts, ends, relation)
    plan = []
    for p in parts:
        if ends[p]["whole"]:
            plan.append((p, WHOLE, head_before[p], tail_after[p]))
        else:
            plan += [(p, HEAD, head_before[p], ends[p]["head_after"]), (p, TAIL, ends[p]["tail_before"], tail_after[p])]
    # two short rows a range
    wanted = spark.createDataFrame([(p, role, at, side) for p, role, *both in plan for side, at in enumerate(both) if at >= 0], "_part long, _role int, _at long, _side int")
    mates = ordered.join(F.broadcast(wanted), "_at").select("_part", "_role", "_side", whole_page.alias("m"))
    mates = mates.groupBy("_part", "_role").agg(*(F.first(F.when(F.col("_side") == s, F.col("m")), ignorenulls=True).alias(n) for s, n in enumerate(("before", "after"))))

    def make_gone():
        def step(rows, before, after):
            return [pa.array([gone_lines(*x) for x in zip(rows.to_pylist(), before.to_pylist(), after.to_pylist(), strict=True)], pa.list_(pa.int32()))]

        return step

    at_ends = runs.select("_part", "_role", whole_page.alias("row")).join(mates, ["_part", "_role"])
    late = arrow_columns(at_ends.select("row", "before", "after", "row._host", "row._same", "row._open"), ["row", "before", "after"], [T.StructField("_gone", T.ArrayType(T.IntegerType()))], make_gone, ["_host", "_same", "_open"])
    columns = ["_host", "_same", "_open", "_gone"]
    return passed.where("_role = 0").select(*columns).unionByName(late.select(*columns)).where("_gone IS NOT NULL")


def _outer_mates(parts: list[int], ends: dict, relation: dict[int, int]) -> tuple[dict[int, int], dict[int, int]]:
    """For each range, the page before the run at its start and the one after the run at its end, or -1.

    relation: how a range's first page and the last page before it are related: 0 other hosts, 1 one host, 2 copies.
    """
    head_before, tail_after = {}, {}
    for i, p in enumerate(parts):
        rel = relation.get(p, 0) if i else 0
        q = parts[i - 1] if i else None
        head_before[p] = -1 if rel == 0 else ends[q]["last"] if rel == 1 else head_before[q] if ends[q]["whole"] else ends[q]["tail_before"]
    for i in range(len(parts) - 1, -1, -1):
        p, q = parts[i], parts[i + 1] if i + 1 < len(parts) else None
        rel = relation.get(q, 0) if q is not None else 0
        tail_after[p] = -1 if rel == 0 else ends[q]["first"] if rel == 1 else tail_after[q] if ends[q]["whole"] else ends[q]["head_after"]
    return head_before, tail_after


def _batch(rows: list[dict], schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_type

    columns = [pa.array([r.get(f.name) for r in rows], to_arrow_type(f.dataType)) for f in schema]
    return pa.RecordBatch.from_arrays(columns, names=schema.names)


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page: page_id, url, text, n_chars."""
    return extract(table(spark, sf_dir, "pages", "page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
