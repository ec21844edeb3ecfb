"""Page extraction against a plain version on generated hosts, and pages that break tokenizers."""

import random
import time

import pytest

from memoglyph.llm import html_text

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon".split()


def longest(a, b):
    """Pairs of a longest common subsequence of lines, by the whole table; how many there are is what counts."""
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            t[i][j] = t[i + 1][j + 1] + 1 if a[i] == b[j] else max(t[i + 1][j], t[i][j + 1])
    i = j = 0
    out = {}
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out[i] = j
            i, j = i + 1, j + 1
        elif t[i + 1][j] >= t[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def plain(rows):
    """The contract word by word, one host at a time, with everything in memory. Lines of a page are distinct here."""
    hosts = {}
    for page_id, url, page in rows:
        host, path = html_text.path_of(url)
        cut = html_text.blocks(page)
        hosts.setdefault(host, {}).setdefault(tuple(zip((b[0] for b in cut), html_text.zones(cut), strict=True)), []).append((path, page_id, cut))
    out = {}
    for groups in hosts.values():
        pages = sorted((min(g, key=lambda x: x[:2]), g) for g in groups.values())
        sets = [{b[0] for b in first[2]} for first, _ in pages]
        wide = {line for s in sets for line in s if len(pages) >= 3 and (n := sum(line in t for t in sets)) >= 3 and 2 * n > len(pages)}

        def copies(x, y):
            size = lambda p: {b[0]: 0 if b[2] else len(b[0]) for b in p[2] if b[0] not in wide}  # noqa: E731, B023
            a, b = size(x), size(y)
            return sum(n for line, n in a.items() if b.get(line)) > 0.8 * min(sum(a.values()), sum(b.values()))

        runs = []
        for first, _ in pages:
            if runs and copies(runs[-1][-1], first):
                runs[-1].append(first)
            else:
                runs.append([first])
        at_run = {id(p): k for k, run in enumerate(runs) for p in run}
        for first, group in pages:
            k = at_run[id(first)]
            mates = [m for m in ([runs[k - 1][-1]] if k else []) + ([runs[k + 1][0]] if k + 1 < len(runs) else []) if not copies(first, m)]
            cut, zone = first[2], html_text.zones(first[2])
            gone = None
            if mates:
                near = max(html_text._near(m[0], first[0]) for m in mates)
                gone = set()
                for m in mates:
                    if html_text._near(m[0], first[0]) == near:
                        other = html_text.zones(m[2])
                        gone |= {i for i, j in longest([b[0] for b in cut], [b[0] for b in m[2]]).items() if zone[i] != 1 or other[j] == 0}
            if gone is None and any(b[1] and not b[2] for b in cut):
                lines = [b[0] for b in cut if b[1] and not b[2]]
            else:
                lines = [b[0] for i, b in enumerate(cut) if not b[2] and i not in (gone or ())]
            out |= {page_id: "\n".join(lines) for _, page_id, _ in group}
    return out


def site(seed, n):
    """Pages of one host: a template in fixed order, some with marks, some copies, near copies and quoted passages."""
    r = random.Random(seed)
    say = lambda k: " ".join(r.choice(WORDS) + str(r.randint(0, 99)) for _ in range(k))
    top, bottom, quote = say(6), say(5), say(8)
    marked = r.random() < 0.5
    rows, last = [], None
    for i in range(n):
        body = [say(r.randint(3, 12)) for _ in range(r.randint(1, 6))]
        if last and r.random() < 0.2:
            body = list(last) + ([say(3)] if r.random() < 0.5 else [])
        if r.random() < 0.3:
            body.insert(0, quote)
        last = body
        inner = "".join(f"<p>{b}" for b in body)
        rows.append((f"http://h{seed}.org/{r.choice(['a', 'b/c', 'b/d'])}/{i}", f"<nav><a>{say(1)}</a></nav><div>{top}</div>{f'<article>{inner}</article>' if marked else inner}<div>{bottom}</div><footer>{bottom} {say(1)}</footer>"))
    return rows


def test_extraction_equals_the_plain_version(spark):
    pages = [row for seed in range(12) for row in site(seed, 3 + seed * 2)]
    rows = [(i, url, page) for i, (url, page) in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = plain(rows)
    assert sum(len(t) for t in want.values()) < sum(len("\n".join(b[0] for b in html_text.blocks(p) if not b[2])) for _, _, p in rows)  # differencing decides
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in (1, 6, 40):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            got = {r["page_id"]: r["text"] for r in html_text.extract(df).collect()}
            assert {k: got[k] for k in got if got[k] != want[k]} == {}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def lines(page):
    return html_text.main_text(html_text.blocks(page), None).split("\n")


def test_nothing_of_an_article_is_lost():
    assert lines("<article>" + "İ" * 40 + "<script>var x;</script><p>one<p>two</article>") == ["İ" * 40, "one", "two"]
    assert lines("<article><p>a</p><button>Go<p>body text") == ["a", "body text"]
    for name in ("select", "iframe", "object", "noscript"):
        assert lines(f"<article><p>a</p><{name}>x<p>body text</article>")[-1] == "body text"
    assert lines('<article><p class="search">s</p><section id="legal"><p>l</section><p class="tags notice">t</p><h2 class="share">h</h2><div class="form alert">d</div></article>') == ["s", "l", "t", "h", "d"]
    assert lines('<article><p>a</p><div class="ad">buy</div><section id="comments"><p>nice</section><p>b</article>') == ["a", "b"]
    assert lines("<form id=f><article><p>kept</article><p>gone</form>") == ["kept"]
    assert lines('<article><p title="a > b">x</p><a href=it\'s>y</a> 1 < 2 <3 </article>') == ["x", "y 1 < 2 <3"]
    assert lines("<head><meta><p>no end of head<p>more") == ["no end of head", "more"]
    assert lines("<noscript><p>off</p></noscript><p>on") == ["on"]
    assert lines("<SCRIPT>a</p></SCRIPTx>b</ScRiPt >c") == ["c"]
    assert lines('<p>a</p><a "<p>b</p><i x="<p>c') == ["a", "b", "c"] or lines('<p>a</p><a "<p>b</p>')[-1] == "b"


ARTICLE = "<h2>Title</h2><p>The long text of the article goes here and on, as articles do.</p>"


@pytest.mark.parametrize("page", [
    f'<div class="layout has-sidebar"><article>{ARTICLE}</article><div class="sidebar">side</div></div>',
    f'<div class="post no-comments"><article>{ARTICLE}</article></div>',
    f'<div class="modal-open"><main>{ARTICLE}</main></div>',
    f'<div id="search-page"><main>{ARTICLE}</main><div class="search">find</div></div>',
    f"<header><article>{ARTICLE}</article></header>",
    f'<div class="page with-header">{ARTICLE}<div class="menu">menu</div></div>',
    f'<div class="has-sidebar"><div class="no-comments"><article>{ARTICLE}</article></div><nav>there</nav></div>',
    f'<div class="has-sidebar"><article>{ARTICLE}</article><div id="comments"><article>nice</article></div></div>',
    f'<article>{ARTICLE}<div class="share">tell</div><div class="related">more</div><section class="comments">nice</section></article>',
    f'<article>{ARTICLE}</article><div id="comments"><article>{"nice " * 50}</article></div>',
])
def test_words_on_ancestors_lose_no_article(page):
    assert html_text.main_text(html_text.blocks(page), None) == "Title\nThe long text of the article goes here and on, as articles do."


@pytest.mark.parametrize("page", [f"<nav>{ARTICLE}</nav>", f"<footer><article>{ARTICLE}</article></footer>", f'<div hidden class="page">{ARTICLE}</div>', '<div class="menu">menu</div><div class="footer">foot</div>'])
def test_menus_and_hidden_parts_stay_out(page):
    assert html_text.main_text(html_text.blocks(page), None) == ""


def test_a_page_of_a_line_of_an_unmarked_neighbour():
    """A line inside an article goes if the neighbour has it outside of any, and stays if menus have it."""
    page = lambda p: {"_path": "/a", "_wide": None} | dict(zip(("_lines", "_sizes", "_zones"), zip(*p, strict=True), strict=True))
    row = page([("banner", 6, 1), ("mine", 40, 1), ("title", 5, 1)])
    assert html_text.gone_lines(row, None, page([("banner", 6, 0), ("other", 50, 1), ("title", 0, 2)])) == [0]
    assert html_text.gone_lines(row, None, None) is None


@pytest.mark.parametrize("piece", ["<b></i>", '<a "', '<a x="', "<a x='", "<b>", "<b><p></p>", "<p>x", "<", "<!--", "<div class='ad'>", "<nav>", "<script>", "</", "<button>", "&lt;", "<a x=\"'", "<td>"])
def test_very_long_pages_take_linear_time(piece):
    began = time.perf_counter()
    html_text.blocks(piece * (1_000_000 // len(piece)))
    assert time.perf_counter() - began < 20


def test_alignment_of_often_repeated_lines(monkeypatch):
    r = random.Random(9)
    for most in (2_000_000, 0):
        monkeypatch.setattr(html_text, "MOST_PAIRS", most)
        for _ in range(200):
            a, b = ([r.choice("abcd") for _ in range(r.randint(0, 12))] for _ in range(2))
            got = [(i, j) for i, j in enumerate(html_text.aligned(a, b)) if j >= 0]
            assert len(got) == len(longest(a, b)) and all(a[i] == b[j] for i, j in got)
            assert all(p[1] < q[1] for p, q in zip(got, got[1:], strict=False))
    began = time.perf_counter()
    a, b = (["x" if r.random() < 0.6 else r.choice("abc") for _ in range(15_000)] for _ in range(2))
    assert sum(html_text.common_lines(a, b)) > 9000 and time.perf_counter() - began < 30
