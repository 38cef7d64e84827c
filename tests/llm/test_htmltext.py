import random
import time

from agora.llm import htmltext
from agora.llm.htmltext import ARTICLE, OPEN, OUTSIDE, common_lines, extract_text, judged_lines, main_text, nearest_addresses, page_lines
from tests.llm.cases import clashing, prose

PAGES = "page_id long, url string, html string"


def semantic(title, paragraphs):
    return (
        "<!DOCTYPE html><html><head><title>t</title><style>p{a:b}</style><script>var t='</p><p>no';</script></head><body class='no-sidebar'>"
        "<nav><ul><li><a href='/a'>Menu one</a><li>Menu two</ul></nav><!-- <p>hidden</p> --><div class=ad>Buy &amp; buy</div>"
        f"<article class='post'><header>Site top</header><h1>{title}</h1>" + "".join(f"<p><b>{p}<br><p>{p} again</p>" for p in paragraphs)
        + "<form><input value=x>Send</form><aside>Aside</aside><div class='comments'><p>First!</p></div></article>"
        "<footer>&copy; foot</footer></body></html>"
    )


def plain(host, k, body):
    top = "".join(f"<div>{host} menu {i}</div>" for i in range(4))
    return f"<html><body>{top}<table><tr><td>{body}</table><div>{host} bottom &middot; line</div></body></html>"


def test_semantic_pages():
    page = semantic("A &lt;title&gt;", ["one \n\t two&nbsp;three", "x &amp; y &#8212; z"])
    assert main_text(page_lines(page), set()).split("\n") == [
        "A <title>", "one two three", "one two three again", "x & y — z", "x & y — z again",
    ]
    zones = {t: z for z, t in page_lines(page)}
    assert zones["Menu one"] == zones["Buy & buy"] == zones["© foot"] == zones["First!"] == OUTSIDE
    assert zones["A <title>"] == ARTICLE and not any("no" == t for t in zones)
    assert page_lines("<p>a<p>b<div>c")[0] == (OPEN, "a")


def test_odd_pages():
    for page in (None, "", "   ", "<", "<<>>", "<p", "text only", "</div></p>x", "<!-- open", "<script>never closed", "<p>" * 5000 + "deep", "<div " * 50):
        page_lines(page)
    assert page_lines("text only") == [(OPEN, "text only")]
    assert page_lines("a<script>x</script>b") == [(OPEN, "ab")]


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            t[i][j] = t[i + 1][j + 1] + 1 if a[i] == b[j] else max(t[i + 1][j], t[i][j + 1])
    return t[0][0]


def test_common_lines_are_longest():
    r = random.Random(4)
    for _ in range(300):
        a, b = ([r.randint(0, 6) for _ in range(r.randint(0, 14))] for _ in range(2))
        got = common_lines(a, b)
        assert got == sorted(set(got)) and len(got) == lcs(a, b)
        it = iter(b)
        assert all(a[i] in it for i in got)  # a subsequence of b


def test_many_equal_lines_end_soon(monkeypatch):
    began = time.time()
    a, b = [1] * 50_000, [2] + [1] * 49_000 + [3]
    assert len(common_lines(a, b)) == 49_000
    assert time.time() - began < 30
    monkeypatch.setattr(htmltext, "KEPT_BITS", 40)  # halved again and again
    r = random.Random(8)
    for _ in range(200):
        a, b = ([r.randint(0, 3) for _ in range(r.randint(0, 30))] for _ in range(2))
        got = htmltext._aligned(a, b)
        assert len(got) == lcs(a, b) and got == sorted(set(got))
        it = iter(b)
        assert all(a[i] in it for i in got)


def test_wrappers_do_not_empty_a_page():
    def text(page):
        return main_text(page_lines(page), set())

    body = "<h1>T</h1><p>One.</p><div class='comments'><article class='comment'><p>First!</p></article></div>"
    for wrapped in (
        f"<div class='site has-sidebar'><article>{body}</article></div>", f"<form><main>{body}</main></form>", f"<div class='layout share-enabled'><article>{body}</article></div>",
        f"<div class='widget'><div class='menu x'>Menu</div><article>{body}</article></div>", f"<form><article>{body}</article><input></form>",
    ):
        assert text(wrapped) == "T\nOne.", wrapped
    # an article elsewhere: the one in the sidebar is a teaser
    assert text(f"<div class='sidebar'><article>Teaser</article></div><article>{body}</article>") == "T\nOne."
    assert text("<div class='comments'><article>A reader</article></div><p>Open.</p>") == "Open."


def spec(seed):
    """Lines with their zones, and the page they make."""
    r = random.Random(seed)
    marks = {OUTSIDE: ["<nav>{}</nav>", "<div class='ad x'>{}</div>", "<footer>{}</footer>"], OPEN: ["<p>{}</p>", "<div><div>{}</div></div>"], ARTICLE: ["<article>{}</article>"]}
    zones = [OUTSIDE, OPEN, ARTICLE] if seed % 3 else [OUTSIDE, OPEN]
    lines = [(r.choice(zones), f"line {r.randint(0, 9)}" if r.random() < 0.7 else f"own {seed} {k}") for k in range(r.randint(0, 12))]
    return lines, "<html><body>" + "".join(r.choice(marks[z]).format(t) for z, t in lines) + "</body></html>"


def test_whole_query_against_brute_force(spark):
    specs = {k: spec(k) for k in range(60)}
    where = {k: ("h.example.com" if k % 4 else "g.example.com", f"/{k % 7}/{k:03d}") for k in specs}
    rows = [(k, f"https://{where[k][0]}{where[k][1]}?q={k}", page) for k, (_, page) in specs.items()]
    order = sorted(specs, key=lambda k: where[k])

    def near(k, j):
        if not 0 <= j < len(order) or where[order[j]][0] != where[k][0]:
            return -1
        x, y = where[k][1], where[order[j]][1]
        return next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))

    got = {r.page_id: r for r in extract_text(spark.createDataFrame(rows, PAGES).repartition(6)).collect()}
    deleted = 0
    for at, k in enumerate(order):
        lines = specs[k][0]
        partner = order[at - 1] if near(k, at - 1) >= near(k, at + 1) else order[at + 1]
        mine, other = [t for _, t in lines], [t for _, t in specs[partner][0]]
        # any longest common subsequence will do: the places are the operator's, their number is not
        shared = set(common_lines(mine, other))
        assert got[k].shared_lines == len(shared) == lcs(mine, other) and got[k].n_lines == len(lines)
        has_article = any(z == ARTICLE for z, _ in lines)
        open_stays = lambda i: not has_article and (i not in shared or len(shared) == len(lines))
        want = [t for i, (z, t) in enumerate(lines) if z == ARTICLE or (z == OPEN and open_stays(i))]
        assert got[k].text == "\n".join(want) and got[k].n_chars == len(got[k].text)
        assert got[k].n_lines == len(want) + got[k].lines_by_pair + got[k].lines_by_zone + got[k].lines_by_article
        deleted += got[k].lines_by_pair
    assert deleted > 20 and judged_lines([], set()) == ([], 0, 0, 0)


def test_differencing_finds_template_lines(spark):
    rows, want = [], {}
    for k in range(40):
        host = "one" if k % 3 else "two"
        body = prose(k, 50).replace("\n", " ")
        rows.append((k, f"http://{host}.example.com/section/{k:03d}?q=1#x", plain(host, k, body)))
        want[k] = " ".join(body.split())
    rows += [
        (50, None, None), (51, "http://alone.example.com/", plain("alone", 0, "only page")), (52, "not a url", "<p>x</p>"),
        (None, "http://one.example.com/section/001", semantic("T", ["p"])), (53, "http://copy.example.com/a", plain("copy", 1, "same")),
        (54, "http://copy.example.com/b", plain("copy", 1, "same")), (55, "http://big.example.com/", plain("big", 0, "word " * 300_000)),
    ]
    got = {r.page_id: r for r in extract_text(clashing(spark.createDataFrame(rows, PAGES).repartition(5))).collect()}
    assert len(got) == len(rows)
    for k, text in want.items():
        assert got[k].text == text and got[k].n_chars == len(text) and got[k].shared_lines == 5
    assert got[50].text == "" and got[52].text == "x" and got[None].text == "T\np\np again"
    assert got[51].text.startswith("alone menu 0") and got[51].shared_lines == 0  # no other page to compare with
    assert got[53].text == got[54].text != ""  # copies keep their text
    assert got[55].n_chars > 1_400_000


def test_nearest_across_partitions(spark):
    rows = [(i, 0, "h" if i % 5 else "g", f"/{i // 4:03d}/{i:04d}") for i in range(200)]
    got = {r.id: r.partner for r in nearest_addresses(spark.createDataFrame(rows, "id long, sig long, host string, path string")).collect()}
    order = sorted(rows, key=lambda r: (r[2], r[3], r[0]))

    def share(a, b):
        if a[2] != b[2]:
            return -1
        n = 0
        while n < min(len(a[3]), len(b[3])) and a[3][n] == b[3][n]:
            n += 1
        return n

    for k, row in enumerate(order):
        best = max([share(row, order[j]) for j in (k - 1, k + 1) if 0 <= j < len(order)])
        chosen = next(r for r in rows if r[0] == got[row[0]])
        assert share(row, chosen) == best


def test_empty_table(spark):
    assert extract_text(spark.createDataFrame([], PAGES)).count() == 0
