import numpy as np

from quillspark.llm.html_text import LONG, blocks_of, covered_by, main_texts, windows_on_pages

MENU = "<div>Home About Contact us Our very long menu line goes here</div>"
FOOT = "<div>Copyright all rights reserved by this very nice site of ours</div>"


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def texts(df):
    return {r.page_id: r.text for r in df.collect()}


def test_structure_settles_most_parts(spark):
    html = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><a href="/x">Menu</a></nav><!-- c > d -->
    <div class="ad">Buy</div><div class="cookie-notice">Cookies</div><aside>Side</aside><form>Name <input value="a>b"> <button>Go</button></form>
    <article><header><h1>A &eacute;&nbsp;title</h1></header><p>One <b>bo</b>ld<p>Two<br>three &lt;x&gt; &amp<script>var t = "</p>"; if (a < b) {}</script>
    <section id="comments">Nice</section><article class="comment" id="c1">Me, too</article><p hidden>Gone</p></article><footer>&copy; us</footer>"""
    assert texts(main_texts(pages(spark, [(1, "http://a.com", html)]))) == {1: "A é title One bold Two three <x> &"}


def test_runs_of_a_site_go_and_unique_runs_stay(spark):
    rows = [(i, f"http://a.com/{i}", f"<body>{MENU}<div><p>Unique text number {i} with words w{i} x{i} y{i} z{i} q{i} r{i}</p></div>{FOOT}</body>") for i in range(6)]
    rows += [(8, "http://b.com/", f"<body>{MENU}</body>"), (9, None, None), (10, "http://a.com/10", ""), (11, "http://a.com/11", "plain words only")]
    rows += rows[:1]
    expected = {i: f"Unique text number {i} with words w{i} x{i} y{i} z{i} q{i} r{i}" for i in range(6)} | {8: "Home About Contact us Our very long menu line goes here", 9: "", 10: "", 11: "plain words only"}
    df = pages(spark, rows).selectExpr("*", "page_id AS key", "url AS site", "page_id AS cell")
    for cell_pages in (64, 2, 1):
        found = main_texts(df, cell_pages=cell_pages)
        assert texts(found) == expected and found.count() == len(rows)
    assert main_texts(pages(spark, [])).collect() == []


def test_a_page_repeated_as_it_is_keeps_its_text(spark):
    html = "<body><div>One two three four five six seven eight nine ten</div></body>"
    assert set(texts(main_texts(pages(spark, [(1, "http://a.com", html)] * 3))).values()) == {"One two three four five six seven eight nine ten"}


def test_suffix_array_against_brute_force(rng):
    for _ in range(60):
        page = np.sort(np.array([rng.randrange(4) for _ in range(80)]))
        stream = np.array([rng.randrange(3) for _ in range(80)], dtype=np.uint64)
        order, group, distinct = windows_on_pages(stream, page, 4)
        seen = {}
        for i in range(77):
            if page[i] == page[i + 3]:
                seen.setdefault(tuple(stream[i : i + 4]), set()).add(page[i])
        found = {int(i): int(distinct[g]) for i, g in zip(order, group)}
        assert found == {i: len(seen[tuple(stream[i : i + 4])]) for i in range(77) if page[i] == page[i + 3]}
        starts = [tuple(stream[i : i + 4]) for i in order]
        assert starts == sorted(starts)
    assert covered_by(np.array([2, 3]), 10, 4).tolist() == [False] * 2 + [True] * 5 + [False] * 3


def test_odd_markup():
    assert blocks_of("a < b <p>c</p> <unclosed") == [(0, "a < b"), (0, "c"), (0, "<unclosed")]
    assert blocks_of("<script>never closed <p>x</p>") == []
    assert [t for _, t in blocks_of("<head><title>T</title><body><article><p>Body</article>")] == ["Body"]
    assert [t for _, t in blocks_of('<script>if(a<b){x()}</script><article>One</article><SCRIPT>var t = "</p>"</SCRIPT >two')] == ["One", "two"]
    for left_open in ("<button>", "<svg>", "<select>", "<video src=x>"):
        assert [t for _, t in blocks_of(f"{left_open}<article>All of it</article>")] == ["All of it"]
    assert [t for _, t in blocks_of("<button>a<p>kept</p><button>b</button><svg><text>c</text></svg>")][-1:] != ["c"]
    assert [s for s, _ in blocks_of('<article><p>x</p><ol class="responses"><li>Nice!</li></ol></article>')] == [1, -1]
    assert blocks_of("<p>" + "x" * 200_000)[0][1] == "x" * 200_000
    assert blocks_of("</div></p>text")[0] == (0, "text")


def test_names_of_parts():
    from quillspark.llm.html_text import _names_chrome

    chrome = "ad sidebar article-comments mainNav siteFooter cookie-notice page-header post-share skip-link adBox comment-list related"
    text = "content has-sidebar article-header entry-content layout-with-nav main read adage headline post-tags story story-body navyblue"
    assert [x for x in chrome.split() if _names_chrome(x) != -1] == [] and [x for x in text.split() if _names_chrome(x)] == []
    assert {_names_chrome(x) for x in "related-work skip-lists toc-entry notice-board article-widget-free post-ad-tech adTech1".split()} == {2}


def test_blocks_beside_an_article(spark):
    site = lambda i: f"<body>{MENU}<div>Its own lead {i} a{i} b{i} c{i} d{i} e{i} f{i}</div><article><p>Text {i}</p></article>{FOOT}</body>"
    rows = [(i, f"http://a.com/{i}", site(i)) for i in range(4)] + [(9, "http://b.com/", "<article>Alone</article><footer>foot</footer>")]
    assert texts(main_texts(pages(spark, rows))) == {i: f"Its own lead {i} a{i} b{i} c{i} d{i} e{i} f{i} Text {i}" for i in range(4)} | {9: "Alone"}


def brute_force(rows):
    """Main texts by looking at every run of LONG tokens of every page of the site."""
    where = {}
    for i, url, html in rows:
        tokens = [w for standing, text in blocks_of(html) if standing != 1 for w in text.lower().split()]
        for k in range(len(tokens) - LONG + 1):
            where.setdefault((url.split("/")[2], *tokens[k : k + LONG]), set()).add(i)
    out = {}
    for i, url, html in rows:
        blocks = blocks_of(html)
        stream = [(b, w) for b, (standing, text) in enumerate(blocks) if standing != 1 for w in text.lower().split()]
        covered = {k + j for k in range(len(stream) - LONG + 1) if len(where[(url.split("/")[2], *(w for _, w in stream[k : k + LONG]))]) > 1 for j in range(LONG)}
        share = lambda b: sum(k in covered for k, (x, _) in enumerate(stream) if x == b) / sum(x == b for x, _ in stream)
        out[i] = " ".join(text for b, (standing, text) in enumerate(blocks) if standing == 1 or standing == 0 and share(b) < 0.8)
    return out


def test_main_texts_against_brute_force(spark, rng):
    parts = [" ".join(f"w{rng.randrange(60)}" for _ in range(rng.choice([3, 9, 14, 25]))) for _ in range(25)]
    rows = []
    for i in range(60):
        chosen = [rng.choice(["<div>{}</div>", "<p>{}</p>", "<nav>{}</nav>", "<article>{}</article>"]).format(rng.choice([rng.choice(parts), f"{rng.choice(parts)} own{i} {i}x {i}y", f"only {i} a{i} b{i}"])) for _ in range(6)]
        rows.append((i, f"http://site{i % 3}.org/{i}", "<body>" + "".join(chosen)))
    for cell_pages in (64, 3):
        assert texts(main_texts(pages(spark, rows), cell_pages=cell_pages)) == brute_force(rows)


def test_a_page_without_an_article(spark):
    html = """<body class="home with-ads"><div id="hd">Paper</div><ul class="main-menu"><li>A</li></ul><div class="content has-sidebar"><h1>Head</h1><p>Text of it.</p>
    <div class="comment-list">Nice!</div></div><div role="alert">Notice</div></body>"""
    assert texts(main_texts(pages(spark, [(1, "http://a.com", html)]))) == {1: "Paper Head Text of it."}


def test_words_in_names_only_nominate(spark):
    body = "All of this text belongs to page {0} a{0} b{0} c{0} d{0} e{0}"
    shapes = [
        '<article class="post has-comments"><p>{}</p></article>', '<article id="post-ad-tech" class="post">{}</article>', '<main><div class="article-widget-free notice-board">{}</div></main>',
        '<article><section id="related-work"><p>{}</p></section></article>', '<main><section class="skip-lists">{}</section></main>', '<article><div class="toc-entry">{}</div></article>',
        '<article class="comment">{}</article>', '<div class="content"><div class="notice-board"><header><h1>{}</h1></header></div></div>'.replace("<header>", "<section>").replace("</header>", "</section>"),
    ]
    rows = [(i, f"http://a.com/{i}", "<body><nav>Menu</nav>" + shape.format(body.format(i)) + "<footer>foot</footer>") for i, shape in enumerate(shapes)]
    assert texts(main_texts(pages(spark, rows))) == {i: body.format(i) for i in range(len(shapes))}


def test_runs_judge_what_is_nominated(spark):
    board = "This board says the same long thing on all pages of it"
    rows = [(i, f"http://a.com/{i}", f'<article><p>Text {i}.</p><div class="notice-board"><p>{board}</p><header>Own words {i} of a nominated part x{i}</header></div><article class="comment">Nice {i}</article></article>') for i in range(3)]
    rows += [(9, "http://a.com/9", '<main>Main</main><article class="comment">Nice one</article><div class="comments"><article class="post">No</article></div>')]
    assert texts(main_texts(pages(spark, rows))) == {i: f"Text {i}. Own words {i} of a nominated part x{i}" for i in range(3)} | {9: "Main"}
