import itertools
import random
import re
import time

from driftlog.llm import html_wrappers as h
from tests.llm.helpers import prose

PAGES = "page_id long, url string, html string"


def read(spark, rows):
    return {r.page_id: r for r in h.extract(spark.createDataFrame(rows, PAGES)).collect()}


def test_parts_of_a_page():
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href=/>Home</a></ul></nav>"
        "<div class='ad'>Buy</div><article><h1>Title &amp; more</h1><p>one<br>two &nbsp; three<p>four <b>bold</b><!-- no --></p><footer>f</footer>"
        "<section class=comments><article class=comment>reader</article></section></article><footer>&copy; x</footer></body></html>"
    )
    assert h.main_text(page, None) == "Title & more\n\none two three\n\nfour bold"


def test_optional_end_tags_and_class_words_only_vote():
    assert h.main_text("<html><head><title>T</title><body><article><p>hi", None) == "hi"
    assert h.main_text("<div class='layout no-sidebar'><article><p>hi</p></article><div class=comments>c</div></div>", None) == "hi"
    assert h.main_text("<form id=f><article><p>hi</article></form>", None) == "hi"
    assert h.main_text("<body><article><p>let <math>x</math> be <svg><svg>a</svg>b</svg><button>c</button></article>", None) == "let x be c"
    assert h.main_text("<select><option>x<p>a<article>t</article>", None) == "t"
    assert h.main_text("<table><tr><td>a<td>b<tr><td>c</table><dl><dt>d<dd>e</dl>", None) == "a\n\nb\n\nc\n\nd\n\ne"
    assert h.main_text("<div>" * 4000 + "deep", None) == "deep"


def template(i, body, note="Share this story with your friends"):
    return f"<body><div><p>{note}</p><h2>{prose(i, 4)}</h2>{body}</div></body>"


def test_the_wrapper_decides(spark):
    """Text that a host's pages share in one slot is template, with no class or element to tell; read
    alone, the same page keeps it."""
    body = lambda i: "".join(f"<p>{prose(100 * i + k, 20)}</p>" for k in range(1 + i % 3))
    rows = [(i, "http://x.org/a", template(i, body(i))) for i in range(9)] + [(9, "http://y.org/", template(3, body(3))), (10, None, template(3, body(3)))]
    rows += [(11 + i, "http://z.org/", template(3, body(3))) for i in range(9)]  # copies teach nothing about slots
    got = read(spark, rows)
    assert all("Share this" not in got[i].text and got[i].text.count("\n\n") == 1 + i % 3 for i in range(9))
    assert all(got[i].text == "Share this story with your friends\n\n" + got[3].text for i in range(9, 20))


def test_articles_lose_template_text_but_not_their_title():
    pages = [f"<article><h1>News</h1><p>{prose(i, 9)}</p><p>{prose(i + 50, 30)}</p><p>All rights belong to us</p></article>" for i in range(6)]
    rules = h.rules_of(*h.learnt(iter(pages)))
    assert h.main_text(pages[0], rules) == f"News\n\n{prose(0, 9)}\n\n{prose(50, 30)}"


def test_odd_pages_do_not_undo_a_template():
    pages = [template(i, f"<p>{prose(i, 30)}</p>") for i in range(20)] + ["<body><p>gone</p></body>", template(77, "", "Other words")]
    rules = h.rules_of(*h.learnt(iter(pages)))
    assert "Share" not in h.main_text(pages[4], rules) and h.main_text(pages[-2], rules) == "gone"


def tokens(tree):
    out = []
    for x in tree:
        out += ["t"] if x[0] is None else [f"<{x[0]}", *tokens(x[3]), f"{x[0]}>"]
    return out


def expression(wrapper):
    """The wrapper as a regular expression over tokens."""
    out = ""
    for x in wrapper:
        if x[0] is None:
            own = "(?:t )"
        elif x[0] == h.GROUP:
            own = "(?:" + expression(x[3]) + ")*"
        else:
            own = "(?:" + re.escape(f"<{x[0]} ") + expression(x[3]) + re.escape(f"{x[0]}> ") + ")"
        marks = x[1]
        out += f"(?:{own})" + ("*" if marks & h.OPTIONAL and marks & h.REPEATED else "+" if marks & h.REPEATED else "?" if marks & h.OPTIONAL else "")
    return out


def random_page(r, depth=0):
    out = ""
    for _ in range(r.randrange(0, 4)):
        name = r.choice(["p", "div", "ul", "h2", "section"])
        out += f"<{name}>{r.choice(['same', 'one', 'two', ''])}{random_page(r, depth + 1) if depth < 2 and name != 'p' else ''}</{name}>"
    return out


def test_wrappers_cover_every_page_they_were_learnt_from():
    """Brute force: the wrapper, written as a regular expression, matches each page's tokens; in any order."""
    for seed in range(40):
        r = random.Random(seed)
        pages = [random_page(r) for _ in range(4)]
        for order in itertools.permutations(pages) if seed < 10 else [pages]:
            wrapper, _ = h.learnt(iter(order))
            own = re.compile(expression(wrapper))
            assert all(own.fullmatch("".join(f"{t} " for t in tokens(h.parse(p)[0]))) for p in order), (seed, order)


def test_folded_lists_hold_each_kind_once():
    tree = h.parse("".join(f"<p>a{i}</p><h2>b{i}</h2>" + "<ul><li>x<li>y</ul>" * (i % 2) for i in range(200)))[0]
    (group,) = h.fold(tree, 3)
    assert group[0] == h.GROUP and sorted(x[0] for x in group[3]) == ["h2", "p", "ul"]


def test_long_pages_are_read_whole(spark):
    """Longer than any other page of the host, and not left out of the wrapper."""
    long = "<body><nav><a href=/>n</a></nav><article>" + "".join(f"<p>para {i}</p><h2>head {i}</h2>" for i in range(5000)) + "</article><div>outside</div></body>"
    rows = [(0, "http://x.org/", long)] + [(i, "http://x.org/", f"<body><nav><a href=/>n</a></nav><p>{prose(i, 20)}</p></body>") for i in range(1, 6)]
    start = time.perf_counter()
    got = read(spark, rows)
    assert got[0].text.startswith("para 0\n\nhead 0") and got[0].text.endswith("head 4999") and got[0].text.count("\n\n") == 9999
    assert got[1].text == prose(1, 20) and time.perf_counter() - start < 60


def test_defined_cases(spark):
    rows = [(0, None, None), (1, "http://x.org", ""), (2, "x", "<p>a"), (2, "x", "<p>a"), (None, "http://X.org", "text only")]
    d = spark.createDataFrame(rows, PAGES).selectExpr("*", "1 AS text", "2 AS host", "3 AS hash", "4 AS share")
    got = sorted(((r.page_id, r.text, r.n_chars) for r in h.extract(d).collect()), key=str)
    assert got == sorted([(0, "", 0), (1, "", 0), (2, "a", 1), (2, "a", 1), (None, "text only", 9)], key=str)
    assert h.extract(d.limit(0)).count() == 0


def test_hot_hosts_are_learnt_in_shares(spark, monkeypatch):
    monkeypatch.setattr(h, "SHARE", 7)
    rows = [(i, "http://x.org/a", template(i, f"<p>{prose(i, 20)}</p>")) for i in range(40)]
    assert all("Share" not in r.text for r in read(spark, rows).values())
