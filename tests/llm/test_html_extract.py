"""Main text of pages: marks, site style trees against brute force, and broken markup."""

import math
from collections import defaultdict

import pytest

from rectide.llm.html_extract import extract_main_text, host_of, page_text, parse, shape, site_style_trees, structure

SCHEMA = "page_id long, url string, html string, text string, k1 int, host string"


def plain(html):
    return page_text(*structure(html), set(), 0.5)


def article(i, extra=""):
    body = "".join(f"<p>Paragraph {i} {k} tells of subject {i * 31 + k} in so many words.</p>" for k in range(4))
    return f"<article><h1>Title {i}</h1>{body}{extra}</article>"


def text_of(i):
    return "\n\n".join([f"Title {i}"] + [f"Paragraph {i} {k} tells of subject {i * 31 + k} in so many words." for k in range(4)])


def test_marks():
    page = f"""<!DOCTYPE html><html><head><title>No</title><style>p > a {{}}</style><script>if (a<b) "</p><p>no</p>"</script></head>
    <body class="has-sidebar"><header class="site-header"><h1>Site</h1></header>
    <nav><ul><li><a href=x>One</a><li><a href=y>Two</a></ul></nav>
    <div id="cookieNotice">We use cookies</div><aside>Aside</aside>
    {article(1, '<form><label>Mail</label><input value=x></form><div class="share-buttons">Share</div>')}
    <section class="comments"><article class="comment"><p>Nice one, I read it twice and thrice and again.</p></article></section>
    <div role="complementary">More</div><footer>&copy; me</footer></body></html>"""
    assert plain(page) == text_of(1)


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("", ""),
        ("just text", "just text"),
        ("<p>a&nbsp;&amp;\n b &lt;i&gt; &#233; &eacute;&hellip;<p>c<br>d <b>e</b>f", "a & b <i> é é…\n\nc d ef"),
        ("<p>1 < 2 and 3 > 2<p title='x>y' class=a>q", "1 < 2 and 3 > 2\n\nq"),
        ("<p>cut <!-- never closed <p>no", "cut"),
        ("<p>a<script>never closed <p>no", "a"),
        ("<p>a<b>bold<br><p>b</b></i></div>c", "abold\n\nbc"),
        ("<p>x<a href='unclosed>y</a>z", "xyz"),
        ("<article><header><h2>Own heading</h2></header><p>t</article>", "Own heading\n\nt"),
        ("<nav><a href=1>m</a><article><p>inside a menu never closed</article>", "inside a menu never closed"),
        ("<table><tr><td>a<td>b<tr><td>c</table><ul><li>x<li>y</ul>", "a\n\nb\n\nc\n\nx\n\ny"),
        ("<div><ul><li><a>a</a><li><a>b</a><li><a>c</a></ul><p>words of the page</div>", "words of the page"),
        ("<main><p>first</p></main><p>out</p>", "first"),
        ("<article>a</article><article>b<article>c</article></article>", "a\n\nb\n\nc"),
        ("<p>" + "long " * 50000 + "</p><p", "long " * 49999 + "long"),
        ("<div " + 'a="' * 3000, ""),
        ("<" * 3000, "<" * 3000),
    ],
)
def test_forgiving_parse(html, want):
    assert plain(html) == want


def site():
    """A host whose template adds unmarked boilerplate, a host of copies, and pages alone."""
    letter = '<div class="x9">Read our letter, sent to you each week.</div>'
    shared = '<p>A passage that many articles of this host quote in the same words, every one of them.</p>'
    rows = []
    for i in range(12):
        rows.append((i, f"https://user@a.example:80/p/{i}?q", f"<body>{article(i, letter + (shared if i % 2 else ''))}</body>"))
    for i in range(12, 20):  # near copies: one word differs
        rows.append((i, f"http://b.example/{i}", f"<body>{article(99).replace('subject 3069', f'subject x{i}')}</body>"))
    rows.append((20, "http://c.example", f"<body>{article(20, letter)}</body>"))
    rows.append((21, None, f"<body>{article(21, letter)}</body>"))
    rows.append((22, "relative/path", None))
    rows += [(None, "http://a.example/n", ""), rows[3], rows[3]]
    return [(*r, "clash", 1, "clash") for r in rows]


def test_extract_main_text(spark):
    df = spark.createDataFrame(site(), SCHEMA).repartition(4)
    got, joined = (
        sorted((r.page_id if r.page_id is not None else -1, r.text) for r in extract_main_text(df, **options).collect())
        for options in ({}, {"broadcast_paths": 0})
    )
    assert got == joined
    letter = "\n\nRead our letter, sent to you each week."
    shared = "\n\nA passage that many articles of this host quote in the same words, every one of them."
    want = {i: text_of(i) + (shared if i % 2 else "") for i in range(12)}
    want |= {i: text_of(99).replace("subject 3069", f"subject x{i}") for i in range(12, 20)}
    want |= {20: text_of(20) + letter, 21: text_of(21) + letter, 22: "", -1: ""}
    assert got == sorted([*want.items(), (3, want[3]), (3, want[3])])
    for r in extract_main_text(df).collect():
        assert r.n_chars == len(r.text)
    assert extract_main_text(df.limit(0)).collect() == []


def test_style_tree_importance(spark):
    gamma, rows = 0.9, []
    forms, feats = defaultdict(lambda: defaultdict(set)), defaultdict(lambda: defaultdict(set))
    for _, url, html, *_ in site():
        host = host_of(url)
        family, form, feat = shape(*structure(html or ""))
        rows.append((0, 0, host, family, [(p, f) for p, f in form.items()], sorted(feat)))
        for p, f in form.items():
            forms[host, p][f].add(family)
        for p, f in feat:
            feats[host, p][f].add(family)
    want = {}
    for key, by_form in forms.items():
        if key[0] is None:
            continue
        counts = [len(x) for x in by_form.values()]
        m = sum(counts)
        importance = 1.0
        if m > 1:
            shown = -sum(n / m * math.log(n / m, m) for n in counts)
            spread = [math.log(len(x), m) for x in feats[key].values()]
            content = 1 - min(1.0, sum(spread) / len(spread))
            importance = (1 - gamma ** len(counts)) * shown + gamma ** len(counts) * content
        want[key] = (m, importance)
    schema = "k1 long, k2 long, host string, family long, paths array<struct<path: long, form: long>>, feats array<struct<path: long, feat: long>>"
    got = {(r.host, r.path): (r.families, r.importance) for r in site_style_trees(spark.createDataFrame(rows, schema), gamma).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    assert min(v[1] for v in want.values()) < 0.01 < 0.5 < max(v[1] for v in want.values())


def test_tree_depth_and_hosts():
    page = parse("<div>" * 5000 + "deep")
    assert len(page.tag) == 5001
    assert plain("<div>" * 5000 + "deep") == "deep"
    assert [host_of(u) for u in ("HTTP://A.b/c", "ftp://x@y:1/", "//a", "a.b/c", "", None)] == ["a.b", "y", None, None, None, None]
