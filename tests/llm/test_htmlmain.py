import itertools
import random

import duckdb
import numpy as np
import pytest

from landweave.llm import htmlmain

SF = "/root/testdata/sf0.01"

A = "The first paragraph of the story tells what happened in the town, and it goes on for a while."
B = "A second one follows. It is shorter."
N = "Read our offers today, they are better than those of others."
PAGES = {
    "plain divs": (f'<body><div id="header"><h2>Site</h2></div><div class="menu"><a href="/">Home</a> <a href="/x">News</a></div><div class="content"><h1>Title</h1><p>{A}</p><p>{B}</p></div><div class="footer">&copy; 2020 Site</div></body>', ["Title", A, B]),
    "parts inside the article": (f'<article><header><h1>Title</h1></header><p>{A}</p><div class="ad">{N}</div><aside class="related"><p>{N}</p></aside><p>{B}</p><section class="comments"><h3>Comments</h3><p>{N} {A}</p></section></article>', ["Title", A, B]),
    "comments beside": (f'<main><div class="post-body"><p>{A}<p>{B}</div></main><div id="comments"><div class="comment"><p>{N}</p><p>{A}</p></div></div><form action="/s"><label>Search</label><button>Go</button></form>', [A, B]),
    "notice first": (f'<div class="cookie-banner"><p>{N}</p><button>OK</button></div><nav><ul><li><a href="/">Home</a><li><a href="/b">B</a></ul></nav><article><h1>T</h1><p>{A}</p><ul><li>One.</li><li>Two.</li></ul><blockquote>{B}</blockquote></article>', ["T", A, "One.", "Two.", B]),
    "nothing marked": (f"<html><body><ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li></ul><h1>Title of it.</h1><p>{A}</p><p>{B} {A}</p><p>{A}</p></body></html>", ["Title of it.", A, f"{B} {A}", A]),
    "scripts and references": (f"<article><p>One &amp; two&nbsp;&lt;b&gt; &eacute;<script>var x='</p>';</script> three<br>four <b>fi</b>ve<!-- no > --></p><style>p{{}}</style><p>{A}</p></article>", ["One & two <b> é three four five", A]),
}


@pytest.fixture(scope="module")
def model(spark):
    return htmlmain.fit(spark.read.parquet(f"{SF}/pages.parquet"))


@pytest.mark.parametrize("name", PAGES)
def test_pages_by_hand(model, name):
    page, want = PAGES[name]
    assert htmlmain.extract_page(model, page) == want


def test_whole_table_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{SF}/pages.parquet'")
    want = con.sql(htmlmain.ORACLE).select("page_id, url, text, n_chars").fetchall()
    got = htmlmain.digest(spark.read.parquet(f"{SF}/pages.parquet")).select("page_id", "url", "text", "n_chars").collect()
    assert sorted(map(tuple, got)) == sorted(want) and all(len(r.text) == r.n_chars > 0 for r in got)


def test_held_out_layouts(spark, model):
    """Pages that the model has not seen, set in layouts drawn anew."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    seen = set(htmlmain.sample(pages))
    rng, wrong, blocks = np.random.default_rng(5), 0, 0
    texts = [[leaf.text for leaf in htmlmain.leaves(r.html) if leaf.gold == 1] for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").limit(400).collect() if r.html not in seen]
    other = [t for x in texts for t in x]
    for t in texts[:200]:
        found = htmlmain.leaves(htmlmain.in_layout(t, other, rng), marked=True)
        got = model.decode([model.score(leaf.features) for leaf in found])
        wrong += sum(a != b for a, b in zip(got, htmlmain.gold_labels(found)))
        blocks += len(got)
    assert blocks > 3000 and wrong < 0.005 * blocks


def chain(rng):
    names = [f"f{i}" for i in range(6)]
    return htmlmain.Chain(names, rng.standard_normal(6), rng.standard_normal((2, 2)), rng.standard_normal(2))


def total(m, scores, labels):
    return m.first[labels[0]] + sum(s for s, y in zip(scores, labels) if y) + sum(m.pairs[a, b] for a, b in itertools.pairwise(labels))


def test_viterbi_and_likelihood_equal_all_labellings():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 8):
        m = chain(rng)
        scores = rng.standard_normal(n).tolist()
        every = list(itertools.product((0, 1), repeat=n))
        best = max(every, key=lambda y: total(m, scores, y))
        assert m.decode(scores) == list(best)
    # Two pages of three blocks and one, features as given.
    at, which, gold = np.array([0, 0, 1, 2, 3]), np.array([0, 1, 1, 2, 0]), np.array([1, 0, 1, 1])
    data = at, which, gold, np.array([0, 1, 2, 0]), np.array([0, 0, 0, 1]), np.array([3, 1]), 3
    theta = rng.standard_normal(9)
    m = htmlmain.Chain(["a", "b", "c"], theta[:3], theta[3:7].reshape(2, 2), theta[7:])
    want = 0.0
    for scores, labels in (([theta[0] + theta[1], theta[1], theta[2]], (1, 0, 1)), ([theta[0]], (1,))):
        want += np.log(sum(np.exp(total(m, scores, y)) for y in itertools.product((0, 1), repeat=len(scores)))) - total(m, scores, labels)
    value, grad = htmlmain._likelihood(theta, data, 0.0)
    assert abs(value - want) < 1e-9
    for i in range(9):
        step = np.zeros(9)
        step[i] = 1e-6
        slope = (htmlmain._likelihood(theta + step, data, 0.0)[0] - htmlmain._likelihood(theta - step, data, 0.0)[0]) / 2e-6
        assert abs(slope - grad[i]) < 1e-6


def test_cases(spark, model):
    cut = f"<html><body><nav><a href='/'>Home</a></nav><article><p>{A}</p><p>{B[:9]}"
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (3, "u", f"<article><p>{A}</p></article>", "x"), (3, "u", f"<article><p>{A}</p></article>", "x"), (4, "u", cut, "x"), (None, "u", "<nav><a href='/'>Home</a></nav>", "x")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(map(tuple, htmlmain.digest(table).collect()), key=str)
    assert got == sorted([(1, "u", "", 0), (2, None, "", 0), (3, "u", A, len(A)), (3, "u", A, len(A)), (4, "u", f"{A}\n\n{B[:9].strip()}", len(A) + 2 + len(B[:9].strip())), (None, "u", "", 0)], key=str)
    assert htmlmain.digest(table.limit(0)).count() == 0
    # No page labels itself: the made-up ones are enough for ordinary names.
    other = spark.createDataFrame([(1, "u", PAGES["plain divs"][0])], "page_id long, url string, html string")
    assert htmlmain.digest(other).first().text == "\n\n".join(PAGES["plain divs"][1])
    out = htmlmain.extract(table, model)
    assert out.columns == ["page_id", "url", "text", "blocks"] and out.count() == 6


def test_broken_and_very_long_pages(model):
    rng = random.Random(3)
    bits = ["<p>", "</p>", "<div class='a", '"', "'", ">", "<", "=", "<!--", "-->", "<script", "</script>", "<a href=", "&am", "&#xD800;", "&amp", "text ", "</li>", "<li>", "<td>", "<article>", "</article>", "\x00", "<![CDATA[", "<?x", "</", "<br/"]
    for _ in range(2000):
        htmlmain.extract_page(model, "".join(rng.choice(bits) for _ in range(rng.randrange(40))))
    for piece in ("<div>", "<div class='x", '<p a="', "<", "<!--", "</p>", "<li>", "<a ", "&amp", "<p>word ", "<div><li>x", "<script>", "<p ='"):
        htmlmain.leaves(piece * (200_000 // len(piece)), model.weights)
