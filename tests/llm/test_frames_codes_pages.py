"""Fill-in-the-middle over frames, vector codes and HTML extraction against SQL, brute force and hand-made pages."""

import hashlib
import html
import io
import math
import random
import re
from pathlib import Path

import duckdb
import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import fim, htmllabels, htmltext, queries, vectorcodes
from tidemark.llm.htmltree import parse

SF = "/root/testdata/sf0.001"
UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        c.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_fill_in_middle"])
def test_new_queries_match_sql(spark, con, name):
    df = queries.queries()[name](spark, SF)
    want = con.sql(queries.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert sorted((tuple(r[c] for c in want.columns) for r in df.collect()), key=repr) == sorted(want.fetchall(), key=repr)


# --- fill in the middle ---


def plainly(doc_id, text):
    """The contract, on strings."""
    text = text or ""
    units = UNIT.findall(text)
    n, d = len(units), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, z = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:z], units[z:]))
    form = "plain" if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90 else "spm" if h[3] % 100 < 20 else "psm"
    out = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, n, form, None if form == "plain" else len(p), None if form == "plain" else len(m), sha(out), sha(text))


def test_fim_on_odd_rows(spark, odd, odd_rows, docs_of):
    got = sorted((tuple(r) for r in fim.fim_digest(odd).collect()), key=repr)
    assert got == sorted((plainly(i, t) for i, t, *_ in odd_rows), key=repr)
    assert fim.fim_digest(odd.limit(0)).count() == 0
    texts = ["a" * 300_000, "é" * 90_000, "ab " * 60_000, "<S" * 5, "x<P>y", "<", "\U0001f600a" * 30_000, "<M" + "b" * 65_533 + "<S", "\n\t a"]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts * 4)]
    assert sorted(tuple(r) for r in fim.fim_digest(docs_of(rows)).collect()) == sorted(plainly(i, t) for i, t, *_ in rows)


def test_container_is_plain_zstandard_and_seeks():
    text = ("naïve words, 12 of them; " * 9000 + "x" * 200_000 + "ü" * 50_000).encode()
    blob = fim.seal_text(text)
    read = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(blob), read_across_frames=True).read()
    assert read == text
    f = fim.Frames(blob)
    units = UNIT.findall(text.decode())
    assert (f.units, f.chars, f.size) == (len(units), len(text.decode()), len(text))
    opened = []
    real = f.frame
    f.frame = lambda i: opened.append(i) or real(i)
    for k in (0, 1, 17, 40_000, len(units) - 50_001, len(units) - 1, len(units)):
        opened.clear()
        before = "".join(units[:k])
        assert f.cut(k) == (len(before.encode()), len(before)) and len(opened) <= 1
    assert max(len(p) for p in f.stream()) <= fim.FRAME


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab <PSM>é\n"), max_size=30), st.integers(0, 30), st.integers(0, 30), st.sampled_from(["psm", "spm", "plain"]))
def test_fim_round_trip_of_any_text(text, a, z, form):
    raw = text.encode()
    if any(m in raw for m in fim.MARKERS):
        form = "plain"
    source = fim.Frames(fim.seal_text(raw))
    (lo, _), (hi, _) = source.cut(min(a, z)), source.cut(max(a, z))
    out = fim.seal_text(b"".join(map(bytes, fim.arranged(source, form, lo, hi))))
    assert b"".join(map(bytes, fim.restored(fim.Frames(out), form))) == raw


# --- vector codes ---


def plain_codes(rows):
    """Product quantisation in whole numbers, entry by entry."""
    q = {i: [math.floor(256 * x) for x in v] for i, v, _ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    width = -(-max(map(len, q.values())) // 16)
    q = {i: v + [0] * (16 * width - len(v)) for i, v in q.items()}
    cut = lambda v, p: v[p * width : (p + 1) * width]
    book = [[cut(q[i], p) for i in sorted(q)[:64]] for p in range(16)]

    def assign(v, p):
        d = [sum((a - b) ** 2 for a, b in zip(cut(v, p), e, strict=True)) for e in book[p]]
        return d.index(min(d)), min(d)

    for _ in range(2):
        for p in range(16):
            held = {}
            for v in q.values():
                held.setdefault(assign(v, p)[0], []).append(cut(v, p))
            new = {e: [sum(x) // len(vs) for x in zip(*vs, strict=True)] for e, vs in held.items()}
            book[p] = [new.get(e, old) for e, old in enumerate(book[p])]
    digest = hashlib.sha256(",".join(str(c) for b in book for e in b for c in e).encode()).hexdigest()
    out = {}
    for i, v in q.items():
        got = [assign(v, p) for p in range(16)]
        out[i] = ("".join(f"{e:02x}" for e, _ in got), sum(d for _, d in got))
    label = {i: x for i, _, x in rows}
    return sorted((i, c, e, sum(out[j][1] for j in out if label[j] == label[i]), digest) for i, (c, e) in out.items())


@pytest.mark.parametrize("dims,scale,n", [(48, 1.0, 150), (40, 30.0, 100), (16, 0.004, 200), (64, 5e5, 40)])
def test_vector_codes_match_whole_number_loop(spark, dims, scale, n):
    r = random.Random(dims)
    rows = [(i * 3 % n, [r.choice((r.uniform(-scale, scale), 0.0, scale)) for _ in range(dims)], r.choice((None, 1, 2))) for i in range(n) if i * 3 % n or i == 0]
    rows = list({i: (i, v, x) for i, v, x in rows}.values())
    rows += [(1000, None, 1), (1001, [None] * dims, 1), (1002, [math.nan] + [0.0] * (dims - 1), 2), (1003, [math.inf] * dims, None), (1004, [1.0] * (dims - 3), None), (1005, [], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(tuple(x) for x in vectorcodes.vector_codes(df).collect())
    assert got == plain_codes(rows)


def test_vector_codes_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, label string, code string, id int, q int, slot int"
    empty = spark.createDataFrame([], schema)
    assert vectorcodes.vector_codes(empty).count() == 0
    only_null_ids = spark.createDataFrame([(None, [1.0] * 16, "a", "x", 1, 1, 1)], schema)
    assert [tuple(r)[:4] for r in vectorcodes.vector_codes(only_null_ids).collect()] == [(None, None, None, None)]
    twice = [(5, [0.5] * 32, None, "x", 1, 1, 1)] * 2 + [(6, [-3e38] * 32, "b", "x", 1, 1, 1), (None, [0.25] * 32, "b", "x", 1, 1, 1)]
    got = sorted((tuple(r) for r in vectorcodes.vector_codes(spark.createDataFrame(twice, schema)).collect()), key=repr)
    assert [(r[0], r[1]) for r in got] == [(5, "00" * 16), (5, "00" * 16), (6, "01" * 16), (None, "00" * 16)]
    # the three vectors that share an entry move it by floors: (128 + 128 + 64) // 3 = 106
    assert [r[2] for r in got] == [32 * 22**2, 32 * 22**2, 0, 32 * 42**2] and got[3][3] == 32 * 42**2


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.integers(0, 10_000), st.sampled_from([3, 1000, 1 << 31]))
def test_nearest_entry_is_exact_and_ties_go_low(width, seed, most):
    r = np.random.default_rng(seed)
    parts, entries = r.integers(-most, most, (30, width)), r.integers(-most, most, (12, width))
    entries[7] = entries[3]
    at, d = vectorcodes.nearest(parts, entries)
    for x, i, e in zip(parts.tolist(), at.tolist(), d.tolist(), strict=True):
        all_d = [sum((a - b) ** 2 for a, b in zip(x, y, strict=True)) for y in entries.tolist()]
        assert (i, e) == (all_d.index(min(all_d)), min(all_d))
    walsh = vectorcodes.sequency_matrix(8)
    assert (walsh @ walsh.T == 8 * np.eye(8)).all() and [int((w[1:] != w[:-1]).sum()) for w in walsh] == list(range(8))


# --- HTML extraction ---


@pytest.fixture(scope="module")
def model(spark):
    return htmltext.fit(htmllabels.labelled_pages(spark))


def test_pages_give_their_articles(spark):
    rows = {r["page_id"]: r for r in queries.op13_html_extraction(spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(rows) == len(pages)
    for p in pages:
        article = re.search("<article>(.*)</article>", p["html"], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("</?b>|<br>", "", b)).split()) for b in re.split("</?(?:p|h1)>", article))
        want = "\n".join(b for b in blocks if b)
        assert (rows[p["page_id"]]["text"], rows[p["page_id"]]["n_chars"]) == (want, len(want))


def test_labelled_pages_held_out(model):
    """Pages that the model has not seen: right blocks are kept, others are not."""
    kept = wrong = lost = 0
    for i in range(50_000, 50_200):
        page = htmllabels.labelled_page(i)
        tree = parse(page)
        want = [t for t, s in zip(tree.text, htmltext.labels(tree), strict=True) if t is not None and s == htmltext.MAIN]
        got = [t for t in htmltext.main_texts([re.sub(' data-main="."', "", page)], model)[0].split("\n") if t]
        left = list(want)
        for t in got:
            if t in left:
                left.remove(t)
                kept += 1
            else:
                wrong += 1
        lost += len(left)
    assert kept / (kept + wrong) > 0.98 and kept / (kept + lost) > 0.98


def test_page_without_article_element(model):
    page = """<html><head><title>T</title></head><body><div class=topbar><a href=/>Home</a> <a href=/n>News</a></div>
      <form class=search><label>Find</label><input name=q><button>Go</button></form>
      <div class="cookie-notice"><p>We use cookies to make this site better for you.</p></div>
      <div id=content><h1>River  levels</h1><p>The river rose by two metres overnight, the agency said on Monday&nbsp;morning.
      <p>Nobody was hurt.<ul><li>Upper gauge: 4.1 m<li>Lower gauge &lt; 3 m</ul><blockquote>It was <a href=/x>very</a> loud.</blockquote>
      <div class="advert"><p>Buy boots now!</p></div></div>
      <div id=comments><h3>Comments</h3><div class=comment><p>Great report, I live near there and saw it all happen.</p></div></div>
      <div class="sidebar related"><h3>More</h3><ul><li><a href=/1>One story</a></li><li><a href=/2>Two story</a></li></ul></div>
      <div class=footer>&copy; 2024 Somewhere</div><script>var x = "<p>no</p>";</script></body></html>"""
    want = "River levels\nThe river rose by two metres overnight, the agency said on Monday morning.\nNobody was hurt.\nUpper gauge: 4.1 m\nLower gauge < 3 m\nIt was very loud."
    assert htmltext.main_texts([page], model) == [want]


def test_tree_follows_the_standard():
    def blocks(page):
        t = parse(page)
        return [(t.tag[t.parent[i]], x) for i, x in enumerate(t.text) if x is not None]

    assert blocks("a<p>b<p>c</div>d<div>e</p>f") == [("html", "a"), ("p", "b"), ("p", "cd"), ("div", "e"), ("div", "f")]
    assert blocks("<!--x--><!--->y<!-->z<!bogus>w<?pi?></>v") == [("html", "yzwv")]
    assert blocks("<div title='>'a=\"<b>\">q</div x='>'>r") == [("div", "q"), ("html", "r")]
    assert blocks("1 < 2 &amp; 3<4 &#x41;&notit;&bogus;") == [("html", "1 < 2 & 3<4 A¬it;&bogus;")]
    assert blocks("<script><!--</p>--></SCRIPT >s<style>x</style><textarea>t</textarea><title>u") == [("html", "s")]
    assert blocks("<table><tr><td>1<td>2<tr><th>3</table>4") == [("td", "1"), ("td", "2"), ("th", "3"), ("html", "4")]
    assert blocks("<p hidden>h</p><p style='display: none'>i</p><svg><text>j</text></svg><p>k") == [("p", "k")]
    assert blocks("<p>a<b>b</p>c</b>d<br>e</br>f") == [("p", "ab"), ("html", "cd e f")]
    assert blocks("<p>cut short <a href='x") == [("p", "cut short")]
    assert blocks("") == blocks("<!-- open") == []


def test_extraction_of_odd_pages(spark, model):
    long = "<article>" + "<p>Some words of a long page go here, again and again.</p>" * 20_000 + "</article>"
    deep = "<div>" * 50_000 + "deep" + "</div>" * 50_000
    quotes = '<a href="' * 50_000
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, "u", "<article><p>One two three four five.</p></article>", "x"), (3, "u", long, "x"), (4, "u", deep, "x"), (5, "u", quotes, "x"), (6, "u", "<" * 100_000, "x")]
    df = spark.createDataFrame(rows + rows[2:3], "page_id long, url string, html string, text string")
    got = sorted((tuple(r) for r in htmltext.extract(df, model).collect()), key=repr)
    by = {r[0]: r for r in got}
    assert by[1] == (1, "u", "", 0) and by[2] == (2, None, "", 0) and len(got) == 8
    assert [r for r in got if r[0] is None] == [(None, "u", "One two three four five.", 24)] * 2
    assert by[3][2].count("\n") == 19_999 and by[5][2] == ""
    assert htmltext.extract(df.limit(0), model).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 100_000), st.integers(2, 8))
def test_messages_give_exact_marginals(seed, n):
    """Against sums over all states of all nodes."""
    r = np.random.default_rng(seed)
    parent = np.array([-1] + [int(r.integers(0, i)) for i in range(1, n)])
    depth = np.zeros(n, np.int64)
    for i in range(1, n):
        depth[i] = depth[parent[i]] + 1
    leaf = np.array([i > 0 and i not in parent for i in range(n)])
    below = {k: np.log(r.dirichlet(np.ones(3), 4)) for k in ("block", "leaf")}
    below["leaf"][:, htmltext.BOTH] = -np.inf
    unary = r.normal(size=(n, 3))
    total, want = 0.0, np.zeros((n, 3))
    for states in np.ndindex(*(3,) * n):
        w = sum(unary[i, s] + below["leaf" if leaf[i] else "block"][3 if parent[i] < 0 else states[parent[i]], s] for i, s in enumerate(states))
        total += math.exp(w)
        for i, s in enumerate(states):
            want[i, s] += math.exp(w)
    assert np.allclose(htmltext.marginals(parent, depth, leaf, unary, below), want / total)
