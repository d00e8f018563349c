"""Pages, urls and vectors."""

import html
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from phasewise.llm import op2_url_filter as op2
from phasewise.llm import op3_nearest as op3
from phasewise.llm import op5_html_text as op5
from phasewise.llm import op7_cover_tree as op7

SF = "/root/testdata/sf0.01"
URLS = [None, "", "example.com/en/", "http://", "http://Example.COM/en/x", "http://www.example.com/en/?q#f", "https://a.www.example.com/en/",
        "http://notexample.com/en/", "http://x.net/es/1", "http://x.net/fr", "http://net/fr/", "http://com", "http://com/", "http://a.com?x=://b.net/es/",
        "http://x.org/#://", "ftp://u:p@x.net:80/es/", "http://x.net/ES/", "http://..com/a", "http://" + "a." * 3000 + "com/" + "b" * 9000]


def judged(url, rules):
    rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
    host = re.split(r"[/?#]", rest)[0].translate({c: c + 32 for c in range(65, 91)})
    path = re.split(r"[?#]", rest[len(host):])[0]
    fits = [(len(h + p), h, p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[1] + best[2], best[3] if best else "allow"


def test_urls(spark):
    own = random.Random(1)
    urls = URLS + [f"{own.choice(['http', 'https'])}://{own.choice(['', 'www.', 'A.b.'])}{own.choice(['example.com', 'x.net', 'y.com', 'org'])}"
                   f"{own.choice(['', '/', '/en/', '/es/a', '/fr/?a', '/en'])}{own.choice(['', '#t', '?x=/en/'])}" for _ in range(300)]
    pages = spark.createDataFrame([(k % 50 or None, u, "z") for k, u in enumerate(urls)], "page_id int, url string, host string")
    rules = spark.createDataFrame(op2.RULES, "host string, path string, verdict string")
    got = sorted(map(tuple, op2.judge(pages, rules).collect()), key=repr)
    assert got == sorted(((k % 50 or None, *judged(u, op2.RULES)) for k, u in enumerate(urls)), key=repr)
    assert op2.judge(pages.limit(0), rules).collect() == []
    none = op2.judge(pages, rules.limit(0)).collect()
    assert len(none) == len(urls) and {r["verdict"] for r in none} == {"allow"}


def test_urls_of_many_rules(spark):
    own = random.Random(2)
    hosts = ["".join(own.choice("ab") + own.choice(["", "."]) for _ in range(4)).strip(".") + ".c" for _ in range(80)]
    rules = sorted({(own.choice(hosts), "/" + "".join(own.choice("xy/") for _ in range(own.randint(0, 3)))) for _ in range(120)})
    rules = [(h, p, own.choice(["allow", "block"])) for h, p in rules]
    urls = [f"h://{own.choice(hosts)}/" + "".join(own.choice("xy/") for _ in range(own.randint(0, 6))) for _ in range(400)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    got = op2.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    for r in got:
        host, path, _, _ = judged(urls[r["page_id"]], [])
        fits = [h + p for h, p, _ in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r["rule"] is None) == (not fits)
        assert not fits or len(r["rule"]) == max(map(len, fits)) and r["rule"] in fits


@pytest.fixture(scope="module")
def model(spark):
    return op5.fit(op5.sample(spark.read.parquet(f"{SF}/pages.parquet")))


def main_text(page):
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    blocks = [" ".join(html.unescape(re.sub(r"<(b|/b|br)>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
    return "\n\n".join(b for b in blocks if b)


def test_pages(spark, model):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    wanted = {r["page_id"]: main_text(r["html"]) for r in pages.collect()}
    rows = op5.extract(pages, model).collect()
    assert sum(r["text"] == wanted[r["page_id"]] for r in rows) >= 0.99 * len(rows)
    assert all(r["n_chars"] == len(r["text"]) for r in rows)


def test_made_up_layouts(model):
    """Other layouts than those the model was fitted on, without the labels."""
    own = random.Random(99)
    texts = ["A sentence with a few words, and one more. Then an end.", "Some other words here; they go on. And on, for long.", "Short one."]
    good = 0
    for _ in range(60):
        page = op5.layout(own, texts)
        wanted = [" ".join(t.split()) for t in re.findall(r"<(?:p|h1|h2|h3|li|div|td|th) data-made-label=1>([^<]+)<", page)]
        good += model.texts([page.replace(" data-made-label=1", "").replace(" data-made-label=0", "")])[0] == "\n\n".join(wanted)
    assert good >= 50


def test_lists_and_tables_of_an_article_stay(model):
    """Elements and lengths that the pages of the test tables do not have; the article is shorter than what is around it once."""
    menu = "<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>"
    footer = "<footer>&copy; bakers &middot; all rights reserved everywhere, and in every way that there is</footer>"
    inner = ("<h1>On bread</h1><p>Bread is made of flour and water, and rises slowly.</p><ul><li>first point of the recipe</li><li>second point</li></ul>"
             "<table><tr><td>flour</td><td>500 g</td></tr><tr><td>water</td><td>300 g</td></tr></table><p>Bake it for an hour in a hot oven.</p>")
    comments = '<div class="comments"><p>I like this bread a lot, thank you.</p><p>Me too, it is good.</p></div>'
    wanted = ["On bread", "Bread is made of flour and water, and rises slowly.", "first point of the recipe", "second point", "flour", "500 g",
              "water", "300 g", "Bake it for an hour in a hot oven."]
    for name, end in (("article", "article"), ("main", "main"), ('div class="post"', "div")):
        page = f"<html><body>{menu}<{name}>{inner}</{end}>{comments}{footer}</body></html>"
        assert model.texts([page])[0] == "\n\n".join(wanted)
    assert model.texts([f"<html><body>{menu}<article><h1>On bread</h1><p><b>Soon.<br></article>{footer}</body></html>"])[0] == "On bread\n\nSoon."


def test_all_pages_of_the_larger_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    wanted = {r["page_id"]: main_text(r["html"]) for r in pages.collect()}
    rows = op5.extract(pages, op5.fit(op5.sample(pages))).collect()
    assert sum(r["text"] != wanted[r["page_id"]] for r in rows) == 0


ODD_PAGES = {
    None: "", "": "", "plain & simple": "plain & simple", "<p>open <i>x": "open x", "<<>><p>a</p": "<<>>\n\na</p",
    "<script>var a='<p>no</p>'</script><style>p{}</style><main><p>x &lt;b&gt;  y</p></main>": "x <b> y", "<!-- a <p> b --><p>c</p>": "c",
    "<div hidden><p>no</p></div><p>yes, this is it. It is long enough.</p>": "yes, this is it. It is long enough.",
}


def everything(page):
    root = op5.parse(page)
    return op5.text_of(root, {id(n) for n in op5.measured(root)})


def test_stray_quotes_in_tags():
    three = "First text here.\n\nIt's second.\n\nThird."
    for attribute in ("title=it's", "alt=Bob's", "'", '"', "title=5\"", "a=b=\"c", "title='a>b' x=\"c>d\"", "title = 'a>b'"):
        assert everything(f"<p {attribute}>First text here.</p><p>It's second.</p><p>Third.</p>") == three
    assert everything("<p>a</p><p " + "=''" * 40) .startswith("a")  # no '>' any more


def test_contents_of_other_elements_are_judged(model):
    inner = "<p>A long sentence, with some words in it. And one more.</p>" * 4
    page = f"""<html><head><noscript><p>no</p></noscript><title>no</title></head><body><article>{inner}<p>As <math><mi>E</mi><mo>=</mo><mi>m</mi></math> and
        <svg><title>no</title><text>a label</text></svg> say.</p><object><p>In an object.</p></object><noscript><p>Without scripts.</p></noscript>
        <video>In a film.</video><script>no</script><select><option>no</select></article></body></html>"""
    found = everything(page)
    assert all(t in found for t in ("E=m", "a label", "In an object.", "Without scripts.", "In a film.")) and "no" not in found.split()
    assert "E=m" in model.texts([page])[0]


def test_odd_pages(spark, model):
    rows = [(k // 2, f"u{k}", h, "x") for k, h in enumerate([*ODD_PAGES, "<div>" * 3000 + "deep", "<p>" * 5000 + "wide"])] + [(None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string, text string")
    got = {r["url"]: r["text"] for r in op5.extract(pages, model).collect()}
    assert len(got) == len(rows)
    for k, text in enumerate(ODD_PAGES.values()):
        if k != 4:
            assert got[f"u{k}"] == text
    assert got[f"u{len(ODD_PAGES)}"] == "deep" and got[f"u{len(ODD_PAGES) + 1}"] == "wide" and got[None] == ""
    assert op5.extract(pages.limit(0), model).collect() == []


def test_unclosed_anchors_and_stray_ends_take_linear_time(model):
    """Pages of old: anchors that are never closed, ends without a start, blocks deep inside unclosed inline elements."""
    times = {}
    for count in (5_000, 40_000):
        for name, part in {"anchors": "<a name=x>word ", "ends": "</i><b>word ", "blocks": "<a name=x><p class=k>word</p>"}.items():
            started = time.perf_counter()
            assert "word" in model.texts(["<article><h1>title</h1><p>" + "some words of prose, and more. " * 20 + "</p>" + part * count + "</article>"])[0]
            times[name, count] = time.perf_counter() - started
    for name in ("anchors", "ends", "blocks"):
        assert times[name, 40_000] < 30 * times[name, 5_000] + 0.5, times  # eight times the page


def vectors(spark, seed=0, count=600, size=16, clusters=12):
    own = np.random.default_rng(seed)
    centres = own.standard_normal((clusters, size))
    rows = [(k, int(own.integers(0, 3)), (centres[k % clusters] + own.standard_normal(size) * own.choice([0.01, 0.08, 0.6])).tolist()) for k in range(count)]
    rows += [(2000 + k, label, rows[k][2]) for k, label in enumerate([0, 1, 2, None, 0, 0])] + [(k, 0, rows[5][2]) for k in (3000, 3001)]
    rows += [(4000, 0, None), (4001, 0, [0.0] * size), (4002, 0, [float("nan")] * size), (4003, 0, [None] * size), (4004, 0, []),
             (4005, 0, [float("inf")] + [1.0] * (size - 1)), (4006, 0, [1.0, 2.0]), (4007, 0, [2.0, 4.0]), (None, 0, rows[1][2])]
    return rows, spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<double>, `_v` string, links int").repartition(3)


def valid(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


def neighbours(rows, chosen, k):
    """Ids and scores of the k nearest of each row with a chosen id, in order of the rows."""
    usable = [(i, np.array(v)) for i, _, v in rows if i is not None and valid(v)]
    found = []
    for n, (i, v) in enumerate(usable):
        if chosen(i):
            found.append((i, sorted((-float((v * w).sum()), j) for m, (j, w) in enumerate(usable) if m != n and len(w) == len(v))[:k]))
    return found


def answers(result):
    """The rows of each answer as a list, for every query id (one list per row that asked)."""
    found = {}
    for r in result:
        found.setdefault((r["query_id"], r["rank"]), []).append((r["vec_id"], r["score"]))
    return found


def test_nearest(spark):
    rows, df = vectors(spark)
    got = answers(op3.nearest(df, F.col("_id") % 10 == 0, k=8).collect())
    truth = neighbours(rows, lambda i: i % 10 == 0, 8)
    assert {i for i, _ in got} == {i for i, best in truth if best}
    recall = []
    for i, best in truth:
        own = [got[i, k][0] for k in range(1, len(best) + 1)]
        assert (i, len(best) + 1) not in got
        assert [(-s, j) for j, s in own] == sorted((-s, j) for j, s in own)
        recall.append(len({j for _, j in best} & {j for j, _ in own}) / max(1, len(best)))
        assert all(abs(s + dict((j, t) for t, j in best).get(j, -s)) < 1e-9 for j, s in own)
    assert np.mean(recall) >= 0.95
    assert op3.nearest(df.limit(0), F.col("_id") % 10 == 0).collect() == []


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_recall_on_the_test_tables(spark, folder):
    frame = spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet")
    table = [(r["vec_id"], None, r["embedding"]) for r in frame.collect()]
    got = answers(op3.nearest(frame, F.col("_id") % 20 == 0).collect())
    recall = []
    for i, best in neighbours(table, lambda i: i % 20 == 0, 20):
        own = {got[i, k][0][0] for k in range(1, 21)}
        recall.append(len(own & {j for _, j in best}) / 20)
    assert np.mean(recall) >= 0.95 and min(recall) >= 0.8


def test_rows_with_one_id_are_candidates_of_each_other(spark):
    frame = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.9, 0.1]), (1, [0.9, 0.1]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in op3.nearest(frame, F.col("_id") == 1, k=5).collect())
    assert got == [(1, 1, 1, 0.9), (1, 1, 1, 0.9), (1, 1, 1, 0.9), (1, 2, 1, 0.82), (1, 2, 1, 0.82), (1, 2, 1, 0.9), (1, 3, 2, 0.0), (1, 3, 2, 0.1), (1, 3, 2, 0.1)]


def test_huge_and_tiny_vectors(spark):
    rows = [(1, 0, [1e-170, 0.0]), (2, 0, [2e-170, 0.0]), (3, 1, [1e200, 0.0]), (4, 1, [1e200, 1e190]), (5, 1, [0.0, 1e200]), (6, 2, [1.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert [tuple(r)[:3] for r in op7.linked(frame).orderBy("vec_id").collect()] == [(1, 1, 1), (2, 1, 1), (3, 1, 3), (4, 1, 3), (5, 0, 5), (6, 0, 6)]
    got = answers(op3.nearest(frame, F.col("_id") > 0, k=2).collect())
    assert [got[3, 1][0], got[1, 1][0][0], got[6, 1][0]] == [(4, float("inf")), 3, (4, 1e200 + 1e190)]


def test_nearest_merges_blocks_in_stages(spark, monkeypatch):
    monkeypatch.setattr(op3, "MERGED", 2)
    rows, df = vectors(spark, 3, 200)
    monkeypatch.setattr(op3, "BLOCK", 30)
    monkeypatch.setattr(op3, "QUERY_BLOCK", 7)
    monkeypatch.setattr(op3, "ASKED_AT_ONCE", 2)
    got = answers(op3.nearest(df, F.col("_id") % 20 == 0, k=5).collect())
    recall = [len({j for _, j in best} & {got[i, k][0][0] for k in range(1, len(best) + 1)}) / max(1, len(best))
              for i, best in neighbours(rows, lambda i: i % 20 == 0, 5)]
    assert np.mean(recall) >= 0.95


@pytest.mark.parametrize(("cosine", "block", "clusters", "size"), [(0.98, 2048, 12, 16), (0.98, 50, 12, 16), (0.9, 70, 3, 4), (0.7, 2048, 40, 3)])
def test_links_equal_brute_force(spark, monkeypatch, cosine, block, clusters, size):
    monkeypatch.setattr(op7, "BLOCK", block)
    rows, df = vectors(spark, 1, clusters=clusters, size=size)
    parent = list(range(len(rows)))

    def top(k):
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    links = [0] * len(rows)
    for a, (_, la, va) in enumerate(rows):
        for b, (_, lb, vb) in enumerate(rows):
            if a < b and la is not None and la == lb and valid(va) and valid(vb) and len(va) == len(vb):
                x, y = np.array(va), np.array(vb)
                if (x * y).sum() / (np.linalg.norm(x) * np.linalg.norm(y)) >= cosine:
                    links[a] += 1
                    links[b] += 1
                    parent[top(a)] = top(b)
    low = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            low[top(k)] = min(low.get(top(k), i), i)
    expected = sorted(((i, links[k], low.get(top(k), i), i is not None and low[top(k)] == i) for k, (i, _, _) in enumerate(rows)), key=repr)
    assert sorted(map(tuple, op7.linked(df, cosine).collect()), key=repr) == expected
    assert op7.linked(df.limit(0)).collect() == []
