"""The site style tree against plain Python, and what it decides."""

import collections
import html
import math
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import html_extraction as tree
from tests.llm.test_operators import prose


def site(pages, host="a.example.org", seed=0):
    """Pages with a menu and a footer that differ on each, without any name that says so."""
    r, out = random.Random(seed), []
    for k in range(pages):
        menu = "".join(f"<li><a href=/{w}>{w}{k}</a></li>" for w in r.choices("ab cd ef gh ij".split(), k=4))
        body = "".join(f"<p>{prose(r.randint(3, 90), 1000 * seed + 10 * k + j)}, {j}.</p>" for j in range(r.randint(2, 9)))
        out.append((k, f"https://{host}/{k}", f"<body><div class=m><ul>{menu}</ul></div><div class=text><h2>Title {k}</h2>{body}</div><div class=by>Written by {prose(2, k)}</div></body>"))
    return out


def frame(spark, pages):
    return spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)


def brute_importance(pages):
    hosts = collections.defaultdict(dict)
    for _, url, source in pages:
        hosts[url.split("/")[2]][source] = tree.parse(source)
    found = {}
    for host, parsed in hosts.items():
        m = len(parsed)
        if m < 2:
            continue
        counts, children = collections.defaultdict(collections.Counter), collections.defaultdict(list)
        for blocks, styles in parsed.values():
            for b in {(b.home, "outline", b.outline) for b in blocks} | {(b.path, "text", b.text) for b in blocks}:
                counts[b[:2]][b[2]] += 1
            for home in {b.home for b in blocks}:
                for style in set(styles.get(home, ())):
                    counts[home, "style"][style] += 1
                    children[home].append(style.count("|") + 1)
        for (path, kind), c in counts.items():
            logs = [math.log(x, m) for x in c.values()]
            if kind == "text":
                found[host, path, tree.TEXT] = 1 - sum(logs) / len(logs)
            elif kind == "outline":
                found[host, path, tree.OUTLINE] = 1 - sum(x * math.log(x, m) for x in c.values()) / sum(c.values())
        for (path, kind), c in counts.items():
            if kind == "style":
                total, weight = sum(c.values()), tree.DAMPING ** (sum(children[path]) / len(children[path]))
                entropy = -sum(x / total * math.log(x / total, m) for x in c.values())
                found[host, path, tree.OUTLINE] = (1 - weight) * entropy + weight * found[host, path, tree.OUTLINE]
    return found


def test_importance(spark):
    pages = [*site(30), *site(30)[:3], *site(4, "b.example.org", 2), (77, "https://alone.example.org/", site(1)[0][2] + " ")]
    want = brute_importance(pages)
    rows = tree.importance(tree.parsed(frame(spark, pages))).collect()
    assert {(r.host, r.path, r.kind) for r in rows} == set(want) and len(rows) == len(want)
    assert all(r.importance == pytest.approx(want[r.host, r.path, r.kind], abs=1e-9) for r in rows)
    assert {r.m for r in rows if r.host == "a.example.org"} == {30}
    at = {r.path: r.importance for r in rows if r.host == "a.example.org" and r.kind == tree.OUTLINE}
    assert at[">body>div.text"] > 0.45 and at[">body>div.m"] == pytest.approx(0, abs=1e-9) and at[">body>div.by"] < 0.4


@pytest.mark.parametrize("size", [0, 1 << 20])
def test_the_tree_decides(spark, size):
    pages = [*site(60), (99, "https://alone.example.org/1", site(1)[0][2].replace("class=m", "class=menu"))]
    df = frame(spark, pages)
    got = {r.page_id: r.text for r in tree.extract(df, broadcast_bytes=size).collect()}
    off = {r.page_id: r.text for r in tree.extract(df, threshold=0.0, broadcast_bytes=size).collect()}
    for i in range(60):
        assert got[i].startswith(f"Title {i}\n\n") and "Written by" not in got[i] and off[i].count("\n") > got[i].count("\n")
    assert got[99].startswith("Title 0") and "Written by" in got[99] and got[99] == off[99]


def test_markup_is_a_prior():
    source = """<body><div id="site-header">Top</div><header>Also top</header><div class="cookie-notice">Cookies</div><main><header><h1>Title</h1></header><p>Body<aside>side</aside>
    <form><p>Name</form><p hidden>unseen<p class="lead">More</p><div aria-hidden="true">gone</div><div class="legal-history">Law</div><section class="reader-comments"><p>bad</section></main>
    <div class="ad-slot-2">Buy</div><div role="contentinfo">f</div><p>outside"""
    blocks = tree.parse(source)[0]
    stances = collections.defaultdict(list)
    for b, side in zip(blocks, tree.sided(blocks), strict=True):
        stances[side].append(b.text)
    assert stances == {0: ["Title", "Body", "More", "Law"], 1: ["Top", "Also top", "Cookies", "side", "Name", "f", "outside"], 2: ["bad", "Buy"]}


def test_hard_pages(spark):
    long = "<article>" + "".join(f"<p>{prose(50, k)}</p>" for k in range(4000)) + "</article><footer>f</footer>"
    pages = [(1, "https://a.example.org/", long), (2, "https://a.example.org/", None), (3, "https://a.example.org/", ""), (4, None, long), (1, "https://a.example.org/", long)]
    got = tree.extract(frame(spark, pages).withColumn("row", F.lit(1)).withColumn("key", F.lit("k"))).collect()
    want = "\n\n".join(" ".join(prose(50, k).split()) for k in range(4000))
    assert sorted((r.page_id, r.text == want, r.n_chars) for r in got) == [(1, True, len(want)), (1, True, len(want)), (2, False, 0), (3, False, 0), (4, True, len(want))]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no driver tables")
def test_the_tables_need_the_tree(spark):
    """With all verdicts left out, nothing goes on hosts of many pages; with all markup left out, the tree alone is right on most of these."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    on, treeless, unmarked = ({r.page_id: r.text for r in tree.extract(pages, **options).collect()} for options in ({}, {"tree": False}, {"markup": False}))
    assert sum(on[k] != treeless[k] for k in on) > 0.9 * len(on)
    assert sum(on[k] != unmarked[k] for k in on) < 0.2 * len(on)
    for k in on:
        assert on[k] and set(on[k].split("\n\n")) <= set(unmarked[k].split("\n\n")) <= set(treeless[k].split("\n\n"))
    # Truth written by hand for the table's first pages: title, paragraphs and lists of the article, no menu, advert or footer.
    for r in pages.where("page_id < 40").collect():
        inside = r.html[r.html.index("<article>") : r.html.index("</article>")]
        words = set(re.findall(r"\w+", html.unescape(re.sub(r"<[^>]*>", " ", inside))))
        assert set(re.findall(r"\w+", on[r.page_id])) == words
