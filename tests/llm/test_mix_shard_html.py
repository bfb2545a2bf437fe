"""Mixing and sharding by their laws, template extraction on pages whose article is known."""

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from gaitwright.llm import htmltemplate, mixing, sharding

COLUMNS = ["doc_id", "size", "source_size", "target", "taken"]


def sql_mix(docs):
    con = duckdb.connect()
    con.register("d", docs.select("doc_id", "text", "source").toPandas().convert_dtypes())
    con.execute("create view documents as select * from d")
    return con.execute(f"select {', '.join(COLUMNS)} from ({mixing.MIX_SQL})").fetchall()


def test_mix_equals_sql(spark, documents):
    got = [tuple(r) for r in mixing.mix(documents).select(*COLUMNS).collect()]
    assert sorted(got) == sorted(sql_mix(documents))


def test_mix_law(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix(docs).select("source", *COLUMNS).collect()
    taken, target, largest = defaultdict(int), {}, defaultdict(int)
    for r in rows:
        largest[r.source] = max(largest[r.source], r.size)
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken <= 3 * r.size and r.target <= 3 * r.source_size
    assert sum(target.values()) == pytest.approx(sum(r.size for r in rows))
    # Prefix sums over documents in order of size: the words taken are off by less than one document.
    assert all(abs(taken[s] - target[s]) < largest[s] for s in target)


def test_mix_odd_rows(spark, odd_documents, no_documents):
    mixed = mixing.mix(odd_documents)
    assert mixed.count() == odd_documents.count() and mixed.columns.count("size") == 1
    assert sorted(map(str, mixed.select(*COLUMNS).collect())) == sorted(map(str, mixing.mix(odd_documents.repartition(3)).select(*COLUMNS).collect()))
    assert mixing.mix(no_documents).count() == 0
    copies = mixing.emit_copies(mixed)
    assert copies.count() == mixed.agg(F.sum("copies")).first()[0]


def test_shards_are_even_and_gapless(spark, documents):
    rows = sharding.shard_documents(documents).collect()
    counts = Counter(r.shard for r in rows)
    assert set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    text = {r.doc_id: (r.text or "").encode() for r in documents.collect()}
    assert all(r.size == len(text[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id]) and r.law == "rows" for r in rows)


def test_growth_moves_few_keys(spark):
    ids = spark.range(4000)
    for slack, most in ((1.0, 0.13), (1.25, 0.09)):
        a, b = ({r.id: r.shard for r in sharding.shard_rows(ids, F.col("id"), n, slack=slack).collect()} for n in (16, 17))
        assert sum(a[i] != b[i] for i in a) < most * len(a)


def test_keys_walk_the_ring_clockwise(spark):
    """Each key is on the first shard from its home on that had room for keys of its distance."""
    rows = sharding.shard_rows(spark.range(3000), F.col("id"), 7, 16).collect()
    points = sharding.ring_points(7, 16)
    loads = Counter(r.shard for r in rows)
    assert sorted(loads.values()) == sorted(sharding.bounds(3000, 7, 1.0))
    home = 0
    for r in rows:
        cell = int(hashlib.md5(str(r.id).encode()).hexdigest()[:8], 16) * sharding.CELLS >> 32
        first = next((i for i, (c, _) in enumerate(points) if c >= cell), 0)
        home += points[first][1] == r.shard
    # The keys that left home are those beyond the bound of their home shard, none else.
    at_home = Counter(points[next((k for k, (c, _) in enumerate(points) if c >= int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) * sharding.CELLS >> 32), 0)][1] for i in range(3000))
    beyond = sum(max(0, n - loads[s]) for s, n in at_home.items())
    assert len(rows) - home >= beyond and home >= 3000 - 2 * beyond


def test_equal_keys_have_places_that_stay(spark):
    rows = [(None if i % 3 else 7, i % 50) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, v int")
    a, b = (sorted(map(str, sharding.shard_rows(d, F.col("id"), 5).collect())) for d in (df, df.repartition(7)))
    assert a == b


def test_shard_odd_rows(spark, odd_documents, no_documents):
    placed = sharding.shard_rows(odd_documents, F.col("doc_id"), 4)
    rows = placed.collect()
    assert len(rows) == odd_documents.count() and placed.columns.count("shard") == 1
    assert len({(r.shard, r.slot) for r in rows}) == len(rows)
    assert sharding.shard_documents(no_documents).count() == 0


PAGE = """<html><head><title>{t}</title><style>p{{}}</style><script>var a="<p>no</p>";</script></head><body>
<header>Site</header><nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="ad">Buy now</div>
<article><h1>{t}</h1><p>{a} &amp; more<p>Second   para<br>line</p><ul><li>one</li><li>two</li></ul><div class="comments"><p>First!</p></div></article>
<form><input name="q"><button>Go</button></form><aside>Links</aside><div class="cookie-notice">We use cookies</div><footer>Contact</footer></body></html>"""


def test_article_is_kept_and_the_rest_goes(spark):
    rows = [(i, f"http://h{i % 2}.example.com/{i}", PAGE.format(t=f"Title {i}", a=f"Text {i}")) for i in range(12)]
    got = htmltemplate.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    for r in got:
        assert r.text == f"Title {r.page_id}\n\nText {r.page_id} & more\n\nSecond para line\n\none\n\ntwo" and r.n_chars == len(r.text)


def test_pages_without_main_lose_repeated_blocks(spark):
    rows = [(i, f"http://h.example.com/{i}", f"<div><p>Welcome to us</p><div><p>Story {i}</p></div><p>All rights</p></div>") for i in range(8)]
    got = htmltemplate.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {f"Story {i}" for i in range(8)}


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "http://a/", ""), (3, "", "<p>cut <b>off"), (4, "x", "plain &lt;text&gt;"), (None, None, "<"), (5, "http://a/", "<div " * 500), (5, "http://a/", "<div " * 500)]
    got = htmltemplate.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    by = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and by[1] == "" == by[2] and by[3] == "cut off" and by[4] == "plain <text>"
    assert htmltemplate.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_classes_nest(spark):
    rows = [(i, f"http://h.example.com/{i}", PAGE.format(t=f"Title {i}", a=f"Text {i}")) for i in range(8)]
    templates = htmltemplate.deduce_templates(spark.createDataFrame(rows, "page_id long, url string, html string"))
    nested = htmltemplate.nest_classes(templates).collect()
    assert sum(r.root for r in nested) >= 1


@pytest.mark.parametrize("page", [
    '<html class="no-banner"><body><div class="post ad-free"><p>Story</p></div></body></html>', '<body class="has-sidebar"><article><p>Story</p></article></body>', '<body><article class="has-comments"><p>Story</p><div class="comments">First</div></article></body>',
    '<body><div class="content with-sidebar"><p>Story</p></div><div class="cookie-notice">Cookies</div></body>', '<body><p>Skip</p><div class="layout sidebar-left"><main><p>Story</p></main></div></body>', '<body><div class="search-page"><article>Story</article></div></body>',
    '<body><article>Story</article><div class="related-posts"><article>Other</article></div></body>',
])
def test_words_of_the_frame_do_not_drop_the_article(page):
    assert htmltemplate.extract_page(page, []) == "Story"


def test_odd_pages_of_a_host_do_not_empty_its_template(spark):
    page = "<div><p>Welcome</p><div><p>Story {}</p></div><p>Welcome</p><p>All rights</p></div>"
    rows = [(i, f"http://h.example.com/{i}", page.format(i)) for i in range(20)]
    rows += [(20, "http://h.example.com/20", None), (21, "http://h.example.com/21", ""), (22, "http://h.example.com/22", "<article>Other</article>"), (23, "http://h.example.com/23", "<p>cut")]
    rows += [(i, f"http://small.example.com/{i}", page.format(i)) for i in (30, 31)] + [(i, "http://copies.example.com/", page.format(40)) for i in (40, 41)]
    got = {r.page_id: r.text for r in htmltemplate.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    whole = "Welcome\n\nStory 40\n\nWelcome\n\nAll rights"
    assert got == {i: f"Story {i}" for i in (*range(20), 30, 31)} | {20: "", 21: "", 22: "Other", 23: "cut", 40: whole, 41: whole}


NEUTRAL = '<body><div class="k1"><p>{m}</p></div><div class="k2"><p>{a}</p><p>{b}</p></div><div class="k3"><p>{c}</p></div></body>'


def test_slots_decide_where_names_tell_nothing(spark):
    words = lambda i, n: " ".join(f"w{i * 31 % 97 + k * 7}" for k in range(n))
    rows = [(i, f"http://n.example.com/{i}", NEUTRAL.format(m=words(i, 3), a=words(i + 50, 30), b=words(i + 90, 20), c=words(i + 70, 4))) for i in range(12)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in htmltemplate.extract_pages(pages).collect()}
    assert got == {i: f"{words(i + 50, 30)}\n\n{words(i + 90, 20)}" for i in range(12)}
    assert htmltemplate.extract_page(rows[3][2], []) != got[3]  # without the template all slots stay
    # The same by brute force: the innermost container that is on all pages and holds most of the text.
    counts = [Counter(), Counter()]
    for _, _, page in rows:
        held = htmltemplate._masses(list(htmltemplate.scan(page)))
        counts[0].update(held.keys())
        counts[1].update(held)
    whole = max(counts[1].values())
    big = {k for k, n in counts[0].items() if n == 12 and counts[1][k] >= htmltemplate.MOST * whole and k}
    chosen = {r.chosen for r in htmltemplate.main_containers(htmltemplate.deduce_templates(pages)).collect()}
    assert chosen <= big and len(chosen) == 1 and counts[1][chosen.pop()] == min(counts[1][k] for k in big)


PAGES = "page_id long, url string, html string"


def some_words(i, n):
    return " ".join(f"w{i * 31 % 97 + k * 7}" for k in range(n))


def test_unnamed_containers_are_told_apart_by_their_number(spark):
    """Three containers without names: by their path they are one token that stands three times."""
    page = "<body><div><p>{}</p></div><div><p>{}</p><div><p>{}</p></div><div><p>{}</p></div></div><div><p>{}</p></div></body>"
    rows = [(i, f"http://u.example.com/{i}", page.format(some_words(i, 3), some_words(i + 50, 5), some_words(i + 90, 3), some_words(i + 20, 40), some_words(i + 70, 4))) for i in range(12)]
    rows += [(12, "http://u.example.com/12", "<body><div><p>odd</p></div></body>")]  # one odd page changes nothing
    got = {r.page_id: r.text for r in htmltemplate.extract_pages(spark.createDataFrame(rows, PAGES)).collect()}
    # Inside the second container the second of two is told apart in a later round.
    assert got == {i: some_words(i + 20, 40) for i in range(12)} | {12: "odd"}


def test_places_in_a_class_tell_roles_apart(spark):
    """A fixed text between two runs of unnamed containers of changing number."""
    page = "<body>{}<h2>Read on</h2><div><p>{}</p></div></body>"
    few = lambda i: "".join(f"<div><p>{some_words(i + k, 2)}</p></div>" for k in range(1 + i % 3))
    rows = [(i, f"http://p.example.com/{i}", page.format(few(i), some_words(i + 50, 60))) for i in range(12)]
    got = {r.page_id: r.text for r in htmltemplate.extract_pages(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {i: some_words(i + 50, 60) for i in range(12)}


def test_each_layout_of_a_host_has_its_main_container(spark):
    a = '<body><div class="k1"><p>{m}</p></div><div class="k2"><h1>{t}</h1><p>{b}</p></div></body>'
    b = '<body><table class="q1"><tr><td class="q2"><h1>{t}</h1><p>{b}</p></td><td class="q3"><p>{m}</p></td></tr></table></body>'
    rows = [(i, f"http://l.example.com/{i}", (a, b)[i % 2].format(m=some_words(i, 3), t=some_words(i + 9, 2), b=some_words(i + 50, 40))) for i in range(16)]
    got = {r.page_id: r.text for r in htmltemplate.extract_pages(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {i: f"{some_words(i + 9, 2)}\n\n{some_words(i + 50, 40)}" for i in range(16)}


def test_repeated_classes_with_a_fixed_text_are_no_article(spark):
    """Readers' words in containers without telling names, inside the article; lists without such a text stay."""
    said = lambda i, k: f'<div class="z9"><p>{some_words(i + 13 * k, 4)}</p><div class="z8"><p>Answer this</p></div></div>'
    page = "<body><article><h1>{t}</h1><p>{b}</p><ul>{l}</ul>{c}</article></body>"
    rows = [
        (i, f"http://r.example.com/{i}", page.format(t=some_words(i, 2), b=some_words(i + 50, 60), l="".join(f"<li>item {i} {k}</li>" for k in range(2 + i % 3)), c="".join(said(i, k) for k in range(i % 4))))
        for i in range(16)
    ]
    got = {r.page_id: r.text for r in htmltemplate.extract_pages(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {i: "\n\n".join([some_words(i, 2), some_words(i + 50, 60), *(f"item {i} {k}" for k in range(2 + i % 3))]) for i in range(16)}


def test_tokens_out_of_order_leave_their_class(spark):
    page = '<body><div class="a"><p>{}</p></div><div class="b"><p>{}</p></div></body>'
    swapped = '<body><div class="b"><p>{}</p></div><div class="a"><p>{}</p></div></body>'
    rows = [(i, f"http://o.example.com/{i}", (page, swapped)[i % 2].format(some_words(i, 5), some_words(i + 50, 5))) for i in range(12)]
    pages = spark.createDataFrame(rows, PAGES)
    assert htmltemplate.deduce_templates(pages).filter("root and own").count() == 2  # the body and the one of the two that kept its class
