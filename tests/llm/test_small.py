"""Sharding, trees, page text and classifiers on small inputs."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from newsflow.llm import html_blocks, quality, sharding, toxicity, vptree


def place(spark, key):
    return spark.range(1).select(sharding.position(F.lit(key).cast("bigint"))).first()[0]


def test_ring_walk_equals_key_by_key(spark, documents):
    docs = documents([(i, "x" * (i % 7)) for i in range(500)])
    got = {r.doc_id: (r.shard, r.slot) for r in sharding.assign(docs, shards=5, vnodes=8).collect()}
    points = sharding.ring_points(spark, 5, 8)
    room = sharding.capacities(500, 5, 0.0)
    places = sorted((r[1], r[0]) for r in docs.select("doc_id", sharding.position(F.col("doc_id"))).collect())
    arcs = {}
    for p, key in places:
        arc = next((i for i, (at, _) in enumerate(points) if at >= p), 0)
        arcs.setdefault(arc, []).append(key)
    want, used, waiting = {}, [0] * 5, []
    for turn in range(2):
        for arc, (_, shard) in enumerate(points):
            waiting = (arcs.get(arc, []) if turn == 0 else []) + waiting
            while waiting and room[shard]:
                want[waiting.pop(0)] = (shard, used[shard])
                used[shard] += 1
                room[shard] -= 1
    # Keys behind the last point belong to the first arc, but come last in it only by their rank, not by their place.
    assert Counter(s for s, _ in got.values()) == Counter(s for s, _ in want.values())
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}


def test_ring_balance_with_hot_and_null_keys(spark, documents):
    rows = [(7, "same")] * 100 + [(None, None)] * 100 + [(i, "é") for i in range(100)]
    got = sharding.assign(documents(rows)).collect()
    count = Counter(r.shard for r in got)
    assert len(got) == 300 and max(count.values()) - min(count.values()) <= 1 and len(count) == 16
    for shard in count:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(count[shard]))
    assert {(r.size, r.text_crc32) for r in got if r.doc_id is None} == {(1, 0)}
    assert {(r.size, r.text_crc32) for r in got if r.doc_id == 50} == {(3, zlib.crc32("é".encode()))}


def test_ring_slack_empty_and_bad(spark, documents):
    few = sharding.assign(documents([(i, "t") for i in range(1000)]), slack=0.25)
    assert max(Counter(r.shard for r in few.collect()).values()) <= 79
    assert sharding.assign(documents([])).count() == 0
    with pytest.raises(ValueError):
        sharding.assign(documents([]), shards=0)


def test_tree_is_exact_with_ties_and_junk(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).round(1).tolist()) for i in range(400)]
    rows += [(1000 + i, [1.0] * 6) for i in range(300)]
    rows += [(2000, None), (2001, [0.0] * 6), (2002, [float("nan")] * 6), (2003, [1.0, None] + [1.0] * 4), (None, [1.0] * 6)]
    rows += [(2100, [float("inf")] + [1.0] * 5), (2200, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("v", F.lit(1))
    got = vptree.search(df, df.where("vec_id % 50 = 0"), shard_rows=150, block_rows=5).collect()
    good = [(i, v) for i, v in rows[:700]]
    ids, points = np.array([i for i, _ in good]), np.array([v for _, v in good], np.float32).astype(float)
    want = list(vptree.brute_force(ids, points, ids[ids % 50 == 0], 10))
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == sorted(want)


def test_tree_pruning_keeps_recall(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 8)) * 4
    rows = [(i, (centres[i % 20] + rng.normal(size=8)).tolist()) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    exact = {(r.query_id, r.vec_id) for r in vptree.search(df, df.where("vec_id % 100 = 0")).collect()}
    loose = {(r.query_id, r.vec_id) for r in vptree.search(df, df.where("vec_id % 100 = 0"), factor=1.5).collect()}
    assert len(exact & loose) >= 0.9 * len(exact) and len(loose) == len(exact)
    assert vptree.search(df.limit(0), df.limit(0)).count() == 0
    assert vptree.search(df.limit(3), df.limit(1)).count() <= 2


PAGE = """<html><head><title>no</title><style>p{}</style><script>if (a<b && c=="x") d='</p>'</script></head><body>
<header class="site">Name</header><nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav>
<div class=cookie-notice>We use things</div><div id="ad-1">Buy now</div><!-- <p>hidden</p> -->
<article><h1>Head &amp; line</h1><p>First   part,<br>same <b>block</b>&nbsp;here.</p><p>To.
<aside>Aside words</aside><form><label>Mail</label><input name=q></form><blockquote>Quoted text of some length</blockquote>
<section class="comments"><p>I disagree with all of it</p></section></article><footer>&copy; Name</footer>"""


def test_page_text(spark):
    rows = [(1, "u", PAGE, "x"), (2, "u", None, "x"), (3, None, "", "x"), (3, None, "", "x"), (None, "u", "<p", "x")]
    rows.append((4, "u", "<article>" + "<p>word</p>" * 20_000, "x"))
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = html_blocks.extract(pages).collect()
    by = {r.page_id: r for r in got}
    assert by[1].text == "Head & line\nFirst part, same block here.\nTo.\nQuoted text of some length"
    assert by[1].n_chars == len(by[1].text)
    assert by[2].text == "" and by[2].n_chars == 0 and by[3].text == ""
    assert by[4].text == "\n".join(["word"] * 20_000)
    assert len(got) == 6 and set(got[0].asDict()) == {"page_id", "url", "text", "n_chars", "n_blocks", "n_kept"}
    assert html_blocks.extract(pages.limit(0)).count() == 0


TEXT = " ".join(f"word{i}" for i in range(40))


@pytest.mark.parametrize(
    "before",
    [
        "<form><datalist id=d><option value=a><option value=b></datalist></form>",
        "<form><select><option>Kept out<option>Kept out</form>",
        "<option value=a>Kept out",
        *(f"<div><{t}>Kept out</div>" for t in ("object", "svg", "template", "noscript", "select", "datalist")),
        "<object data=x><param name=y>Kept out",
        "<svg><g><path d=x><text>Kept out</text></g>",
        "<noscript><img src=x>",
        "<head><noscript><style>x</style></head>",
        "<div><template><p>Kept out</p><article>Kept out</article></template></div>",
    ],
)
def test_elements_without_end_tag_keep_the_article(before):
    tree = html_blocks.grow(*html_blocks.training_table())
    after = "<footer><select><option>English</option></select><object></object><svg></svg><noscript></noscript></footer>"
    for tail in ("", after):
        text = html_blocks.main_text(f"<body>{before}<article><h1>Head</h1><p>{TEXT}</p></article>{tail}</body>", tree)[0]
        assert text == f"Head\n{TEXT}"


@pytest.mark.parametrize("says", ['class="advert"', "id=cookieNotice", 'role="search"', "hidden", 'style="display: none"'])
@pytest.mark.parametrize(
    "inner",
    [
        "<p {}>Out of it</p>",
        "<p {}>Out of it",
        *(f"<h{n} {{}}>Out of it</h{n}>" for n in range(1, 7)),
        "<h2 {}>Out of it",
        "<ul><li {}>Out of it</ul>",
        "<ul><li {}><p>Out of it</p><div>Out too</div></li></ul>",
        "<dl><dt {}>Out of it</dl>",
        "<dl><dd {}>Out of it</dl>",
        "<table><tr {}><td>Out of it</table>",
        "<table><tr><td {}>Out of it</table>",
        "<table><tr><th {}>Out of it</table>",
    ],
)
def test_hints_of_elements_that_end_by_themselves(inner, says):
    tree = html_blocks.grow(*html_blocks.training_table())
    page = f"<article><p>{TEXT}</p>{inner.format(says)}<p>{TEXT}</p></article>"
    assert html_blocks.main_text(page, tree)[0] == f"{TEXT}\n{TEXT}"


def test_cells_of_a_table_layout():
    tree = html_blocks.grow(*html_blocks.training_table())
    page = f"<form><table><tr><td class=sidebar>{TEXT}<td class=content><p>{TEXT} end<ul><li>One<li class=comment>No<li>Two</ul></table></form>"
    assert html_blocks.main_text(page, tree)[0] == f"{TEXT} end\nOne\nTwo"
    page = f"<article><h2 id=discussion class=header>Discussion</h2><p>{TEXT}</p></article><footer><p class=text>{TEXT}</p></footer>"
    assert html_blocks.main_text(page, tree)[0] == f"Discussion\n{TEXT}"


@pytest.mark.parametrize(
    "opens",
    [
        *(f'<body class="{c}"><div>' for c in "has-sidebar no-sidebar page-form legal-news with-comments text-search".split()),
        '<html class="hidden-js no-js header-fixed"><body><div>',
        *(f'<body><div class="{c}">' for c in ("post related-story", "legal-news", "layout has-sidebar", "no-comments")),
    ],
)
def test_names_that_speak_of_the_page_lose_no_article(opens):
    tree = html_blocks.grow(*html_blocks.training_table())
    page = f"{opens}<h1>Three word title</h1><p>{TEXT}</p><p>{TEXT}</p></div></body></html>"
    assert html_blocks.main_text(page, tree)[0] == f"Three word title\n{TEXT}\n{TEXT}"


@pytest.mark.parametrize(
    "name", ["post-sidebar", "comment-body", "commentsArea", "ad-slot", "related-posts", "sidebar", "post-footer content", "cookie-notice"]
)
def test_names_of_boilerplate(name):
    tree = html_blocks.grow(*html_blocks.training_table())
    page = f'<body><article><p>{TEXT}</p></article><div class="{name}"><p>{TEXT}</p></div></body>'
    assert html_blocks.main_text(page, tree)[0] == TEXT


def test_links_in_an_article_belong_to_it():
    tree = html_blocks.grow(*html_blocks.training_table())
    links = "<ul><li><a href=x>First source</a><li><a href=y>Second source of it</a></ul><p>See <a href=z>this list of words</a></p>"
    page = f"<body><nav><a href=a>Away</a></nav><article><p>{TEXT}</p>{links}</article><p><a href=b>Home</a></p></body>"
    assert html_blocks.main_text(page, tree)[0] == f"{TEXT}\nFirst source\nSecond source of it\nSee this list of words"


def test_math_is_text():
    page = f"<article><p>{TEXT} <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>tex</annotation></math> holds</p></article>"
    assert [b.text for b in html_blocks.blocks(page)] == [f"{TEXT} x=1 holds"]


def test_page_tree_learns_its_table():
    x, y = html_blocks.training_table()
    assert (html_blocks.decide(html_blocks.grow(x, y), x) == y).all()


def labelled(prose):
    rows, marks = [], []
    for i in range(300):
        words = prose(60, i).split()
        bad = i % 5 == 0
        if bad:
            for k in range(1 + i % 4):
                words.insert(7 * k, ["blorg", "Snarfed!", "blorgest"][(i + k) % 3])
        rows.append((i, " ".join(words).upper() + "!!" if i % 3 == 0 else " ".join(words)))
        marks.append((i, int(i % 3 != 0), int(bad)))
    return rows, marks


def test_toxicity(spark, documents, prose):
    rows, marks = labelled(prose)
    docs = documents([*rows, (900, None), (901, ""), (None, "blorg snarfed blorg"), (5, rows[5][1])])
    docs = docs.withColumn("tox_severity", F.lit("clash"))
    labels = spark.createDataFrame([m for m in marks if m[0] % 7] + [(1, None, None)], "doc_id bigint, quality int, toxic int")
    model = toxicity.train(docs, labels)
    assert (np.diff(model.thresholds) > 0).all()
    got = toxicity.score(docs, model).collect()
    toxic = {i for i, _, t in marks if t}
    held = [r for r in got if r.doc_id is not None and r.doc_id % 7 == 0 and r.doc_id < 900]
    assert all(r.tox_rejected == (r.doc_id in toxic) for r in held)
    assert not any(r.tox_rejected for r in got if r.doc_id in (900, 901))
    assert [r.tox_rejected for r in got if r.doc_id is None] == [True]
    assert len(got) == len(rows) + 4
    severe = [r.tox_severity for r in held if r.doc_id in toxic]
    assert all(0 <= s <= 2 for s in severe) and max(severe) > 1
    none = toxicity.train(docs, labels.limit(0))
    assert not any(r.tox_rejected for r in toxicity.score(docs, none).collect())
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_toxicity_where_toxic_rows_are_common(spark, documents, prose):
    def text(i):
        return prose(60, i) + (" blorg snarfed" if i % 20 < 7 else "")

    rows = [(i, text(i)) for i in range(240)]
    train, held = [i for i in range(240) if i % 3], [i for i in range(240) if i % 3 == 0]
    labels = [(i, 1, int(i % 20 < 7)) for i in train]
    copies = [(1000 + i, prose(60, 999) + " vextor") for i in range(150)]  # a hot group of toxic copies
    for group in ([], copies):
        docs = documents(rows + group)
        marks = spark.createDataFrame(labels + [(i, 1, 1) for i, _ in group], "doc_id bigint, quality int, toxic int")
        got = {r.doc_id: r.tox_rejected for r in toxicity.score(docs, toxicity.train(docs, marks)).collect()}
        assert all(got[i] == (i % 20 < 7) for i in held)
        assert all(got[i] for i, _ in group)


def test_training_holds_few_rows_at_a_time():
    n = 3 * toxicity.HELD + 1
    columns = [range(n), [i % 2 for i in range(n)], [1] * n, [f"word{i} word{i} x" for i in range(n)]]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc_id", "toxic", "copies", "text"])
    out = list(toxicity.feature_rows([batch]))
    assert max(b.num_rows for b in out) <= toxicity.HELD
    rows = [r for b in out for r in b.to_pylist()]
    assert [r["doc_id"] for r in rows] == [*range(n)]
    assert all(dict(zip(r["f"], r["n"])) == toxicity.counted(t) for r, t in zip(rows, columns[3]))


def test_ordinal_fit_orders_grades():
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 6, 400)
    grades = np.where(counts == 0, 0, np.where(counts < 3, 1, 2))
    row = np.flatnonzero(counts)
    w, theta = toxicity.fit(row, np.zeros(len(row), int), counts[row], grades, 1, l2=1e-7)
    score = w[0] * np.log1p(counts)
    assert ((score[:, None] > theta).sum(axis=1) == grades).mean() > 0.95


def test_quality_reads_whole_words():
    assert quality.shape("Two-fold!!") == "Xx-x!" and quality.shape("") == "" and quality.shape("日本é٣🙂🙂") == "x9🙂"
    mixed = "Ab9-é日٣!!aa" * 9
    assert quality.shape(mixed) == "Xx9-x9!x" + "Xx9-x9!x" * 8
    head, shapes = "Ab9-" * 40, quality.Shapes()
    one, other = (quality.terms(head + tail, shapes) for tail in ("aB3/" * 3000, "+7xY=" * 3000))
    assert (one != other).any() and one.sum() > 1000
    assert (one == quality.terms(head + "aB3/" * 3000, shapes)).all() and not shapes.known
    assert (quality.terms("日本、" * 50 + "。" * 9 + "日「本」" * 50, shapes) != quality.terms("日本、" * 50, shapes)).any()
    assert len(quality.pieces_of("word")) == 1


def test_quality(spark, documents, prose):
    rows, marks = labelled(prose)
    docs = documents([*rows, (900, None), (901, "")]).withColumn("quality_score", F.lit("clash"))
    labels = spark.createDataFrame([m for m in marks if m[0] % 7], "doc_id bigint, quality int, toxic int")
    model = quality.train(docs, labels)
    got = {r.doc_id: r.quality_score for r in quality.score(docs, model).collect()}
    good = {i for i, q, _ in marks if q}
    assert len(got) == 302 and all(0 <= s <= 1 for s in got.values()) and got[900] == got[901]
    assert all((got[i] >= quality.CUT) == (i in good) for i, *_ in marks if i % 7 == 0)
    empty = quality.train(docs, labels.limit(0))
    assert {r.quality_score for r in quality.score(docs, empty).collect()} == {0.5}
    assert quality.score(docs.limit(0), model).count() == 0


def test_toxicity_stage_keeps_columns_and_bounds_its_sample(spark, tmp_path):
    rows = [(i % 5, f"blorg snarf word{i}" if i % 3 == 0 else f"calm plain text number{i}", float(i)) for i in range(300)]
    rows += [(None, None, 0.5), (7, "", 0.1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, tox_severity double").withColumn("_row", F.lit(1)).withColumn("tox_rejected", F.lit("own"))
    marks = spark.createDataFrame([(i, int(i == 0)) for i in range(5)], "doc_id bigint, toxic int")
    marks.write.parquet(f"file://{tmp_path}/labels.parquet")
    got = toxicity.stage(spark, docs, f"file://{tmp_path}")
    assert got.columns == docs.columns
    assert {tuple(r) for r in got.collect()} <= {tuple(r) for r in docs.collect()}
    assert toxicity.stage(spark, docs.limit(0), f"file://{tmp_path}").collect() == []
    seen = []
    fit = toxicity.fit

    def spy(row, col, val, grades, n, **more):
        seen.append(len(grades))
        return fit(row, col, val, grades, n, **more)

    toxicity.fit = spy
    try:
        toxicity.train(docs, marks, max_rows=2)
        toxicity.train(docs, marks)
    finally:
        toxicity.fit = fit
    assert all(n <= 5 for n in seen)
