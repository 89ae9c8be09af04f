"""Near duplicates, components, pages and the pipeline against plain Python."""

import random

import numpy as np
import pytest
from oracle import differences
from pyspark.sql import functions as F

import corpus_pipeline
from cohortloom.llm import embedding_dedup, html_extract, html_pages, near_dedup
from cohortloom.llm.components import components
from cohortloom.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, id long, component string, bands string"


def closure(links, nodes):
    root = {i: i for i in nodes}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {i: top(i) for i in nodes}


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(150)] + [(k, k + 1) for k in range(400, 520)] + [(600, 600), (700, None)]
    links += [(800, 900 + k) for k in range(50)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if b is not None and a != b]
    nodes = {x for p in real for x in p}
    assert found == closure(real, nodes)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def documents(spark, texts):
    return spark.createDataFrame([(i, x, "en", 7, "c", "b") for i, x in texts], DOCS)


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def plain_groups(texts):
    sets = {i: shingle_set(x) for i, x in texts}
    ids = sorted(sets)
    links = [
        (a, b) for k, a in enumerate(ids) for b in ids[k + 1 :]
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    ]
    group = closure(links, ids)
    return {i: (len(sets[i]), group[i], group[i] == i) for i in ids}


def near_texts(n, seed):
    """Families of edited copies, of which many lie close to the threshold."""
    rng = random.Random(seed)
    words = ["w%d" % k for k in range(400)]
    texts = []
    for family in range(n):
        base = rng.choices(words, k=rng.randint(3, 90))
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(rng.choice([" ", "\n", "\t "]).join(copy).upper() if rng.random() < 0.2 else " ".join(copy))
    return texts


def test_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "CHUNK", 3)
    monkeypatch.setattr(near_dedup, "BLOCK", 5)
    hot = random.Random(3).choices(["h%d" % k for k in range(300)], k=60)
    crowd = []
    for k in range(40):
        copy = list(hot)
        for j in range(k % 4):
            copy[(13 * k + 17 * j) % 60] = f"x{k}"
        crowd.append(" ".join(copy))
    texts = [*near_texts(40, 2), *crowd, None, "", "  \n", "one two", "One TWO", "one two three four five", "é É a b c d", *["copy of the same words here"] * 20, "long " + " ".join("q%d" % k for k in range(30_000))]
    rows = list(zip(random.Random(5).sample(range(10_000), len(texts)), texts, strict=True))
    docs = documents(spark, rows).repartition(6)
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect()}
    assert found == plain_groups(rows)


def test_near_duplicate_edges(spark):
    assert near_dedup.near_duplicates(documents(spark, [])).count() == 0
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (9, None)]
    found = [tuple(r) for r in near_dedup.near_duplicates(documents(spark, rows)).collect()]
    assert sorted(found, key=str) == sorted([(None, 2, None, False), (4, 2, 2, False), (2, 2, 2, True), (2, 2, 2, True), (9, 0, 9, True)], key=str)


def test_min_max_agreement_is_the_likeness():
    rng = np.random.default_rng(1)
    common, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (600, 200, 200))
    agree = [
        (near_dedup.min_max(near_dedup.mixed(np.concatenate([common, a]) + np.uint64(k))) == near_dedup.min_max(near_dedup.mixed(np.concatenate([common, b]) + np.uint64(k)))).mean()
        for k in range(40)
    ]
    assert np.mean(agree) == pytest.approx(0.6, abs=0.03)


VECTORS = "vec_id long, embedding array<float>, label int, kind string, code string"


def plain_links(rows):
    links, counts = [], {}
    unit = {}
    for i, v, label in rows:
        counts[i] = 0
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            u = np.array(v, np.float32).astype(float)
            unit[i] = (label, len(v), u / np.linalg.norm(u))
    ids = sorted(unit)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if unit[a][:2] == unit[b][:2] and unit[a][2] @ unit[b][2] >= 0.93:
                links.append((a, b))
                counts[a] += 1
                counts[b] += 1
    group = closure(links, counts)
    return {i: (n, group[i], group[i] == i) for i, n in counts.items()}


def vector_rows(seed=2):
    rng = np.random.default_rng(seed)
    rows = []
    for family in range(40):
        base = rng.standard_normal(16)
        for _ in range(rng.integers(1, 8)):
            rows.append(((base + rng.standard_normal(16) * rng.choice([0.0, 0.1, 0.25, 0.4])).tolist(), int(family % 3)))
    crowd = rng.standard_normal(16)
    rows += [((crowd + rng.standard_normal(16) * 0.1).tolist(), 1) for _ in range(90)]
    rows += [([1.0] * 16, 2)] * 30
    rows += [(None, 1), ([], 1), ([0.0] * 16, 1), ([None] + [1.0] * 15, 2), ([float("nan")] * 16, 1), ([float("inf")] * 16, 1), ([1.0] * 16, None), ([1.0] * 8, 2), ([-0.0] + [1.0] * 7, 2), ([0.0] + [1.0] * 7, 2)]
    ids = rng.permutation(5000)[: len(rows)]
    return [(int(i), v, label) for i, (v, label) in zip(ids, rows, strict=True)]


@pytest.mark.parametrize("window", [8, 64])
def test_near_vectors(spark, window):
    rows = vector_rows()
    table = spark.createDataFrame([(*r, "k", "c") for r in rows], VECTORS).repartition(5)
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(table, window=window).collect()}
    assert found == plain_links(rows)


def test_near_vector_edges(spark):
    assert embedding_dedup.near_vectors(spark.createDataFrame([], VECTORS)).count() == 0
    rows = [(None, [1.0, 0.0], 1, "", ""), (3, [1.0, 0.0], 1, "", ""), (5, [2.0, 0.0], 1, "", "")]
    found = [tuple(r) for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, VECTORS)).collect()]
    assert sorted(found, key=str) == sorted([(None, 0, None, False), (3, 1, 3, True), (5, 1, 3, False)], key=str)


def spread_rows(n, size, background, seed, pairs=300):
    """One label of vectors at a common cosine of ``background``, with planted pairs just above the threshold."""
    rng = np.random.default_rng(seed)
    centre = np.zeros(size)
    centre[0] = 1.0
    side = rng.standard_normal((n, size))
    side[:, 0] = 0
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    base = np.sqrt(background) * centre + np.sqrt(1 - background) * side
    other = rng.standard_normal((pairs, size))
    other -= (other * base[:pairs]).sum(1, keepdims=True) * base[:pairs]
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    return np.concatenate([base, 0.931 * base[:pairs] + np.sqrt(1 - 0.931**2) * other])


@pytest.mark.parametrize("background", [0.0, 0.6, 0.85])
def test_recall_of_passes(spark, background):
    """Links of one large label, of vectors that are spread or that share a direction, against the comparison in full."""
    vectors = spread_rows(6000, 32, background, 4)
    table = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int")
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    plain = (unit @ unit.T >= 0.93).sum(axis=1) - 1
    whole = {r.vec_id: r.n_links for r in embedding_dedup.near_vectors(table, exact=True).collect()}
    assert whole == dict(enumerate(plain.tolist()))
    found = {r.vec_id: r.n_links for r in embedding_dedup.near_vectors(table).collect()}
    assert sum(found.values()) >= 0.99 * sum(whole.values()) and all(found[i] <= whole[i] for i in whole)


def test_plan_of_passes():
    bits, passes = embedding_dedup.plan_passes(50_000, 1.0)
    assert passes / 2**bits < 0.1  # of all pairs
    assert embedding_dedup.plan_passes(100, 1.0) == (0, 1) and embedding_dedup.plan_passes(10**6, 0.05) == (0, 1)
    assert embedding_dedup.plan_passes(1, 0.0) == (0, 1) and embedding_dedup.plan_passes(10**9, 1.0)[0] <= embedding_dedup.BITS


def test_crowded_windows(spark, monkeypatch):
    """Windows that hold more than a chunk are compared in full."""
    monkeypatch.setattr(embedding_dedup, "FULL_CHUNK", 20)
    monkeypatch.setattr(embedding_dedup, "FULL_ROWS", 7)
    rows = vector_rows(5)
    table = spark.createDataFrame([(*r, "k", "c") for r in rows], VECTORS).repartition(5)
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(table, window=16).collect()}
    assert found == plain_links(rows)


def test_pages_held_out():
    model = html_extract.default_model()
    wrong = blocks = 0
    for page in html_pages.labelled_pages(4, seed=99):
        read = html_extract.Reader().read(page)
        for text, main, odds in zip(read.text, read.main, model.odds(read), strict=True):
            if text is not None:
                blocks += 1
                wrong += (odds > 0) != bool(main)
    assert blocks > 500 and wrong / blocks < 0.01


def test_marginals_by_enumeration():
    """Messages give the marginals that all assignments of a small tree give."""
    page = html_extract.Page([-1, 0, 1, 1, 0], [["element", "f"], ["element"], ["leaf", "g"], ["leaf"], ["leaf", "g"]], [None, None, "a", "b", "c"], [None] * 5)
    model = html_extract.PageModel({"f": 0.3, "g": -0.8, "leaf": 0.4}, {"element": [[2.0, 0.5], [0.7, 3.0]], "leaf": [[1.5, 0.2], [0.1, 2.5]]})
    weight = np.zeros((2,) * 5)
    for state in np.ndindex(*weight.shape):
        value = np.exp(sum(s * sum(model.weights.get(f, 0.0) for f in found) for s, found in zip(state, page.features, strict=True)))
        for i in range(1, 5):
            value *= model.joint[page.features[i][0]][state[page.parent[i]]][state[i]]
        weight[state] = value
    for i, odds in enumerate(model.odds(page)):
        totals = weight.sum(axis=tuple(k for k in range(5) if k != i))
        assert odds == pytest.approx(np.log(totals[1] / totals[0]))


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/">Home</a></li><li><a href="/b">More</a></li></ul></nav><!-- c --><div class="ad">Buy these fine things now.</div>
<article><h1>A  title &amp; more</h1><p><b>First&nbsp;line of
text.<br><p>Second one, &eacute;t&#233; here.</p><p></p><p>Short.</p></article>
<section class="comments"><div class="comment"><p>I do not agree with this article at all.</p></div></section>
<form><p>Please write your name here.</p><input></form><footer>&copy; 2024 Someone. All rights.</footer>"""


def test_page_text(spark):
    rows = [(1, "u", PAGE, 1), (2, None, None, 1), (3, "v", "", 1), (4, "w", "<<<>&&& <p", 1), (5, "x", "<div>" * 3000 + "deep text", 1), (6, "u", PAGE, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    found = {r.page_id: r for r in html_extract.main_text(pages).collect()}
    expected = "A title & more\nFirst line of text.\nSecond one, été here.\nShort."
    assert found[1].text == found[6].text == expected and found[1].n_chars == len(expected)
    assert [found[i].text for i in (2, 3)] == ["", ""] and found[2].url is None
    assert set(found) == {1, 2, 3, 4, 5, 6}
    assert html_extract.main_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    if name in ORACLES:
        assert differences(df, SF_DIR, ORACLES[name]) == []
    else:
        assert df.count() >= spark.read.parquet(f"{SF_DIR}/{'pages' if name.startswith('op2_') else 'documents'}.parquet").count()


def test_pipeline(spark, tmp_path):
    rng = random.Random(8)
    long_text = " ".join("w%d" % rng.randint(0, 900) for _ in range(300))
    rows = [
        (1, long_text, "en", "s", 5), (2, long_text + " more", "en", "s", 5), (3, "12 34 !!", "en", "s", 8), (4, None, "en", "s", None),
        (5, "my token=abcdefabcdef012345 here", "en", "s", 33), (6, "", "de", "s", 0), (None, "a text without an id", "en", "s", 20), (8, "clean words", None, "s", 11),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "secrets", "packing"]
    step = docs
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        step = stage(spark, step, str(tmp_path))
        assert step.columns == docs.columns
        kept.append({r.doc_id: (r.text, r.n_chars) for r in step.collect()})
    assert set(kept[0]) == {1, 2, 5, 8, None} and set(kept[1]) == set(kept[2]) == {1, 5, 8, None}
    assert kept[2][5] == ("my [secret] here", 16) and kept[2][8] == ("clean words", 11)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == {1, 5, 8, None} and len({r.sequence_id for r in packed}) == 1
    assert sorted(r.offset for r in packed)[0] == 0 and sum(r.length for r in packed) == max(r.offset + r.length for r in packed)


def test_empty_pipeline(spark, tmp_path):
    spark.read.parquet(f"{SF_DIR}/documents.parquet").where(F.lit(False)).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_vectors_of_a_clustered_label(spark):
    """Pairs above the threshold are linked in a label whose vectors all have a cosine of about 0.85."""
    rng = np.random.default_rng(6)
    n, size = 4000, 64
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    base = unit(np.sqrt(0.85) * unit(rng.standard_normal(size)) + np.sqrt(0.15) * unit(rng.standard_normal((n, size))))
    side = rng.standard_normal((300, size))
    side = unit(side - (side * base[:300]).sum(1, keepdims=True) * base[:300])
    vectors = np.concatenate([base, 0.935 * base[:300] + np.sqrt(1 - 0.935**2) * side]).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist(), 1, "", "") for i, v in enumerate(vectors)], VECTORS).repartition(5)
    found = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(table).collect()}
    exact = unit(vectors.astype(float))
    near = exact @ exact.T >= 0.93
    np.fill_diagonal(near, False)
    assert near.sum() >= 600
    group = closure(list(zip(*np.nonzero(near), strict=True)), range(len(vectors)))
    assert found == {i: (int(near[i].sum()), group[i]) for i in range(len(vectors))}


def test_all_class_words_are_read():
    reader = html_extract.Reader()
    reader.feed(f'<div class="{" ".join(f"u{i}" for i in range(40))} advert">words</div>')
    assert any("name:advert" in found for found in reader.page.features)


def test_odd_markup_does_not_stop_a_page():
    """Declarations and sections of any kind are comments; random markup never raises."""
    page = "<body><article><p>one long paragraph of the article stands here and goes on.</p>{}<p>another paragraph of the article follows here.</p></article></body>"
    for odd in ("<![foo]>", "<![ 1>", "<![CDATA[x]]>", "<![if IE]>", "<!ELEMENT a>", "<!>", "<?php x ?>", "</ >", "<!DOCTYPE [", "&#xD800;", "&#99999999;"):
        model = html_extract.PageModel({}, {"element": [[1.0, 1.0], [1.0, 1.0]], "leaf": [[1.0, 1.0], [1.0, 1.0]]})
        assert isinstance(model.text(page.format(odd)), str)
    assert "another" in "".join(t or "" for t in html_extract.Reader().read(page.format("<![foo]>")).text)
    rng = random.Random(4)
    pieces = ["<!", "<![", "<!-", "-->", "]]>", "<", ">", "</", "<p", "div", " class=", '"', "'", "&", "&#", "x", "1", "[", "]", "<script>", "</script>", "<!doctype", "--", "?", "/", "text "]
    for _ in range(3000):
        html_extract.Reader().read("".join(rng.choices(pieces, k=rng.randint(1, 25))))


def test_pipeline_reduces_repeated_rows(spark, tmp_path):
    rows = [(i, f"some english words of the text number {i} that go on and on", "en") for i in range(20)]
    rows += [(3, rows[3][1], "en"), (3, rows[3][1], "en"), (4, "quite another text under an id that is there already", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    once = corpus_pipeline.near_dedup(spark, docs, str(tmp_path))
    assert once.columns == docs.columns
    found = sorted((r.doc_id, r.text) for r in once.collect())
    assert len(found) == len(set(found)) and {(3, rows[3][1]), (4, rows[22][1]), (4, rows[4][1])} <= set(found)
