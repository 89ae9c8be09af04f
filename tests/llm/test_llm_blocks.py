"""Benchmark passages, Merkle manifest and vector codes against plain Python."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.llm import decontaminate, merkle, vector_codes

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rank long, n long, hash string, steps string, __t string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t), 1, 2, "h", "x", "y") for i, t, lang in rows], DOCS)


def lowered(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def plain_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered(text))


def plain_contamination(rows, items):
    found = {}
    for doc, text in rows:
        words, hit, named = plain_words(text), set(), set()
        for item, passage in items:
            own = plain_words(passage)
            size = min(10, len(own))
            windows = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()
            for i in range(len(words) - size + 1):
                if tuple(words[i : i + size]) in windows:
                    hit |= set(range(i, i + size))
                    named.add(item)
        named = sorted(str(i) for i in named if i is not None)
        found[doc] = (len(words), len(hit), len(named), hashlib.sha256(",".join(named).encode()).hexdigest(), bool(hit))
    return found


def benchmark_rows(rng):
    vocabulary = ["w%d" % k for k in range(30)] + ["É", "naïve", "日本", "x"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 9, 10, 11, 25])))) for i in range(20)]
    return [*items, (20, None), (21, ""), (22, "-- !!"), (None, items[3][1]), (5, items[5][1]), (5, "another text of the same item"), (23, items[4][1])], vocabulary


@pytest.mark.parametrize("part_bytes", [100, 10**6])
def test_contamination(spark, part_bytes):
    rng = random.Random(7)
    items, vocabulary = benchmark_rows(rng)
    rows = [(None, "w1 w2"), (0, None), (1, ""), (2, " .,; "), (3, " ".join(rng.choices(vocabulary, k=30_000)))]
    for k in range(4, 120):
        words = rng.choices(vocabulary, k=rng.randint(0, 30))
        for _ in range(rng.randint(0, 2)):
            words += plain_words(rng.choice(items)[1] or "")
        text = "".join(w.upper() + rng.choice([" ", "\n", "--", ". ", " x "]) for w in words)
        rows.append((k, text))
    docs = documents(spark, [(i, t, "en") for i, t in rows]).repartition(4)
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("__found", F.lit(1))
    found = decontaminate.contaminated(docs, benchmark, part_bytes=part_bytes).collect()
    plain = plain_contamination(rows, items)
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found} == plain
    texts = dict(rows)
    for r in found:  # the spans hold the hit words of the original text
        pieces = [tuple(map(int, s.split(":"))) for s in r.spans.split(",")] if r.spans else []
        assert sum(len(plain_words(texts[r.doc_id][a:b])) for a, b in pieces) == r.n_hit
        assert all(len(plain_words(x)) == 1 for a, b in pieces for x in (texts[r.doc_id][a], texts[r.doc_id][b - 1]))


def test_contamination_without_rows(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = documents(spark, [(1, "a b", "en"), (1, "a b", "en")])
    assert [tuple(r)[1:4] for r in decontaminate.contaminated(docs, none).collect()] == [(2, 0, 0)] * 2
    assert decontaminate.contaminated(documents(spark, []), none).count() == 0


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows):
    """Rows of the manifest from lists of nodes, level by level."""

    def leaf(row, lower=False):
        i, text, lang = row
        text = lowered(text) if lower and text is not None else text
        values = [i, "s", lang, None if row[1] is None else len(row[1]), text]
        return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])

    def rise(nodes):
        """Top of a list of nodes, and the (left, right) siblings on each one's way up."""
        ways, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for way, k in zip(ways, at, strict=True):
                first = k - k % 8
                way.append(("".join(nodes[first:k]), "".join(nodes[k + 1 : first + 8])))
            nodes = [sha(*nodes[k : k + 8]) for k in range(0, len(nodes), 8)]
            at = [k // 8 for k in at]
        return nodes[0], ways

    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    tops = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        tops[g] = rise([leaf(r) for r in groups[g]])
    if not order:
        return []
    root, upper = rise([tops[g][0] for g in order])
    out = []
    for g, above in zip(order, upper, strict=True):
        for row, way in zip(groups[g], tops[g][1], strict=True):
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0
            fold = leaf(row, hit)
            for a, b in way + above:
                fold = sha(a, fold, b)
            out.append((row[0], leaf(row), tops[g][0], root, sha(*[a + b for a, b in way + above]), fold, fold == root))
    return out


def language_rows(n, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["Some Text %d" % i, "lower %d" % i, None, "", "Ünï ÄB"]), rng.choice(["en"] * 6 + ["de", "fr", None, "", "é", "z"])) for i in rng.sample(range(10**6), n)]
    return [*rows, (1, "the only one", "alone"), (None, "No Key", "en"), (7, "Twice", "de"), (7, "Twice", "de"), (7, "other", "de"), (8, "Long " * 50_000, "fr")]


@pytest.mark.parametrize(("digits", "n"), [(1, 700), (2, 700), (4, 90), (4, 6000)])
def test_manifest(spark, monkeypatch, digits, n):
    monkeypatch.setattr(merkle, "DIGITS", digits)  # small blocks make several levels of them
    rows = language_rows(n, digits)
    found = [tuple(r) for r in merkle.manifest(documents(spark, rows).repartition(5)).collect()]
    assert sorted(found, key=str) == sorted(plain_manifest(rows), key=str)


@pytest.mark.parametrize("rows", [[], [(4, "One", None)], [(4, "One", None), (9, None, "en")], [(i, "t", "en") for i in range(9)]])
def test_small_manifests(spark, rows):
    found = [tuple(r) for r in merkle.manifest(documents(spark, rows)).collect()]
    assert sorted(found, key=str) == sorted(plain_manifest(rows), key=str)


VECTORS = "vec_id long, embedding array<double>, label int, code string, error long, vector string, distance string"


def plain_codes(rows):
    kept = []
    for i, v, label in rows:
        if v and all(x is not None and np.isfinite(x) for x in v):
            kept.append((i, [max(-(2**24), min(2**24, int(np.floor(x * 1024)))) for x in v], label))
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    if not kept or len(kept[0][1]) % 4:
        return []
    width = len(kept[0][1]) // 4
    parts = [[r[1][p * width : (p + 1) * width] for r in kept] for p in range(4)]
    books = [[list(x) for x in part[:256]] for part in parts]

    def assign(part, book):
        return [min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book)) for x in part]

    for _ in range(4):
        for part, book in zip(parts, books, strict=True):
            members = {}
            for x, (_, e) in zip(part, assign(part, book), strict=True):
                members.setdefault(e, []).append(x)
            for e, own in members.items():
                book[e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    last = [assign(part, book) for part, book in zip(parts, books, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    errors = [sum(last[p][k][0] for p in range(4)) for k in range(len(kept))]
    total = {}
    for (_, _, label), error in zip(kept, errors, strict=True):
        total[label] = total.get(label, 0) + error
    return [(i, "".join("%02x" % last[p][k][1] for p in range(4)), errors[k], total[label], digest) for k, (i, _, label) in enumerate(kept)]


def code_rows(n, size, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, size)) * spread
    rows = [(int(i), (centres[i % 12] + 0.2 * rng.standard_normal(size)).tolist(), [None, 1, 2, 2, 2][i % 5]) for i in rng.permutation(n)]
    rows += [(n + k, [1.0] * size, 1) for k in range(9)]  # copies: ties between entries
    return rows + [(n + 20, None, 1), (n + 21, [None] + [0.0] * (size - 1), 1), (n + 22, [float("nan")] * size, 1), (n + 23, [float("inf")] * size, 2), (n + 24, [1.0] * (size + 1), 2), (n + 25, [], 2), (None, [0.5] * size, 7), (3, [0.25] * size, 7)]


@pytest.mark.parametrize(("n", "size", "spread"), [(600, 8, 1.0), (40, 4, 1.0), (400, 16, 1e5)])
def test_codes(spark, n, size, spread):
    rows = code_rows(n, size, n, spread)
    table = spark.createDataFrame([(*r, "c", 1, "v", "d") for r in rows], VECTORS).repartition(6)
    found = [tuple(r) for r in vector_codes.vector_codes(table).collect()]
    assert sorted(found, key=str) == sorted(plain_codes(rows), key=str)


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(1, [1.0, 2.0, 3.0], 1)], [(1, [0.0] * 4, None), (1, [0.0] * 4, None)]])
def test_code_edges(spark, rows):
    table = spark.createDataFrame([(*r, "c", 1, "v", "d") for r in rows], VECTORS)
    found = [tuple(r) for r in vector_codes.vector_codes(table).collect()]
    assert sorted(found, key=str) == sorted(plain_codes(rows), key=str)


def test_moved_entries_give_what_a_full_comparison_gives():
    rng = np.random.default_rng(3)
    x, before = rng.integers(-6, 6, (500, 3)), rng.integers(-6, 6, (40, 3))
    none = np.full(500, -1), np.zeros(500, np.int64)
    code, distance = vector_codes.nearest(x, before, np.arange(40), *none)
    after = before.copy()
    moved = np.array([2, 3, 11, 39])
    after[moved] = rng.integers(-6, 6, (4, 3))
    found = vector_codes.nearest(x, after, moved, code, distance)
    whole = vector_codes.nearest(x, after, np.arange(40), *none)
    assert (found[0] == whole[0]).all() and (found[1] == whole[1]).all()
    assert (vector_codes.squares(x * 2**23, after * 2**23) == vector_codes.squares(x, after) * 2**46).all()
