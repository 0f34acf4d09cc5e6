"""Spelling variants, near-duplicate vectors and the Merkle manifest against brute force."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from boxyard.llm import manifest, queries, spelling, vectors

SF = "/root/testdata/sf0.001"


def distance_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_counts(rows, shortest, least, every):
    n = collections.Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= shortest:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= least}


def brute_forms(count, ratio=10):
    near = {w: [] for w in count}
    buckets = collections.defaultdict(set)
    for w in count:
        for v in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            buckets[v].add(w)
    for group in buckets.values():
        for a, b in itertools.combinations(group, 2):
            if distance_one(a, b) and b not in near[a]:
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-count[v], v), default=None)
        form[w] = best if best is not None and count[best] >= ratio * count[w] else None
    out = set()
    for w in count:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, count[w], len(near[w]), count.get(form[w])))
    return out


COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def spelled(df):
    return [tuple(r[c] for c in COLUMNS) for r in df.collect()]


@pytest.mark.parametrize("most", [64, 2])
def test_spelling_variants(spark, most):
    """Large buckets are cut down to single code points; words repeat letters at the cut, share halves, and hold letters of two bytes."""
    r = np.random.default_rng(5)
    words = {"".join(r.choice(list("aabé÷"), int(r.integers(7, 12)))) for _ in range(700)}
    words |= {f"common{x}half" for x in ("a", "b", "aa", "ab", "bb", "bbb", "aba")} | {"zzzzzzz", "zzzzzzzz", "zzzzzzzzz"} | {"q" * 3000, "q" * 2999, "q" * 1500 + "r" + "q" * 1499}
    words |= {"p" * i + x + "p" * (9 - i) for i in range(10) for x in "abcdefghij"}
    count = {w: int(10 ** r.uniform(0.5, 5)) for w in words}
    count |= {f"chain{'x' * i}{'o' * (6 - i)}": 10 ** (7 - i) for i in range(7)}  # seven forms in a row
    got = spelled(spelling.spelling_variants(spark.createDataFrame(list(count.items()), "word string, n long").repartition(7), most=most))
    assert len(got) == len(count) and set(got) == brute_forms(count)
    assert {root for word, _, root, *_ in got if word.startswith("chain")} == {"chainoooooo"}


def test_spelling_variants_of_texts(spark):
    rows = [(r.doc_id, r.text, "x", 1) for r in pd.read_parquet(f"{SF}/documents.parquet").itertuples()]
    rows += [(None, "Leading leading LEADING", "y", None), (900, None, None, None), (901, "", "x", 1), (902, " 12 -- ", "x", 1), (903, "écoutez Écoutez ÉCOUTEZ écoutez", "x", 1), (904, "over" * 300, "x", 1), (904, "over" * 300, "x", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, word string, n int").repartition(3)
    plain = [(a, b) for a, b, *_ in rows]
    for every in (31, None):
        counts = spelling.word_counts(d, every=every)
        want = brute_counts(plain, 7, 2, every)
        assert {(x["word"], x["n"]) for x in counts.collect()} == set(want.items())
        assert set(spelled(spelling.spelling_variants(counts))) == brute_forms(want)
    by_text = d.select(F.concat(F.lit("id"), "doc_id").alias("doc_id"), "text")
    assert {(x["word"], x["n"]) for x in spelling.word_counts(by_text, every=31).collect()} == set(brute_counts([(None if a is None else f"id{a}", b) for a, b in plain], 7, 2, 31).items())
    assert spelling.spelling_variants(spelling.word_counts(d.where("1 = 0"))).count() == 0
    got = spelled(queries.op11_spelling_variants(spark, SF))
    assert set(got) == brute_forms(brute_counts(plain[: len(rows) - 7], 7, 2, 31)) and len(set(got)) == len(got)


def test_spelling_variants_of_very_long_words(spark):
    long = "over" * 50_000
    words = [(long, 50), (long[:-1], 5), ("r" + long[1:], 4), (long[:100_000] + long[100_001:], 1), (long + "xy", 3)]
    got = {(x["word"], x["form"], x["n_near"]) for x in spelling.spelling_variants(spark.createDataFrame(words, "word string, n long")).collect()}
    assert got == {(long, None, 3), (words[1][0], long, 1), (words[2][0], long, 1), (words[3][0], long, 1), (words[4][0], None, 0)}


def brute_vectors(rows, least):
    def usable(v):
        return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n, up = [0] * len(rows), list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        (_, a, la), (_, b, lb) = rows[i], rows[j]
        if la is not None and la == lb and usable(a) and usable(b) and len(a) == len(b):
            x, y = np.array(a, float), np.array(b, float)
            x, y = x / np.abs(x).max(), y / np.abs(y).max()
            if x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= least:
                n[i] += 1
                n[j] += 1
                up[root(i)] = root(j)
    out = []
    for i, (key, _, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        least_id = min(ids) if ids else None
        out.append((key, n[i], least_id, key == least_id))
    return sorted(out, key=str)


@pytest.mark.parametrize("most, width", [(2000, 8), (4, 8), (4, 3), (1, 16)])
def test_near_vectors(spark, most, width):
    """Families around the threshold, copies, scaled and repeated rows, odd vectors and other lengths; cells, visitors and parts of cells."""
    r = np.random.default_rng(1)
    rows = []
    for family in range(12):
        center = r.standard_normal(20)
        for _ in range(int(r.integers(1, 14))):
            v = center + r.standard_normal(20) * r.choice([0.02, 0.09, 0.14])
            rows.append(([float(x) for x in v.astype(np.float32)], family % 3))
    rows += [(rows[0][0], rows[0][1])] * 3 + [([2 * x for x in rows[1][0]], rows[1][1]), ([0.0] * 20, 1), (None, 1), ([], 1), ([1.0] * 19 + [None], 1), ([1.0] * 19 + [float("nan")], 1), ([1.0] * 19 + [float("inf")], 1), (rows[0][0], None), ([1.0, 0.0], 1), ([1.0, 0.1], 1), ([-1.0, 0.0], 1), ([1e30, 1e30], 1), ([1e-30, 1.01e-30], 1)]
    rows = [(i, *x) for i, x in enumerate(rows)]
    rows += [(None, rows[2][1], rows[2][2]), (None, None, 1), rows[5], rows[5]]
    d = spark.createDataFrame([(*x, 1, 2) for x in rows], "vec_id long, embedding array<float>, label int, rid int, n int").repartition(4)
    got = vectors.near_vectors(d, most=most, width=width)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted([tuple(x) for x in got.collect()], key=str) == brute_vectors(rows, 0.98)
    assert vectors.near_vectors(d.where("1 = 0")).count() == 0


def test_no_near_vectors_miss_each_other(spark):
    """Text ids, double components, another threshold: links at random angles, of which some are just above and some just below it."""
    r = np.random.default_rng(2)
    rows = []
    for i in range(150):
        a = r.standard_normal(32)
        a /= np.linalg.norm(a)
        b = r.standard_normal(32)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        cos = 0.95 + r.choice([-1, 1]) * 10.0 ** -int(r.integers(2, 9))
        rows += [(f"a{i}", a.tolist(), "x"), (f"b{i}", (cos * a + math.sqrt(1 - cos * cos) * b).tolist(), "x")]
    d = spark.createDataFrame(rows, "vec_id string, embedding array<double>, label string")
    got = vectors.near_vectors(d, least=0.95, most=10)
    assert sorted([tuple(x) for x in got.collect()], key=str) == brute_vectors(rows, 0.95)


def test_cells_are_visited():
    """Of two points within reach, one visits the other's own cell, and only one."""
    r = np.random.default_rng(3)
    x = r.standard_normal((400, 4)) / 4
    x[200:] = x[:200] + r.standard_normal((200, 4)) / 40
    reach = 0.01
    for total in (10, 1000, 200_000):
        row, cell, own = vectors.visits(x, total, 10, 16, reach)
        mine = dict(zip(row[own].tolist(), cell[own].tolist(), strict=True))
        assert len(mine) == 400
        seen = set(zip(row.tolist(), cell.tolist(), strict=True))
        assert len(seen) == len(row)
        for i, j in itertools.combinations(range(400), 2):
            if ((x[i] - x[j]) ** 2).sum() <= reach:
                meets = [(i, mine[j]) in seen, (j, mine[i]) in seen]
                assert meets == [True, True] if mine[i] == mine[j] else sum(meets) == 1


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""

    def leaf(row):
        return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[1], row[2], row[3], row[4])))

    def up(level):
        return [h("".join(level[i : i + 8])) for i in range(0, len(level), 8)]

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append(up(out[-1]))
        return out

    def climb(tree, place, node):
        proof = ""
        for level in tree[:-1]:
            run = place // 8 * 8
            mine = level[run : run + 8]
            proof += "".join(x for i, x in enumerate(mine) if i != place - run)
            node = h("".join([*mine[: place - run], node, *mine[place - run + 1 :]]))
            place //= 8
        return proof, node

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: sorted([(r[0] is not None, r[0], leaf(r), r) for r in rows if r[2] == x], key=lambda t: (t[0], t[1] or 0, t[2])) for x in langs}
    folded = {x: levels([t[2] for t in trees[x]]) for x in langs}
    top = levels([folded[x][-1][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for place, (_, key, own, row) in enumerate(trees[x]):
            start = own
            if key is not None and zlib.crc32(str(key).encode()) % 3 == 0:
                text = row[4]
                start = leaf((*row[:4], None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)))
            low, node = climb(folded[x], place, start)
            high, node = climb(top, k, node)
            out.append((key, own, folded[x][-1][0], top[-1][0], h(low + high), node, node == top[-1][0]))
    return sorted(out, key=str)


MANIFEST = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("many", [(1300, 9, 70, 1), (1,), (8,), (513, 512)])
def test_manifest(spark, many):
    """Languages of one leaf, of full blocks and of several; nulls everywhere, an id with several texts, repeated rows, long texts."""
    rows = []
    for lang, n in zip(("en", "é", None, "zz"), many, strict=False):
        rows += [(len(rows) + i, "s" if i % 5 else None, lang, i if i % 7 else None, f"Text {i} É" if i % 11 else None) for i in range(n)]
    if len(many) > 2:
        rows += [(None, "s", "en", 1, "No id"), (None, "s", "en", 1, "No id"), (0, "s", "en", 3, "Another Text"), (0, "s", "en", 3, "Another Text"), (7, "s", "en", 0, ""), (9, "s", None, 400_000, "Long " * 80_000)]
        rows += [(5000 + i, "s", f"l{i:02}", 1, "x") for i in range(75)]
    d = spark.createDataFrame([(*r, "other") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string").repartition(6)
    got = manifest.merkle_manifest(d)
    assert sorted([tuple(x) for x in got.select(*MANIFEST).collect()], key=str) == brute_manifest(rows)
    assert not got.where("verified and n_copied > 0 and folded_root <> root").count()
    assert not got.where("n_copied <> size(copied) or (n_copied > 0 and element_at(copied, -1) <> folded_root)").count()


def test_manifest_of_nothing_and_of_text_ids(spark):
    d = spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")
    got = manifest.merkle_manifest(d)
    assert got.count() == 0 and got.columns[:7] == MANIFEST
    rows = [(f"k{i:03}", "s", "en", 1, f"T{i}") for i in range(20)]
    got = manifest.merkle_manifest(spark.createDataFrame(rows, "doc_id string, source string, lang string, n_chars long, text string"))
    assert sorted([tuple(x) for x in got.select(*MANIFEST).collect()], key=str) == brute_manifest(rows)


def test_versions_share_untouched_nodes():
    nodes = [h(str(i)) for i in range(100)]
    tree = manifest.BlockTree(nodes, 3)
    assert [len(x) for x in tree.levels] == [100, 13, 2, 1]
    for place in (0, 7, 8, 63, 64, 99):
        changed = [*nodes[:place], h("tampered"), *nodes[place + 1 :]]
        other = manifest.BlockTree(changed, 3)
        path = manifest.copied_path(h("tampered"), tree.siblings(place))
        assert path == [other.levels[k][place // 8**k] for k in (1, 2, 3)]
        differ = sum(a != b for x, y in zip(tree.levels, other.levels, strict=True) for a, b in zip(x, y, strict=True))
        assert differ == 4  # the leaf and its three ancestors


@pytest.mark.parametrize("name", ["op12_subspace_join", "op13_merkle_manifest"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = c.sql(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, SF).toPandas()[list(want.columns)]
    assert sorted(map(str, got.itertuples(index=False, name=None))) == sorted(map(str, want.itertuples(index=False, name=None)))
