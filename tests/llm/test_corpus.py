"""The corpus operators against brute force, on the smallest documents and on rows made to be awkward."""

import base64
import collections
import hashlib
import itertools
import re
import time
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from boxyard.llm import batches, decontaminate, neardup, packing, passages, perspective, quality, queries, runs, secrets, substrings, suffix, surrogates, toxicity

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
SCHEMA = "doc_id long, text string, row string, _t int, h double"


@pytest.fixture(scope="module")
def docs(spark):
    """200 documents; nulls in every column, empty, blank and very long texts, repeated rows, one id with two texts, clashing names."""
    base = [(r.doc_id, r.text, "x", 1, 0.5) for r in pd.read_parquet(f"{SF}/documents.parquet").itertuples()]
    odd = [
        (1001, None, None, None, None), (1002, "", "x", 1, 0.5), (1003, " \n\t ", "x", 1, 0.5), (1004, LONG, "x", 1, 0.5), (1005, LONG[50:] + " end", "x", 1, 0.5), (1006, "one", "x", 1, 0.5), (1007, "One", "x", 1, 0.5),
        (1008, "ab " * 400, "x", 1, 0.5), (1009, base[5][1], "x", 1, 0.5), (1010, "z" * 199 + "é", "x", 1, 0.5), (1010, "z" * 199 + "é", "x", 1, 0.5), (1011, "é" * 150 + "日本" * 80, "x", 1, 0.5), (1011, "another text with this id", "x", 1, 0.5),
    ]
    return spark.createDataFrame(base + odd, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def local(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def words(text):
    return (text or "").encode().split()


def cover(hits, window, n):
    step = np.zeros(n + window + 1, int)
    for i in hits:
        step[i] += 1
        step[i + window] -= 1
    return np.cumsum(step)[:n] > 0


def test_window_minimum():
    r = np.random.default_rng(0)
    for _ in range(100):
        n, w = int(r.integers(1, 60)), int(r.integers(1, 20))
        x = r.integers(0, 6, n).astype(np.uint64) << np.uint64(40)
        assert list(batches.window_min(x, w)) == [i + int(np.argmin(x[i : i + w])) for i in range(n - w + 1)]


def test_runs_cut_long_texts_alike(monkeypatch):
    v = batches.mix(np.arange(500, dtype=np.uint64) % np.uint64(97))
    whole = runs.runs_of(v, np.array([0, 300, 500]), 35, 18)
    monkeypatch.setattr(runs, "PIECE", 64)
    pieces = runs.runs_of(v, np.array([0, 300, 500]), 35, 18)
    for a in (whole, pieces):
        got = {(t, s + i): h for t, s, n, h in zip(a[0], a[1], a[2], a[3], strict=True) for i in range(n)}
        assert len(got) == 300 - 34 + 200 - 34
    assert {(t, s + i): h for t, s, n, h in zip(*whole[:4], strict=True) for i in range(n)} == {(t, s + i): h for t, s, n, h in zip(*pieces[:4], strict=True) for i in range(n)}


@pytest.mark.parametrize("many", [2, 3000])
def test_suffix_arrays(monkeypatch, many):
    monkeypatch.setattr(suffix, "FEW_SYMBOLS", many)
    r = np.random.default_rng(many)
    for _ in range(150):
        d = r.integers(0, int(r.integers(1, 5)), int(r.integers(1, 90))).astype(np.uint8)
        text = d.tobytes()
        assert list(suffix.suffix_array(d)) == sorted(range(len(d)), key=lambda i: text[i:])
        w = int(r.integers(1, 12))
        seen = collections.Counter(text[i : i + w] for i in range(len(d) - w + 1))
        assert list(suffix.repeated(d, w)) == [i + w <= len(d) and seen[text[i : i + w]] > 1 for i in range(len(d))]


def test_suffix_array_of_a_real_text():
    """A text with many more names than symbols of a small alphabet, and one of long runs."""
    t = b"".join(x.encode() for x in pd.read_parquet(f"{SF}/documents.parquet").text[:60])[:120_000]
    for text in (t, b"ab" * 3000 + b"a" * 3000, t[:5000] * 3):
        sa = suffix.suffix_array(np.frombuffer(text, np.uint8)).tolist()
        assert sorted(sa) == list(range(len(text)))
        assert all(text[i:] < text[j:] for i, j in itertools.pairwise(sa))


@pytest.mark.parametrize("shard_bytes", [3_000_000, 8_000])
def test_repeated_bytes(docs, empty, shard_bytes):
    rows = [(i, (t or "").encode()) for i, t in local(docs)]
    seen = collections.Counter(t[i : i + 200] for _, t in rows for i in range(len(t) - 199))
    want = []
    for doc_id, t in rows:
        mask = cover([i for i in range(len(t) - 199) if seen[t[i : i + 200]] > 1], 200, len(t))
        spans = int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum())
        want.append((doc_id, len(t), int(mask.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~mask].tobytes()).hexdigest()))
    got = [tuple(r) for r in substrings.remove_repeats(docs, shard_bytes=shard_bytes).drop("kept").collect()]
    assert sorted(got) == sorted(want)
    assert substrings.remove_repeats(empty).count() == 0


def test_periodic_texts_are_few_runs(spark):
    """Padding of 20 MB is a few runs, and every byte or word of it goes."""
    for text in (b"a" * 300_000, b"ab" * 150_000, b"\n" * 300_000, b"<td></td>" * 30_000):
        v, b = runs.byte_symbols(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        _, at, n, _, _, times = runs.folded(*runs.runs_of(v, b, 200, 32))
        assert len(at) <= 4 and int((n * times).sum()) == len(text) - 199
    e = np.zeros(0, np.int64)
    assert all(not len(x) for x in runs.folded(e, e, e, e, e))
    d = spark.createDataFrame([(1, "x" * 20_000_000), (2, "start " + "ab" * 400 + " end"), (3, "the same " * 2_000_000), (4, "a b " * 30 + "tail")], "doc_id long, text string")
    start = time.time()
    got = {r["doc_id"]: r for r in substrings.remove_repeats(d).drop("kept").collect()}
    assert got[1]["n_removed"] == 20_000_000 and got[2]["n_removed"] == 800 and got[2]["n_spans"] == 1 and got[3]["n_removed"] == 18_000_000 and got[4]["n_removed"] == 0
    words_ = {r["doc_id"]: r["n_removed"] for r in passages.remove_repeats(d).collect()}
    assert words_ == {1: 0, 2: 0, 3: 4_000_000, 4: 60}
    assert time.time() - start < 120


def test_text_ids(spark, docs):
    """Ids of any type give the rows that whole numbers give."""
    few = docs.select("doc_id", "text").where("doc_id > 1000 or doc_id < 60").distinct()
    named = few.withColumn("doc_id", F.concat(F.lit("doc-"), "doc_id"))
    for op in (lambda d: substrings.remove_repeats(d).drop("kept"), lambda d: passages.remove_repeats(d).drop("kept"), lambda d: surrogates.replace_pii(d, b"key")):
        want = sorted(("doc-" + str(r[0]), *r[1:]) for r in op(few).collect())
        assert sorted(tuple(r) for r in op(named).collect()) == want
    groups = []
    for d in (few, named):
        rows = neardup.near_duplicates(d, shingle=2).collect()
        by = collections.defaultdict(set)
        for r in rows:
            by[r["component_id"]].add(str(r["doc_id"]).removeprefix("doc-"))
            assert r["kept"] == (r["doc_id"] == r["component_id"])
        groups.append(sorted(map(sorted, by.values())))
    assert groups[0] == groups[1]


@pytest.mark.parametrize("bits", [28, 6])
def test_repeated_passages(docs, empty, bits):
    rows = [(i, words(t)) for i, t in local(docs)]
    seen = collections.Counter(tuple(t[i : i + 35]) for _, t in rows for i in range(len(t) - 34))
    want = []
    for doc_id, t in rows:
        mask = cover([i for i in range(len(t) - 34) if seen[tuple(t[i : i + 35])] > 1], 35, len(t))
        want.append((doc_id, len(t), int(mask.sum()), hashlib.sha256(b" ".join(w for w, m in zip(t, mask, strict=True) if not m)).hexdigest()))
    got = [tuple(r) for r in passages.remove_repeats(docs, bits=bits).drop("kept").collect()]
    assert sorted(got) == sorted(want)
    assert passages.remove_repeats(empty).count() == 0


def test_quality_counts(spark, docs, empty):
    trusted = docs.where("doc_id % 2 = 0").select("doc_id")
    got = collections.defaultdict(list)
    for r in quality.quality_rules(docs, trusted, buckets=256).collect():
        got[r["doc_id"]].append((r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]))
        assert r["kept"] == (not r["base_failed"] and r["llr"] >= -0.07)
    want = collections.defaultdict(list)
    for i, t in local(docs):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        n = collections.Counter(tri)
        rep = int(cover([k for k, x in enumerate(tri) if n[x] > 1], 3, len(w)).sum())
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want[i].append((len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), rep, len(w) < 50 or 100 * rep > 50 * len(w)))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert quality.quality_rules(empty, trusted).count() == 0


def test_quality_ratio(spark):
    d = spark.createDataFrame([(1, "a b"), (2, "a c"), (3, None)], "doc_id long, text string")
    w = quality.ngram_weights(d, spark.createDataFrame([(1,), (None,), (1,)], "doc_id long"), 64).first()["weights"]
    raw, target = collections.Counter(), collections.Counter()
    for r in d.select("doc_id", quality.ngram_buckets(F.transform(quality.words(F.col("text")), lambda x: F.xxhash64(x)), 64).alias("g")).collect():
        raw.update(r["g"])
        if r["doc_id"] == 1:
            target.update(r["g"])
    assert np.allclose(w, [np.log((target[b] + 1) / (3 + 64)) - np.log((raw[b] + 1) / (6 + 64)) for b in range(64)])


def test_secrets(spark, docs, empty):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    body = "a1B2" * 7 + "zz"
    good, bad = f"ghp_{body}{secrets.token_checksum(body.encode()).decode()}", f"ghp_{body}000000"
    more = [
        (2000, f"é token = 'short' and API_KEY: \"{'x' * 12}\" ſecret=aaaaaaaaaaaaaaaa AKIA12345678901234 AKIAshort {'0a' * 8} {good} {bad}"), (2001, "passwordpassword=aaaaaaaaaaaaaaaa"), (2002, "AKIAAKIA" + "Z" * 20), (2003, "f" * 15 + "G" + "f" * 16),
    ]
    d = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    want = []
    for i, t in local(d):
        t = t or ""
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 12]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        base = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
        want.append((i, *(sum(k == j for _, k, _ in spans) for j in range(3)), hashlib.sha256(base.encode()).hexdigest()))
    rows = secrets.find_secrets(d, with_text=True).collect()
    assert sorted(tuple(r)[:5] for r in rows) == sorted(want)
    r = next(x for x in rows if x["doc_id"] == 2000)
    assert r["spans"].count("github") == 1 and good not in r["redacted"] and bad in r["redacted"] and r["redacted"].startswith("é token = 'short'")
    assert secrets.find_secrets(empty).count() == 0
    kept = secrets.redact_secrets(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_secrets_in_hostile_texts():
    """Texts of one repeated beginning take time in proportion to their length."""
    begin = b"-----BEGIN PRIVATE KEY-----"
    hostile = [begin + b" " * 300_000, begin * 20_000, (begin + b"\n" * 20) * 10_000, b"eyJ" * 200_000, b"eyJa." * 100_000, b"token " * 100_000, b"token" + b" " * 300_000, b"AKIA" * 100_000, b"A " * 200_000]
    for text in hostile:
        started = time.process_time()
        secrets.scan(text)
        assert time.process_time() - started < 5
    body = base64.b64encode(bytes(range(64)))
    key = b"-----BEGIN RSA PRIVATE KEY-----\n" + body + b"\n-----END RSA PRIVATE KEY-----"
    assert [k for _, k, _ in secrets.scan(b"x " + key + b" y")] == [6]
    assert not [k for _, k, _ in secrets.scan(key.replace(b"END RSA", b"END EC"))]


def test_surrogates(spark, docs, empty):
    more = [(3000, "Mr. Peter Smith met Mrs Anna Smith. Mr. Smith: a.b@corp.example.com, A.B@corp.example.com, +1 (017) 555-7713, +1 017 555 7713, 4111111111111111, 10.20.30.40"), (3001, "Dr. Иван Петров 10.20.30.40 and 10.20.30.41")]
    d = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    out = {(r["doc_id"], len(r["text"] or "")): r for r in surrogates.replace_pii(d, b"key").collect()}
    r = next(v for k, v in out.items() if k[0] == 3000)
    assert (r["n_email"], r["n_phone"], r["n_ip"], r["n_card"], r["n_name"]) == (2, 2, 1, 1, 5)
    t = r["text"]
    names = re.match(r"Mr. (\w+) (\w+) met Mrs (\w+) (\w+)\. Mr\. (\w+):", t)
    assert names and names[2] == names[4] == names[5] and names[1] in surrogates.GIVEN["latin", "m"] and names[3] in surrogates.GIVEN["latin", "f"]
    mails = re.findall(r"\S+@[\w.]+", t)
    assert mails[0].lower() == mails[1].lower() and "corp" not in t and not any(x in t for x in ("555-7713", "4111111111111111", "10.20.30.40", "Smith", "Peter"))
    card = re.search(r"\d{16}", t)[0]
    assert surrogates._luhn(card) == 0
    other = next(v for k, v in out.items() if k[0] == 3001)["text"]
    ips = re.findall(r"\d+\.\d+\.\d+\.\d+", other)
    assert ips[0] == re.search(r"\d+\.\d+\.\d+\.\d+", t)[0] and ips[0] != ips[1] and re.search("[а-я]", other)
    plain = [(i, x) for i, x in local(docs) if not surrogates.find((x or "").encode())]
    got = collections.Counter((r["doc_id"], r["text"]) for r in out.values())
    assert all(got[p] for p in plain)
    assert surrogates.replace_pii(empty, b"key").count() == 0


def test_surrogates_never_collide(spark):
    """One-digit addresses are so few that first draws collide."""
    e = spark.createDataFrame([("ip", ".".join(map(str, x))) for x in itertools.product(range(1, 6), repeat=4)], "kind string, norm string")
    a = surrogates.assign(e, b"k").collect()
    assert len(a) == len({r["sur"] for r in a}) == 625 and not {r["sur"] for r in a} & {r["norm"] for r in a}


def brute_surrogates(texts, key):
    """Rounds of draws over all entities in one dictionary; the least (norm, kind) keeps what several draw."""
    spans = [[(lo, hi, k, t[lo:hi].decode(), surrogates.normal(k, t[lo:hi].decode())) for lo, hi, k in surrogates.parts(t)] for t in texts]
    todo = {(k, n) for one in spans for _, _, k, _, n in one}
    taken, given, attempt = {(k.split("_")[0], n) for k, n in todo}, {}, 0
    while todo:
        best = {}
        for k, n in todo:
            c = (k.split("_")[0], surrogates.surrogate(key, k, n, attempt))
            if c not in taken:
                best[c] = min(best.get(c, (n, k)), (n, k))
        for c, (n, k) in best.items():
            given[k, n] = c[1]
            taken.add(c)
        todo -= set(given)
        attempt += 1
    out = []
    for t, one in zip(texts, spans, strict=True):
        b, done = [], 0
        for lo, hi, k, v, n in one:
            b += [t[done:lo], surrogates.laid_out(k, v, given[k, n]).encode()]
            done = hi
        out.append(b"".join(b) + t[done:])
    return out


PEOPLE = [
    "Herr Jörg Müller <jörg.müller@bücher.example.org>, +49 89 1234 5678, DE89 3704 0044 0532 0130 00 AN",
    "Maria Lopez wrote to Dr. Maria Curie and Mr Victor Hugo de Paris; 2001:db8::ff00:42:8329 = 2001:0DB8:0:0:0:FF00:42:8329",
    "+442079460958 is +44 (20) 7946-0958; x@ab.com y@ba.com " + "l" * 300 + "@mail.example.com @ a@b @@ x@y.z1 12:30:45 std::dec::ade 4 + 5 6 7 8 9 10 11",
    "Г-н Иван Петров, Γιάννης Παπαδόπουλος, Maria " * 3 + "12345678 GB00 NWBK 6016 1331 9268 19",
    "Mr " + "Orre " * 3000, "我们" * 500 + "a.b@c.io", "",
]


def test_surrogates_by_brute_force(spark, docs):
    rows = sorted({(i, x or "") for i, x in local(docs)} | {(5000 + i, x) for i, x in enumerate(PEOPLE)})
    want = dict(zip(rows, brute_surrogates([x.encode() for _, x in rows], b"key"), strict=True))
    clash = "doc_id long, text string, found string, kind int, norm double, n_email string"
    d = spark.createDataFrame([(i, x, "x", 1, 0.5, "y") for i, x in rows], clash)
    got = surrogates.replace_pii(d, b"key").collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == sorted((i, x.decode()) for (i, _), x in want.items())
    new = {r["doc_id"]: r for r in got if r["doc_id"] >= 5000}
    assert [(r["n_email"], r["n_phone"], r["n_ip"], r["n_iban"]) for _, r in sorted(new.items())][:4] == [(1, 1, 0, 1), (0, 0, 2, 0), (3, 2, 0, 0), (0, 0, 0, 0)]
    a = new[5000]["text"]
    assert not any(x in a for x in ("örg", "ller", "cher", "1234", "3704", "Jö", "jö")) and ".org>, +49 " in a and a.endswith(" AN")
    iban = re.search(r"DE\d\d(?: \d+)+", a)[0].replace(" ", "")
    assert surrogates._mod97(iban) == 1 and len(iban) == 22
    b = new[5001]["text"]
    ips = re.findall(r"[0-9A-Fa-f:]{12,}", b)
    assert ips[0] == ips[0].lower() and ips[1] == ips[1].upper() and surrogates.normal("ip6", ips[0]) == surrogates.normal("ip6", ips[1])
    names = re.match(r"(\w+) \w+ wrote to Dr. (\w+) ", b)
    assert names[1] == names[2] != "Maria"
    c = new[5002]["text"]
    assert "lll" not in c and c.endswith("12:30:45 std::dec::ade 4 + 5 6 7 8 9 10 11") and "7946" not in c
    assert new[5004]["n_name"] == 3000 and new[5005]["text"].startswith("我们" * 500)


def test_surrogates_of_crowded_kinds(spark):
    """All domains of two letters get different surrogates, and a thousand names keep their gender and script."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    labels = [("label", a + b) for a in letters for b in letters]
    names = [(f"given_{g}", w + str_) for g in "mf" for w in ("ab", "иб", "λα") for str_ in ("".join(x) for x in itertools.product("абв" if w == "иб" else "αβγ" if w == "λα" else "abc", repeat=5))]
    r = surrogates.assign(spark.createDataFrame(labels + names, "kind string, norm string"), b"k").collect()
    assert len(r) == len(labels) + len(names) > 2000
    got = collections.defaultdict(list)
    for kind, norm, sur in r:
        got[kind.split("_")[0]].append(sur)
        if kind != "label":
            s = surrogates.script(norm)
            own = tuple(e.casefold() for e in surrogates.ENDINGS[s, kind[-1]])
            assert surrogates.script(sur) == s and (sur.endswith(own) or sur in {x.casefold() for x in surrogates.GIVEN[s, kind[-1]]})
    for kind, out in got.items():
        assert len(set(out)) == len(out) and not set(out) & {n for k, n in labels + names if k.startswith(kind)}


def test_perspectives(spark):
    rows = [(1, 0, "system", "rules"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "b b", None), (1, 2, "b b", None), (1, 3, None, "x"), (1, 3, "ann", "y"), (1, 3, "ann", "z"), (1, 4, "ann", "word " * 20_000), (2, 0, "system", "alone"), (None, 0, "ann", "lost")]
    d = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, perspective string")
    got = perspective.rotate_perspectives(d)
    c = duckdb.connect()
    c.register("conversations", d.drop("perspective").toPandas().astype({"conv_id": "Int64"}))
    want = c.sql(perspective.ORACLE).df()
    text = lambda f: sorted(tuple("-" if pd.isna(v) else str(int(v)) if isinstance(v, float) else str(v) for v in r) for r in f[sorted(want.columns)].itertuples(index=False))
    assert text(got.toPandas()) == text(want)
    for r in got.collect():
        if r["trained"]:
            assert r["segment"][r["mask_start"] : r["mask_end"]].endswith("<|im_end|>") and r["out_role"] == "assistant"
    assert {(r["conv_id"], r["perspective"]) for r in got.collect()} == {(1, "ann"), (1, "b b"), (1, "unknown"), (None, "ann")}
    assert got.select("conv_id", "perspective", "turn", "turn_key", "turn_seq").distinct().count() == got.count()  # an order without ties
    assert perspective.rotate_perspectives(d.limit(0)).count() == 0


def brute_components(rows, k, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    low = {}
    for i in range(len(rows)):
        low[find(i)] = min(low.get(find(i), rows[i][0]), rows[i][0])
    return sorted((rows[i][0], len(sets[i]), low[find(i)] if sets[i] else rows[i][0]) for i in range(len(rows)))


def test_near_duplicates(docs, empty):
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(docs, shingle=2).collect())
    assert got == brute_components(local(docs), 2, 80)
    assert neardup.near_duplicates(empty).count() == 0
    kept = neardup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def test_near_duplicates_of_a_torn_family(spark):
    """Copies with so many changes that about half of the pairs are links: components must be exact, also across blocks."""
    r = np.random.default_rng(4)
    base = [f"w{x}" for x in r.integers(0, 5000, 120)]
    rows = []
    for i in range(120):
        w = list(base)
        for p in r.choice(len(w), int(r.integers(2, 12)), replace=False):
            w[p] = f"n{r.integers(0, 10**6)}"
        rows.append((i, " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows, 2, 80)
    got = sorted((x["doc_id"], x["n_shingles"], x["component_id"]) for x in neardup.near_duplicates(d, shingle=2).collect())
    assert got == want and 1 < len({x[2] for x in want}) < 120


@pytest.mark.parametrize("few, block", [(32, 2000), (2, 50)])
def test_near_duplicates_in_crowded_buckets(spark, monkeypatch, few, block):
    """Buckets full of mutually unlike texts, with some similar pairs: every pair must be found, however the bucket is ordered."""
    monkeypatch.setattr(neardup, "_FEW", few, raising=False)
    monkeypatch.setattr(neardup, "_BLOCK", block)
    sketch_rows = neardup._sketch_rows

    def one_bucket(batches, k, size, rows):
        # all texts share the one bucket of the first band, and no other band tells anything
        for b in sketch_rows(batches, k, size, rows):
            yield b.set_column(7, "bands", pa.array([[7]] * len(b), pa.list_(pa.int64())))

    monkeypatch.setattr(neardup, "_sketch_rows", one_bucket)
    r = np.random.default_rng(8)
    rows = []
    for i in range(150):
        w = [f"w{x}" for x in r.integers(0, 10**6, 60)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join([*w[:-2], f"n{i}"]) if i % 3 == 0 else " ".join(f"z{x}" for x in r.integers(0, 10**6, 60)))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows, 2, 80)
    got = sorted((x["doc_id"], x["n_shingles"], x["component_id"]) for x in neardup.near_duplicates(d, shingle=2).collect())
    assert got == want and len({x[2] for x in want}) == 250


def test_links_of_a_large_family_grow_with_its_members(spark, monkeypatch):
    """Rows looked at for a torn family of four times the members are about four times as many, not sixteen."""
    seen = {}
    real = neardup.keep
    monkeypatch.setattr(neardup, "keep", lambda df, name: seen.setdefault(name, []).append(real(df, name)) or seen[name][-1])
    made = []
    for m in (300, 1200):
        seen.clear()
        r = np.random.default_rng(m)
        base = [f"w{x}" for x in r.integers(0, 5000, 120)]
        rows = []
        for i in range(m):
            w = list(base)
            for p in r.choice(len(w), int(r.integers(2, 12)), replace=False):
                w[p] = f"n{r.integers(0, 10**6)}"
            rows.append((i, " ".join(w)))
        neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2).count()
        made.append({k: sum(d.count() for d in seen[k]) for k in ("stars", "met", "forest")})
    assert all(made[1][k] <= 5 * made[0][k] for k in ("stars", "met")), made
    # every group of members gives a forest, and a member is in a group for each band at most
    assert made[1]["stars"] <= 5 * 1200 and made[1]["met"] <= 42 * 1200 and made[1]["forest"] < made[1]["met"]


def test_sketch_estimates_similarity():
    r = np.random.default_rng(1)
    common, a, b = r.integers(0, 2**63, 600, np.uint64), r.integers(0, 2**63, 100, np.uint64), r.integers(0, 2**63, 100, np.uint64)
    h = np.concatenate([np.sort(np.concatenate([common, a])), np.sort(np.concatenate([common, b]))])
    s = neardup.sketches(h, np.array([0, 700, 1400]), 252)
    assert abs((s[0] == s[1]).mean() - 0.75) < 0.12
    tiny = neardup.sketches(np.array([7], np.uint64), np.array([0, 1]), 64)
    assert (tiny != np.uint64(2**64 - 1)).all()


def test_grammar():
    machine, kinds = toxicity.grammar()
    assert len(kinds) == len(machine.table)
    m = toxicity.Matcher({"fool": 3.0, "rott*": 2.0})
    kind = lambda t: [k for k in range(1, toxicity.N_KINDS) if m.features(t)[3 * (k - 1)]]
    assert kind("such a fool") == [1] and kind("you are a fool") == [2] and kind("he is not a fool") == [3] and kind("she said fool") == [4] and kind("I will kill you") == [5]
    assert kind("foolish thing") == [] and kind("ROTTEN!! eggs") == [1] and kind("not here. a fool") == [1] and kind("") == []


def test_toxicity_learns(spark, empty):
    d, lab = spark.read.parquet(f"{SF[:-5]}0.1/documents.parquet").where("doc_id < 4000"), spark.read.parquet(f"{SF[:-5]}0.1/labels.parquet")
    model = toxicity.train(d, lab)
    r = toxicity.score_toxicity(d, model).join(lab.select("doc_id", "toxic"), "doc_id").toPandas()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(r.doc_id, r.held_out, strict=True))
    held = r[r.held_out]
    assert (held.predicted == held.toxic).mean() > 0.95 and ((r.score >= 0.5) == (r.predicted == 1)).all()
    odd = spark.createDataFrame([(None, None, "x"), (1, "", "x")], "doc_id long, text string, score string")
    assert toxicity.score_toxicity(odd, model).count() == 2 and toxicity.score_toxicity(empty, model).count() == 0
    assert toxicity.train(d, lab.limit(0)).insults == {}
    clean = toxicity.drop_toxic(d, lab)
    assert clean.columns == d.columns and clean.count() == toxicity.score_toxicity(d, model).where("predicted = 0").count()


def test_decontamination(spark, docs, empty):
    items = [(1, "In May Anna bought 12 apples and 7 pears for Bob and paid 19 dollars for all of them"), (2, "too short"), (None, "every good bird of the far north sings at dawn when cold winds fall"), (4, None)]
    b = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, pos string")
    more = [
        (4000, "Some words. " + items[0][1].lower() + " more words"), (4001, "In June Clara bought 30 apples and 8 pears for Dave and paid 38 dollars for all of them"), (4002, "In June Clara bought 30 apples and 30 pears for Clara and paid 38 dollars for all of them"),
        (4003, "and then " + items[2][1].upper()), (4004, "every good bird of the far north"), (4005, None),
    ]
    d = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    for bound in (1_000_000, 0):
        got = {r["doc_id"]: r for r in decontaminate.find_contamination(d, b, broadcast_rows=bound).collect() if r["contaminated"]}
        assert set(got) == {4000, 4001, 4003}
        assert got[4001]["reparameterised"] and got[4001]["item_ids"] == [1] and not got[4003]["reparameterised"]
    assert decontaminate.find_contamination(d, b).count() == d.count() and decontaminate.find_contamination(empty, b).count() == 0
    assert decontaminate.find_contamination(d, b.limit(0)).where("contaminated").count() == 0
    kept = decontaminate.drop_contaminated(docs, b)
    assert kept.columns == docs.columns and kept.count() == docs.count()


def brute_leaks(texts, items, k=5, least=0.8, literals=3):
    """{(document, item): (coverage, verbatim)} by looking at every window of every document and item."""

    def toks(text):
        t = re.sub(r"(?<![^\W_])(\d+(?:[.,]\d+)*)", "\u0001\\1", text)
        t = re.sub(rf"(?i)(\u0001[0-9.,]+ ?)({decontaminate.UNITS})(?![^\W\d_])", "\\1 \u0003\\2", t)
        t = "".join(f"\u0002{w}" if len(w) > 1 and w[0].isupper() and w[1:].islower() and w.isalpha() else w for w in re.split(r"([^\W_]+)", t))
        return [x for x in re.sub(r"[^\w.,\u0001-\u0003]+|[.,](?!\d)|(?<!\d)[.,]", " ", t.lower()).split(" ") if x]

    value = lambda x: x[1:] if x < "\u0004" else x
    forms = (lambda x: x[0] if x < "\u0004" else x), (lambda x: x[1:] if x[0] == "\u0002" else x[0] if x < "\u0004" else x)
    out = {}
    for j, item in items:
        it = toks(item or "")
        usable = {}
        for p in range(len(it) - k + 1):
            for v, f in enumerate(forms):
                win = tuple(map(f, it[p : p + k]))
                if len({x for x in win if not x < "\u0004"}) >= literals:
                    usable.setdefault(p, {})[v] = win
        for i, text in texts:
            dt = toks(text or "")
            if not usable:
                n = len(it)
                if n and any([*map(value, dt[q : q + n])] == [*map(value, it)] for q in range(len(dt) - n + 1)):
                    out[i, j] = (1.0, True)
                continue
            lines = {}
            for q in range(len(dt) - k + 1):
                for p, ws in usable.items():
                    if any(tuple(map(f, dt[q : q + k])) == w for w in ws.values() for f in forms):
                        lines.setdefault(q - p, []).append((p, [(value(a), value(b)) for a, b in zip(it[p : p + k], dt[q : q + k], strict=True) if a < "\u0004"]))
            good, same = set(), set()
            for ws in lines.values():
                every = {x for _, s in ws for x in s}
                broken = {x for x in every for y in every if (x[0] == y[0]) != (x[1] == y[1])}
                for p, s in ws:
                    if not broken & set(s):
                        good.add(p)
                        if all(a == b for a, b in s):
                            same.add(p)
            if len(good) >= least * len(usable) - 1e-9:
                out[i, j] = (round(len(good) / len(usable), 6), len(same) >= least * len(usable) - 1e-9)
    return out


def test_decontamination_by_brute_force(spark, docs):
    """Verbatim in any case, names and numbers changed, at sentence starts too, ties, repeated items and rows, very long texts."""
    items = [
        (1, "Tom has 5 apples and gives 3 of them to his sister who eats one at once"), (2, "In May Anna bought 12 apples and 7 pears for Bob and paid 19 dollars for all of them"), (3, "12 + 34 = 46"), (4, "who wrote Emma"),
        (5, "The river Danube flows through 10 countries over 2,850 km into the Black Sea"), (5, "The river Danube flows through 10 countries over 2,850 km into the Black Sea"), (None, "every good bird of the far north sings at dawn when cold winds fall"), (7, None), (8, ""),
        (9, "a rose is a rose is a rose is a rose is a rose and 4 is 4 is 4 is 4"),
    ]
    change = [("Tom", "Eve"), ("5", "9"), ("3", "4"), ("Anna", "Zoe"), ("Bob", "Jim"), ("May", "July"), ("12", "30"), ("7", "8"), ("19", "38"), ("Danube", "Rhine"), ("10", "9"), ("2,850", "1,230")]
    texts = []
    for _, t in items:
        for u in (t, (t or "").lower(), (t or "").upper(), f"So it goes: {t} And more of it follows here.", " ".join((t or "").split()[:-3]), " ".join((t or "").split()[:5])):
            texts += [u, u]
        u = " ".join(dict(change).get(w, w) for w in (t or "").split())
        texts += [u, f"x y z {u} x y z", " ".join({"12": "30", "7": "30", "5": "3", "Anna": "Bob"}.get(w, w) for w in (t or "").split())]
    texts += [LONG[:15_000] + " " + items[1][1] + " " + LONG[:15_000], " ".join([items[0][1], items[0][1].replace("5", "6")] * 3), None]
    rows = list(enumerate(texts))
    want = brute_leaks(rows, dict(items).items())
    d = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, ipos int")
    b = spark.createDataFrame([(*x, "y") for x in items], "item_id long, text string, wh string")
    for bound in (1_000_000, 0):
        keyed = decontaminate.keyed(d)
        ms = decontaminate.matches(keyed, b, broadcast_rows=bound).collect()
        assert len(ms) == len({(r["_id"], r["item"]) for r in ms})
        assert {(r["_id"], r["item"]): (r["coverage"], r["verbatim"]) for r in ms} == want
    hit = {i for i, _ in want}
    for n, (_, t) in enumerate(items):
        for k in range(8):
            assert not t or 15 * n + k in hit  # whole copies in any case, alone or inside a text
    assert {r["doc_id"] for r in decontaminate.find_contamination(d, b).collect() if r["contaminated"]} == hit


@pytest.mark.parametrize("bound", [1_000_000, 0])
def test_decontamination_by_items_without_windows(spark, empty, bound):
    b = spark.createDataFrame([(1, "12 + 34 = 46"), (2, "Who wrote Emma"), (3, "1, 2, 3, 5, 8, 13, 21"), (None, "Anna Bob Clara Dave"), (5, ""), (6, None)], "item_id long, text string")
    texts = ["We know that 12 + 34 = 46 holds.", "We know that 12 + 35 = 47 holds.", "asked: who wrote Emma?", "who wrote about Emma", "so 1, 2, 3, 5, 8, 13, 21 go on", "so 1, 2, 3, 5, 8, 13, 22 go on", "with Anna Bob Clara Dave", None, ""]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["item_ids"], r["coverage"], r["reparameterised"]) for r in decontaminate.find_contamination(d, b, broadcast_rows=bound).collect() if r["contaminated"]}
    assert set(got) == {0, 2, 4, 6}
    assert got[0] == ([1], 1.0, False) and got[2] == ([2], 1.0, False) and got[4] == ([3], 1.0, False)
    assert sorted(r["doc_id"] for r in decontaminate.drop_contaminated(d, b, broadcast_rows=bound).collect()) == [1, 3, 5, 7, 8]
    assert decontaminate.find_contamination(empty, b).count() == 0


def test_packing(spark, docs, empty):
    from tokenizers import Tokenizer

    path = queries.tokenizer_file()
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    d = docs.select("doc_id", "text").where("doc_id <> 1011").unionByName(spark.createDataFrame([(5000, "  a b\n\n c's I'LL x²½Ⅷ b\x1cz\x85 <|endoftext|> ٣٤ 日本")], "doc_id long, text string"))
    r = packing.pack(d, path).toPandas()
    seq = r.groupby("sequence_id")["length"].sum()
    assert seq.max() <= 2048 and seq.sum() / (2048 * len(seq)) > 0.8
    r = r.sort_values(["sequence_id", "offset"])
    assert (r.offset == r.groupby("sequence_id")["length"].cumsum() - r.length).all()
    pieces = r.groupby("doc_id")
    for doc_id, text in set(local(d)):
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 1], np.uint32)
        p = pieces.get_group(doc_id)
        copies = (p.start == 0).sum()
        assert (p.doc_tokens == len(ids)).all() and p.length.sum() == copies * len(ids)
        for x in p.itertuples():
            assert zlib.crc32(ids[x.start : x.start + x.length].tobytes()) == x.ids_crc32
    assert packing.pack(empty, path).count() == 0


def test_packing_follows_neighbours():
    texts = [b"alpha beta gamma", b"delta epsilon zeta", b"alpha beta eta", b"delta epsilon theta"] + [b"filler%d" % i for i in range(60)]
    order = list(packing.order_by_neighbours(packing.Index(texts), np.full(len(texts), 10), 20))
    assert order[:4] == [0, 2, 1, 3] and sorted(order) == list(range(len(texts)))


def test_packing_keeps_special_strings_whole(spark, monkeypatch):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_file())
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n\n y", "  <|endoftext|>  ", "<|endoftext|", "plain  text <|endoftext|>'s"]
    monkeypatch.setattr(queries, "table", lambda *_: spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {x["doc_id"]: (x["doc_tokens"], x["ids_crc32"]) for x in queries.op10_retrieval_packing(spark, "").collect() if x["length"] == x["doc_tokens"]}
    want = [[*tok.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    assert 50256 in want[0]
    assert got == {i: (len(w), zlib.crc32(np.array(w, np.uint32).tobytes())) for i, w in enumerate(want)}


def test_packing_finds_neighbours_in_the_whole_corpus(spark):
    """Best neighbours against brute force on plain words, whatever the blocks; pairs end up together however small the shards are."""
    r = np.random.default_rng(3)
    texts = [" ".join(f"w{int(x)}" for x in r.zipf(1.3, int(r.integers(5, 80))) % 3000) for _ in range(150)]
    texts += [f"{texts[i]} tail{i}" for i in range(0, 150, 3)] + [f"lone{i}" for i in range(5)] + [""]
    bag = [collections.Counter(t.split()) for t in texts]
    df = collections.Counter(w for b in bag for w in b)
    n, mean = len(texts), sum(sum(b.values()) for b in bag) / len(texts)
    gain = [{w: float(packing.gains(df[w], c, sum(b.values()), n, mean)) for w, c in b.items()} for b in bag]
    score = [[sum(g.get(w, 0.0) for w in b) if i != j else 0.0 for j, g in enumerate(gain)] for i, b in enumerate(bag)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    key = {x["_k"]: x["doc_id"] for x in d.select("doc_id", F.xxhash64("text").alias("_k")).collect()}
    for block in (8192, 40):
        got = {key[x["_k"]]: (key[x["found"]], x["score"]) for x in packing.best_neighbours(d.select(F.xxhash64("text").alias("_k"), "text"), block).collect()}
        assert set(got) == {i for i in range(n) if max(score[i]) > 0}
        # equal up to the last whole number of each word's gain, which two logarithms may round apart
        assert all(abs(s - max(score[i])) <= 80 and max(score[i]) - score[i][j] <= 160 for i, (j, s) in got.items())
    # each group's two texts share words that nobody else has; formerly they were dealt to shards at random
    pairs = [(10 * i + k, f"a{i} b{i} c{i} d{i} common {'x' if k else 'y'}{i}") for i in range(400) for k in (0, 1)]
    p = packing.pack(spark.createDataFrame(pairs, "doc_id long, text string"), queries.tokenizer_file(), shard_docs=20).where("start = 0").toPandas()
    shard = dict(zip(p.doc_id, p.sequence_id // (1 << 24), strict=True))
    assert sum(shard[10 * i] == shard[10 * i + 1] for i in range(400)) > 340


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left, counts = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, SF)
        assert left.columns == docs.columns, name
        counts.append(left.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.5 * counts[0]
    assert not secrets.find_secrets(left).where("n_assign + n_access > 0").count()
    packed = corpus_pipeline.run(spark, SF)
    assert packed.select("doc_id").distinct().count() == counts[-1]
