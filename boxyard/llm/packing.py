"""Lexical retrieval packing: documents that share words fill a training sequence together.

The BM25 index is sharded, and documents are dealt to shards by content. Every document has `keys` minimal hashes of its
`shingle`-word runs; it joins the family of the key that most documents of the corpus share, and a document that shares
none is a family of its own. Families lie in the order of their topic, the nearest of `topics` centers of hashed word
vectors, which are fitted on the `sample` different texts of the least hash (a bound; every document is dealt and
indexed). Rows in that order are cut into partitions, and these into shards of at most `shard_docs` documents and
`shard_chars` characters (one longer text is a shard alone); a family beyond a shard goes on in the next one.

Within a shard the inverted index has all words of all texts, and a seed asks with all of its words. Beginning with the
first unused document as seed, unused neighbours follow by falling score until the window is full; the document that
overruns the window is cut there and its rest opens the next window, as its seed. A seed without unused neighbours is
followed by the next unused document. So only the last sequence of a shard is short. best_neighbours() is the exact
search over the whole corpus, whose work grows with its square; it measures what the shards find.

A document's tokens are those of the given byte-level BPE file, then `end_id`. With `marks` the file's special strings
in a text become their one id, as the tokenizers library does it unless told otherwise; without, they are ordinary text.

Defined results: a null text is empty and has the end id alone; every row has its pieces, also repeated ones; texts that
share no word with another are families of their own and find nothing; tables without rows give none; extra columns are
ignored.
"""

from __future__ import annotations

import array
import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxyard.llm.batches import Rolling, byte_values, mix, ranges, text_blocks, word_bounds
from boxyard.llm.shared import keep

_ROLL = Rolling()

#: How the file cuts a text into pieces: 's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+ so that nothing is tried twice.
_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


class ByteBPE:
    """Token ids of a byte-level BPE file (tokenizers' JSON), as little-endian 32-bit numbers."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        vocab = file["model"]["vocab"]
        special = {x["content"]: x["id"] for x in file["added_tokens"] if x["special"]}
        # the 256 bytes stand in such files as printable characters: their own, or the next free ones from 256
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in own]
        byte_of = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}
        ranks = {bytes(byte_of[c] for c in word): i for word, i in vocab.items() if all(c in byte_of for c in word) and word not in special}
        self._whole = tiktoken.Encoding("file", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self._special = set(special)

    def encode(self, text: str, marks: bool = False) -> bytes:
        if marks and any(x in text for x in self._special):
            return array.array("I", self._whole.encode(text, allowed_special=self._special)).tobytes()
        return self._whole.encode_to_numpy(text, disallowed_special=()).tobytes()


@functools.cache
def tokenizer(path: str) -> ByteBPE:
    return ByteBPE(path)


_SCALE = float(1 << 20)
K1, B = 1.2, 0.75


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a hash of each word of a block, A-Z lowered; words of each text)"""
    data = np.where((data > 64) & (data < 91), data + np.uint8(32), data)
    start, end, each = word_bounds(data, bounds)
    word = np.empty(len(start), np.uint64)
    # hashes piece by piece, so that the prefix sums stay small
    step = 1 << 20
    for lo in range(0, len(data), step):
        i, j = np.searchsorted(start, [lo, lo + step])
        if j > i:
            hi = int(end[j - 1])
            word[i:j] = _ROLL.of(_ROLL.prefix(byte_values(data[lo:hi])), start[i:j] - lo, end[i:j] - lo)
    return word, each


def bags(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words of the block, then for each text and each of its words: word, how often, text; words of each text)."""
    word, each = word_hashes(data, bounds)
    words, term = np.unique(word, return_inverse=True)
    key, tf = np.unique(np.repeat(np.arange(len(each)), each) * max(1, len(words)) + term, return_counts=True)
    text, term = np.divmod(key, max(1, len(words)))
    return words, term, tf, text, each


def gains(df, tf, length, n: float, mean: float):
    """BM25 of a word in a text, in whole numbers; for numpy arrays."""
    return np.rint(_SCALE * np.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / max(1.0, mean))))


class Index:
    """BM25 over texts (bytes), or over postings whose gains are known; postings are in the order of their documents."""

    def __init__(self, texts: list[bytes] | None = None, postings: tuple[np.ndarray, np.ndarray, np.ndarray, int] | None = None):
        if postings is None:
            data = np.frombuffer(b"\n".join(texts), np.uint8)
            bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
            bounds[-1] = len(data)
            word, each = word_hashes(data, bounds)
            n = len(texts)
            # words are numbered as they come, and (word, text) sorts straight into postings
            self.term, self.words = pd.factorize(word)
            key, tf = np.unique(self.term * n + np.repeat(np.arange(n), each), return_counts=True)
            term, self.doc = np.divmod(key, max(1, n))
            self.df = np.bincount(term, minlength=len(self.words))
            self.gain = gains(self.df[term], tf, each[self.doc], n, each.mean() if n else 1.0)
            self.at = np.append(0, np.cumsum(each))
        else:
            word, doc, gain, n = postings
            self.words, self.term, self.df = np.unique(word, return_inverse=True, return_counts=True)
            order = np.argsort(self.term, kind="stable")
            self.doc, self.gain = doc[order], gain[order]
            self.at = np.searchsorted(doc, np.arange(n + 1))
        self.begin = np.append(0, np.cumsum(self.df))
        self.used = np.zeros(n, bool)
        self._asked = 0
        self._free = np.arange(n)  # the documents that postings tell of, by their number there

    def scores(self, words: list[np.ndarray]) -> np.ndarray:
        """What each document scores for each list of distinct words; exact."""
        n = len(self.used)
        out = np.zeros((len(words), n))
        if not len(self.words):
            return out
        size = np.array([len(w) for w in words])
        q = np.concatenate(words)
        who = np.repeat(np.arange(len(words)), size)
        t = np.minimum(np.searchsorted(self.words, q), len(self.words) - 1)
        known = self.words[t] == q
        t, who = t[known], who[known]
        heavy = self.df * 50 > n
        # frequent words as products of matrices, some hundred at a time; the others posting by posting
        wide = np.flatnonzero(heavy)
        for lo in range(0, len(wide), 512):
            slab = wide[lo : lo + 512]
            mine, theirs = np.zeros((len(words), len(slab))), np.zeros((len(slab), n))
            place = np.full(len(self.words), -1)
            place[slab] = np.arange(len(slab))
            has = place[t] >= 0
            mine[who[has], place[t[has]]] = 1
            p = ranges(self.begin[slab], self.df[slab])
            theirs[np.repeat(np.arange(len(slab)), self.df[slab]), self.doc[p]] = self.gain[p]
            out += mine @ theirs
        rare = ~heavy[t]
        t, who = t[rare], who[rare]
        cut = np.searchsorted(who, np.arange(len(words) + 1))
        for i in range(len(words)):
            x = t[cut[i] : cut[i + 1]]
            if len(x):
                p = ranges(self.begin[x], self.df[x])
                out[i] += np.bincount(self.doc[p], self.gain[p], n)
        return out

    def _forget_used(self) -> None:
        """Drops the postings of used documents."""
        left = ~self.used[self._free]
        free = left[self.doc]
        self.begin = np.append(0, np.cumsum(free))[self.begin]
        self.doc, self.gain = (np.cumsum(left) - 1)[self.doc[free]], self.gain[free]
        self._free = self._free[left]

    def neighbours(self, seed: int) -> Iterator[int]:
        """Unused documents that share words with the seed, best first."""
        self._asked += 1
        if self._asked % 32 == 0 and np.count_nonzero(self.used[self._free]) > 0.15 * len(self._free):
            self._forget_used()
        t = np.unique(self.term[self.at[seed] : self.at[seed + 1]])
        first, n = self.begin[t], self.begin[t + 1] - self.begin[t]
        # long postings are added as they lie, which costs less than picking their elements; gains are whole numbers, so any order adds up alike
        long = n >= 512
        p = ranges(first[~long], n[~long])
        lists = list(zip(first[long].tolist(), (first[long] + n[long]).tolist(), strict=True))
        doc, gain = (np.concatenate([x[p], *[x[i:j] for i, j in lists]]) for x in (self.doc, self.gain))
        score = np.bincount(doc, gain, len(self._free))
        score[self.used[self._free]] = 0
        most = 64
        number = self._free
        docs = np.flatnonzero(score)
        while len(docs):
            # the best ones first; few seeds ask for more
            top = docs if len(docs) <= most else docs[score[docs] >= np.partition(score[docs], len(docs) - most)[len(docs) - most]]
            yield from number[top[np.argsort(-score[top], kind="stable")]].tolist()
            score[top] = 0
            docs, most = np.flatnonzero(score), 16 * most


def order_by_neighbours(index: Index, sizes: np.ndarray, window: int) -> Iterator[int]:
    """All documents of a shard, each once, in the order in which they fill windows."""
    n = len(sizes)
    fill, unused = 0, 0
    seed = None
    while True:
        if seed is None:
            while unused < n and index.used[unused]:
                unused += 1
            if unused == n:
                return
            seed = unused
            index.used[seed] = True
            yield seed
            fill = (fill + int(sizes[seed])) % window
            continue
        room, last = window - fill, None
        for d in index.neighbours(seed):
            index.used[d] = True
            yield d
            last = d
            room -= int(sizes[d])
            if room <= 0:
                break
        if last is None or room > 0:
            seed, fill = None, window - room
        else:
            seed, fill = last, -room % window


PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_shard(ids: list, texts: list[bytes], tokens: list[bytes], window: int, first_sequence: int) -> tuple[pa.Array, list[np.ndarray]]:
    """The pieces of a shard's documents, and the ids they belong to."""
    sizes = np.fromiter((len(t) // 4 for t in tokens), np.int64, len(tokens))
    who, rows = [], []
    at = 0
    for d in order_by_neighbours(Index(texts), sizes, window):
        t, size, done = tokens[d], int(sizes[d]), 0
        while done < size:
            take = min(size - done, window - at % window)
            who.append(d)
            rows.append((done, take, zlib.crc32(t[4 * done : 4 * (done + take)]), size, first_sequence + at // window, at % window))
            done += take
            at += take
    return pa.array([ids[d] for d in who]), rows


def _pack(batches: Iterator[pa.RecordBatch], path: str, end_id: int, window: int, shard_docs: int, shard_chars: int, kind: pa.DataType, marks: bool) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    bpe = tokenizer(path)
    end = np.uint32(end_id).tobytes()
    part = TaskContext.get().partitionId() if TaskContext.get() else 0
    n_shard = held = 0
    ids, texts, tokens, coded = [], [], [], {}

    def flush():
        # a sequence's id: partition, shard in it, sequence in that
        first = (part << 40) | (n_shard << 24)
        who, rows = pack_shard(ids, texts, tokens, window, first)
        cols = list(zip(*rows, strict=True))
        return pa.record_batch([who.cast(kind), *(pa.array(c, pa.int64()) for c in cols)], ["_row", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    for batch in batches:
        for row, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = text.as_py()
            if ids and (len(ids) >= shard_docs or held + len(raw) > shard_chars):
                yield flush()
                ids, texts, tokens, coded, held, n_shard = [], [], [], {}, 0, n_shard + 1
            ids.append(row)
            texts.append(raw.encode())
            if texts[-1] not in coded:  # copies lie in one family
                coded[texts[-1]] = bpe.encode(raw, marks) + end
            tokens.append(coded[texts[-1]])
            held += len(raw)
    if ids:
        yield flush()


def _bag_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for got, data, bounds in text_blocks(batches):
        words, term, tf, text, each = bags(data, bounds)
        word = words[term]
        at = np.searchsorted(text, np.arange(len(each) + 1)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(x)) for x in (word.view(np.int64), tf.astype(np.int32))]
        yield pa.record_batch([got.column(0), pa.array(each.astype(np.int64)), *lists], ["_k", "size", "words", "tf"])


def _meet(table: pa.Table) -> pa.Table:
    """Of two blocks (or a block and itself), what each text finds in the other one: (_k, found, score)."""
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    table = table.take(pa.compute.sort_indices(table, [("_k", "ascending")]))
    mine = table.column("mine").to_numpy()
    sides = []
    for x in {i, j}:
        at = table.filter(pa.array(mine == x)).combine_chunks()
        sides.append((at.column("_k").to_numpy(), [np.frombuffer(w, np.uint64) for w in at.column("words").to_pylist()], [np.frombuffer(g, np.int32) for g in at.column("gains").to_pylist()]))
    out = []
    for (key, words, _), (keys, others, gain) in ((sides[0], sides[-1]), (sides[-1], sides[0]))[: len(sides)]:
        if not len(key) or not len(keys):
            continue
        doc = np.repeat(np.arange(len(keys)), [len(w) for w in others])
        index = Index(postings=(np.concatenate(others), doc, np.concatenate(gain).astype(np.float64), len(keys)))
        step = 256
        for lo in range(0, len(key), step):
            k = key[lo : lo + step]
            s = index.scores(words[lo : lo + step])
            s[k[:, None] == keys[None, :]] = 0  # no text finds itself
            best = s.argmax(axis=1)  # the first of equal ones has the smaller key
            top = s[np.arange(len(k)), best]
            out.append((k[top > 0], keys[best[top > 0]], top[top > 0]))
    cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    return pa.table(dict(zip(("_k", "found", "score"), cols, strict=True)))


def best_neighbours(texts: DataFrame, block: int = 8192) -> DataFrame:
    """(_k, found, score): for each of the different texts (_k, text) the one that scores best of all, if any shares a word."""
    bag = keep(texts.mapInArrow(_bag_rows, "_k long, size long, words array<long>, tf array<int>"), "bags")
    n, total = bag.agg(F.count(F.lit(1)), F.sum("size")).first()
    # words that one text alone has lead nowhere
    df = keep(bag.select(F.explode("words").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "frequencies")
    p = bag.select("_k", "size", F.explode(F.arrays_zip("words", "tf")).alias("x")).select("_k", "size", F.col("x.words").alias("w"), F.col("x.tf").alias("tf")).join(df, "w")
    mean = max(1.0, (total or 0) / max(1, n))
    idf = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    gain = F.rint(F.lit(_SCALE) * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.lit(mean))))
    found = p.select("_k", "w", gain.cast("int").alias("g")).groupBy("_k").agg(F.collect_list("w").alias("words"), F.collect_list("g").alias("gains"))
    blocks = max(1, -(-n // block))
    packed = keep(found.mapInArrow(_as_bytes, "_k long, words binary, gains binary").withColumn("mine", F.pmod("_k", F.lit(blocks)).cast("int")), "postings")
    both = packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    both = both.select(F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "_k", "words", "gains")
    got = both.groupBy("i", "j").applyInArrow(_meet, "_k long, found long, score double")
    return keep(got.groupBy("_k").agg(F.max(F.struct("score", F.bitwise_not("found").alias("f"))).alias("x")).select("_k", F.bitwise_not("x.f").alias("found"), "x.score"), "found")


def _as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for got in batches:
        cols = [pa.array([x.values.to_numpy().tobytes() for x in got.column(c)], pa.binary()) for c in (1, 2)]
        yield pa.record_batch([got.column(0), *cols], ["_k", "words", "gains"])


def topic_vectors(word: np.ndarray, each: np.ndarray, dims: int) -> np.ndarray:
    """For each text of word_hashes(), how often its words fall into each of `dims` cells, as a vector of length one; a text's length tells nothing."""
    cell = (word % np.uint64(dims)).astype(np.int64)
    text = np.repeat(np.arange(len(each)), each)
    v = np.bincount(text * dims + cell, minlength=len(each) * dims).reshape(len(each), dims).astype(np.float32)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def fit_topics(texts: DataFrame, topics: int = 16, sample: int = 2000, dims: int = 512) -> np.ndarray:
    """Centers of topics from the `sample` different texts (_k, text) of the least hash _k: `topics` rows of `dims` numbers."""
    last = texts.select("_k").distinct().orderBy("_k").limit(sample).agg(F.max("_k")).first()[0]
    if last is None:
        return np.zeros((1, dims), np.float32)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got, data, bounds in text_blocks(batches):
            v = topic_vectors(*word_hashes(data, bounds), dims)
            yield pa.record_batch([got.column(0), pa.array([x.tobytes() for x in v], pa.binary())], ["_k", "v"])

    rows = texts.where(F.col("_k") <= last).mapInArrow(vectors, "_k long, v binary").groupBy("_k").agg(F.min("v").alias("v")).orderBy("_k").collect()
    v = np.frombuffer(b"".join(bytes(r["v"]) for r in rows), np.float32).reshape(-1, dims)
    # words that all topics have tell nothing
    v = v * np.log((1 + len(v)) / (1 + (v > 0).sum(axis=0)), dtype=np.float32)
    centers = v[np.linspace(0, len(v) - 1, min(topics, len(v))).astype(int)]
    for _ in range(10):
        own = (v @ (centers / np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-9)).T).argmax(axis=1)
        centers = np.stack([v[own == k].mean(axis=0) if (own == k).any() else centers[k] for k in range(len(centers))])
    return centers / np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-9)


def least_hashes(words: np.ndarray, each: np.ndarray, shingle: int, keys: int) -> np.ndarray:
    """For each text of word_hashes() the least of its word runs under each of `keys` orders; of a shorter text the whole is the run."""
    first = np.cumsum(each) - each
    n = np.maximum(np.minimum(each, 1), each - shingle + 1)
    at = ranges(first, n)
    h = _ROLL.of(_ROLL.prefix(words), at, at + np.repeat(np.minimum(each, shingle), n))
    out = np.zeros((len(each), keys), np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        cut = (np.cumsum(n) - n)[full]
        for k in range(keys):
            out[full, k] = np.minimum.reduceat(mix(h + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)), cut)
    return out


def routes(texts: DataFrame, centers: np.ndarray, shingle: int = 4, keys: int = 6) -> DataFrame:
    """(_r, topic, family) of the rows (_r, text)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got, data, bounds in text_blocks(batches):
            words = word_hashes(data, bounds)
            topic = (topic_vectors(*words, centers.shape[1]) @ centers.T).argmax(axis=1)
            least = least_hashes(*words, shingle, keys).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, least.size + 1, keys, dtype=np.int32)), pa.array(least.ravel()))
            yield pa.record_batch([got.column(0), pa.array(topic.astype(np.int32)), lists], ["_r", "topic", "keys"])

    found = keep(texts.mapInArrow(find, "_r long, topic int, keys array<long>"), "keys")
    each = found.select("_r", "topic", F.explode("keys").alias("key"))
    shared = each.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("topic").alias("topic")).where("n > 1")
    joins = each.select("_r", "key").join(shared, "key").groupBy("_r").agg(F.max(F.struct("n", "key", "topic")).alias("f"))
    return keep(found.join(joins, "_r", "left").select("_r", F.coalesce("f.topic", "topic").alias("topic"), F.coalesce("f.key", F.get("keys", F.lit(0))).alias("family")).dropDuplicates(["_r"]), "routes")


def pack(
    docs: DataFrame, path: str, window: int = 2048, end_id: int = 1, shard_docs: int = 5000, shard_chars: int = 12_000_000, id_col: str = "doc_id", text_col: str = "text",
    marks: bool = False, topics: int = 16, sample: int = 2000, shingle: int = 4, keys: int = 6,
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): a row for each piece of each row's tokens.

    path is the tokenizer's file, at the same place on every machine.
    """
    d = docs.select(F.col(id_col).alias("_row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    centers = fit_topics(d.select(F.xxhash64("text").alias("_k"), "text"), topics, sample)
    d = d.withColumn("_r", F.xxhash64("_row", "text"))
    route = routes(d.select("_r", "text"), centers, shingle, keys)
    order = ["topic", "family", "_r"]
    d = d.join(route.hint("merge"), "_r").repartitionByRange(*order).sortWithinPartitions(*order).select("_row", "text")
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[d.schema["_row"].dataType.simpleString()]
    kind = d.schema["_row"].dataType.simpleString()
    return d.mapInArrow(lambda b: _pack(b, path, end_id, window, shard_docs, shard_chars, arrow, marks), f"_row {kind}, {PIECES}").withColumnRenamed("_row", id_col)
