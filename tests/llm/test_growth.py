"""Steps of the corpus operators that cost too much on larger tables."""

import re

import numpy as np
import pyarrow as pa

from boxyard.llm import packing, toxicity
from boxyard.llm.queries import tokenizer_file


def test_texts_go_to_python_once(spark, monkeypatch):
    """Clean rows come back as they were, and a batch holds a row's columns and nothing twice."""
    monkeypatch.setattr(toxicity, "train", lambda *a: toxicity.Model({"idiot": 5.0}, [-3.0, *[6.0] * toxicity.N_FEATURES]))
    d = spark.createDataFrame([(1, "a fine day", {"a": 1}, None), (2, "you idiot", None, 2.0), (3, None, None, None), (3, None, None, None)], "doc_id long, body string, text map<string,int>, _0 double")
    clean = toxicity.drop_toxic(d, None, text_col="body")
    assert clean.schema == d.schema
    assert sorted((x["doc_id"], x["body"], x["text"], x["_0"]) for x in clean.collect()) == [(1, "a fine day", {"a": 1}, None), (3, None, None, None), (3, None, None, None)]
    told = re.search(r"MapInArrow keep_clean\(([^)]*)\)", clean._jdf.queryExecution().optimizedPlan().toString())
    assert len(told[1].split(", ")) == len(d.columns)
    assert "struct" not in clean._jdf.queryExecution().optimizedPlan().toString()


def test_copies_are_encoded_once(monkeypatch):
    asked = []

    class Counted:
        def encode(self, text, marks):
            asked.append(text)
            return np.arange(2, 2 + len(text), dtype=np.uint32).tobytes()

    monkeypatch.setattr(packing, "tokenizer", lambda path: Counted())
    rows = pa.record_batch([pa.array([1, 2, 3, 4]), pa.array(["one", "", "one", "two"])], ["_row", "text"])
    got = pa.Table.from_batches(packing._pack(iter([rows]), "", 1, 8, 10, 100, pa.int64(), False)).to_pylist()
    assert sorted(asked) == ["", "one", "two"]
    assert sorted((x["_row"], x["doc_tokens"]) for x in got if x["start"] == 0) == [(1, 4), (2, 1), (3, 4), (4, 4)]


def test_pieces_of_a_text_are_those_of_the_plain_pattern():
    """The pattern that tries nothing twice cuts like the one that GPT-2 was told by."""
    import tiktoken

    bpe = packing.ByteBPE(tokenizer_file())
    plain = tiktoken.Encoding("plain", pat_str=r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks=bpe._whole._mergeable_ranks, special_tokens={})
    for text in ["", " ", "\n", "a\n", "a \n\n b", "a  b", "  a", "it's we'll 'tis ''s 's's", "x\t\ty \t", "12 3a4 5", "!? ..  !\r\n\r\n", "é  é  ", "​ \u0085\u0085x", "'", " 'd'D", "日本 語　 。", "\n\n\n", "a\n\n\n"]:
        assert bpe.encode(text) == plain.encode_to_numpy(text, disallowed_special=()).tobytes(), repr(text)


def test_neighbours_are_the_same_after_documents_go():
    """Scores of unused documents do not change when postings of used ones are dropped, and documents keep their numbers."""
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.3, 30) % 200).encode() for _ in range(200)]
    a, b = packing.Index(texts), packing.Index(texts)
    gone = rng.permutation(200)[:120]
    a.used[gone] = b.used[gone] = True
    a._forget_used()
    assert len(a.doc) < len(b.doc) and len(a._free) == 80
    for seed in range(200):
        assert list(a.neighbours(seed)) == list(b.neighbours(seed))


def test_routes_hash_words_once(monkeypatch):
    """Topics and families of a block come from one pass over its bytes, and long postings add up like short ones."""
    import numpy as np

    from boxyard.llm import packing

    r = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in r.zipf(1.3, 40) if x < 500).encode() for _ in range(1500)]
    index = packing.Index(texts)
    assert index.df.max() > 512
    dense = np.zeros((len(index.df), len(texts)))
    dense[np.repeat(np.arange(len(index.df)), index.df), index.doc] = index.gain
    for seed in (0, 700, 1499):
        index.used[:] = False
        index.used[seed] = True
        want = dense[np.unique(index.term[index.at[seed] : index.at[seed + 1]])].sum(axis=0)
        want[seed] = 0
        order = list(index.neighbours(seed))
        assert len(order) == np.count_nonzero(want) and want[order].tolist() == sorted(want[want > 0].tolist(), reverse=True)
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    words = packing.word_hashes(data, np.append(0, np.cumsum([len(t) + 1 for t in texts])) - np.append(np.zeros(len(texts), int), 1))
    monkeypatch.setattr(packing, "word_hashes", None)
    assert packing.topic_vectors(*words, 64).shape == (1500, 64) and packing.least_hashes(*words, 4, 6).shape == (1500, 6)
