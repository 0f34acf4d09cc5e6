"""Toxicity: a weighted finite-state grammar over clauses, its insult terms and weights learned from labels.

Words become symbols: insult, threat, target, negation, reported speech, or nothing. One small transducer watches each
symbol; their composition reads a clause and tells in which way it is toxic (plain, aimed at somebody, negated, reported,
a threat). An insult's weight is its log odds in the labelled rows. A document's score is a logistic function of what
its clauses add up to, never of single words.

Training reads at most `max_train` labelled rows (those of least hash), whatever the corpus: that bound is also the bound
of everything gathered in the driver (terms, and one feature row for each training row). Rows whose crc32(id as text) is
0 modulo `folds` are never trained on. Labels, language, source and id are no inputs of a score.

Defined results: null and empty texts have no clauses and get the score of a text without matches; a null id counts as
the empty string; null labels are left out, and of different labels for one id the larger counts. Repeated rows are each
scored. With no toxic or no clean training row the grammar uses its fixed terms alone. Extra columns are ignored.
"""

from __future__ import annotations

import dataclasses
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxyard.llm.batches import text_blocks

INSULT, THREAT, TARGET, NEGATION, REPORT = range(5)

#: Fixed terms of the grammar, several languages; a star stands for any ending.
TERMS = {
    THREAT: "kill* murder* strangle* stab* shoot* töte* umbringen tuer* matar* mataré".split(),
    TARGET: "you your you're u ur they them those du dich dir euch ihr tu te toi vous tú usted ustedes vosotros".split(),
    NEGATION: "not never no isn't aren't wasn't nicht kein* nie pas jamais nunca tampoco".split(),
    REPORT: "said says told claimed reported quote* wrote sagte sagt schrieb dit écrit dijo escribió".split(),
}


@dataclasses.dataclass(frozen=True)
class Transducer:
    """Reads symbols; table[state][symbol] is the next state, the state at the end of a clause is its output."""

    table: tuple[tuple[int, ...], ...]

    def compose(self, other: Transducer) -> tuple[Transducer, list[tuple[int, int]]]:
        """Both side by side; the reachable pairs of states, in the order of the new states."""
        pairs, at = [(0, 0)], {(0, 0): 0}
        table = []
        for a, b in pairs:  # grows while it is read
            row = []
            for x, y in zip(self.table[a], other.table[b], strict=True):
                if (x, y) not in at:
                    at[x, y] = len(pairs)
                    pairs.append((x, y))
                row.append(at[x, y])
            table.append(tuple(row))
        return Transducer(tuple(table)), pairs


def _seen(symbol: int) -> Transducer:
    """1 once the symbol was read."""
    return Transducer((tuple(int(s == symbol) for s in range(5)), (1,) * 5))


def _before(first: int, then: tuple[int, ...]) -> Transducer:
    """2 once `first` was read with one of `then` after it."""
    return Transducer((tuple(int(s == first) for s in range(5)), tuple(2 if s in then else 1 for s in range(5)), (2,) * 5))


def grammar() -> tuple[Transducer, list[int]]:
    """The composed transducer, and for each of its states the kind of clause (0: not toxic)."""
    parts = [_seen(INSULT), _seen(THREAT), _seen(TARGET), _before(NEGATION, (INSULT, THREAT)), _before(REPORT, (INSULT, THREAT))]
    whole, outputs = parts[0], [(s,) for s in range(2)]
    for p in parts[1:]:
        whole, pairs = whole.compose(p)
        outputs = [(*outputs[a], b) for a, b in pairs]
    kinds = []
    for insult, threat, target, negated, reported in outputs:
        toxic = insult or (threat and target)
        kinds.append(0 if not toxic else 4 if reported == 2 else 3 if negated == 2 else 5 if threat and target else 2 if target else 1)
    return whole, kinds


N_KINDS = 6
#: Of each kind of clause: number and sum of weights (both saturating), and the largest weight.
N_FEATURES = 3 * (N_KINDS - 1)


@dataclasses.dataclass
class Model:
    insults: dict[str, float]  # "word" or "stem*" -> weight
    coefficients: list[float]  # bias first

    def score(self, features: np.ndarray) -> np.ndarray:
        z = self.coefficients[0] + features @ np.array(self.coefficients[1:])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


#: Letters and bytes of longer characters stay, what ends a clause becomes a line end, the rest a blank.
_TABLE = bytes(c if chr(c).isascii() and chr(c).isalnum() or c >= 0x80 or c == 0x27 else 0x0A if chr(c) in ".;!?:\n" else 0x20 for c in range(256))


class Matcher:
    """Finds the grammar's symbols in texts and gives each text its clause features."""

    def __init__(self, insults: dict[str, float]):
        import ahocorasick

        self.machine, self.kinds = grammar()
        self.automaton = ahocorasick.Automaton()
        terms = [(t, INSULT, w) for t, w in insults.items()] + [(t, s, 0.0) for s, ts in TERMS.items() for t in ts if t not in insults]
        for term, symbol, weight in terms:
            stem = term.rstrip("*").encode().decode("latin-1")
            for edge in " \n":
                key = edge + stem
                had = self.automaton.get(key, ())
                self.automaton.add_word(key, (*had, (len(stem), term.endswith("*"), symbol, weight)))
        self.automaton.make_automaton()

    def features(self, text: str) -> list[float]:
        s = "\n" + text.lower().encode("utf-8", "replace").translate(_TABLE).decode("latin-1") + "\n"
        out = [0.0] * N_FEATURES
        state, weight, last = 0, 0.0, 0

        def close():
            kind = self.kinds[state]
            if kind:
                at = 3 * (kind - 1)
                out[at] = min(out[at] + 1.0, 4.0)
                out[at + 1] = min(out[at + 1] + weight, 30.0)
                out[at + 2] = max(out[at + 2], weight)

        for end, found in self.automaton.iter(s):
            for size, stem, symbol, w in found:
                if not stem and s[end + 1] not in " \n":
                    continue
                start = end + 1 - size
                if "\n" in s[last:start] if start - last < 400 else s.find("\n", last, start) >= 0:
                    close()
                    state, weight = 0, 0.0
                last = start
                state = self.machine.table[state][symbol]
                weight = max(weight, w)
        close()
        return out


def fold(id_col: Column, folds: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def _word_list(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), F.lit(1)))


def _terms_of(words: Column) -> Column:
    """Of words, themselves and their stems `xxx*` of 4 to 8 letters."""
    stems = F.flatten(F.transform(words, lambda w: F.transform(F.filter(F.sequence(F.lit(4), F.lit(8)), lambda k: k < F.char_length(w)), lambda k: F.concat(F.substring(w, F.lit(1), k), F.lit("*")))))
    return F.array_distinct(F.concat(words, stems))


def learn_terms(train: DataFrame, max_terms: int = 4000, least: int = 2, odds: float = 12.0, cover: int = 4) -> dict[str, float]:
    """Terms that mark toxic rows. train: (text, toxic), of bounded size.

    Candidates have high odds; of these a greedy cover takes the one that explains most of the toxic rows that fewer than
    `cover` terms explain, so most words that merely stand beside an insult in copied texts are left out.
    """
    t = train.groupBy(F.xxhash64("text").alias("k")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
    t = t.select("k", "toxic", _word_list(F.col("text")).alias("words"))
    n = {r["toxic"]: r["n"] for r in t.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_pos, n_neg = n.get(1, 0), n.get(0, 0)
    if not n_pos or not n_neg:
        return {}
    by_word = t.select("toxic", F.explode("words").alias("w")).groupBy("w").agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("q")).where(F.col("p") > 0)
    # a stem's clean words need counting too, so words without toxic rows come back for the stems that are left
    stems = by_word.select(F.explode(_terms_of(F.array("w"))).alias("term"), "p").groupBy("term").agg(F.sum("p").alias("p")).where(F.col("p") >= least)
    clean = t.where(F.col("toxic") == 0).select(F.explode("words").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("q"))
    clean = clean.select(F.explode(_terms_of(F.array("w"))).alias("term"), "q").groupBy("term").agg(F.sum("q").alias("q"))
    ratio = ((F.col("p") + 0.5) / (n_pos + 1.0)) / ((F.coalesce(F.col("q"), F.lit(0)) + 0.5) / (n_neg + 1.0))
    found = stems.join(clean, "term", "left").select("term", "p", ratio.alias("ratio")).where(F.col("ratio") >= odds)
    best = found.orderBy(F.desc(F.col("p") * F.log("ratio")), "term").limit(max_terms)
    weight = {r["term"]: math.log(r["ratio"]) for r in best.collect()}
    if not weight:
        return {}
    names = train.sparkSession.createDataFrame([(w,) for w in weight], "term string")
    rows = t.where(F.col("toxic") == 1).select("k", F.explode(_terms_of(F.col("words"))).alias("term")).join(F.broadcast(names), "term").collect()
    has: dict[str, set[int]] = {}
    for r in rows:
        has.setdefault(r["term"], set()).add(r["k"])
    chosen: dict[str, float] = {}
    need = dict.fromkeys(set().union(*has.values()), cover)
    gain = {w: len(has.get(w, ())) * weight[w] for w in weight}
    while gain:
        # gains only fall, so a candidate whose refreshed gain still leads is the best one
        w = max(gain, key=lambda x: (gain[x], not x.endswith("*"), len(x), x))
        fresh = sum(need[k] > 0 for k in has.get(w, ())) * weight[w]
        if fresh < gain[w]:
            gain[w] = fresh
            if fresh < least * math.log(odds):
                del gain[w]
            continue
        del gain[w]
        stem = w.rstrip("*")
        if any(c.startswith(stem) and len(has[w]) < 1.3 * len(has[c]) for c in chosen):
            continue  # a shorter stem of a chosen term that says little more
        chosen[w] = round(min(weight[w], 8.0), 6)
        for k in has[w]:
            need[k] -= 1
    return chosen


def fit(features: np.ndarray, labels: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> list[float]:
    """Logistic regression by Newton steps; a small ridge on all but the bias."""
    x = np.hstack([np.ones((len(features), 1)), features])
    b = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (labels - p) - penalty * b
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty) + 1e-9 * np.eye(x.shape[1])
        step = np.linalg.solve(h, g)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return [float(v) for v in b]


#: Used where labels of one kind are missing: any toxic clause counts.
_DEFAULT = [-3.0, *itertools.chain.from_iterable([(3.0, 0.0, 0.1), (4.0, 0.0, 0.1), (0.5, 0.0, 0.0), (1.0, 0.0, 0.0), (5.0, 0.0, 0.1)])]


def _matched(batches: Iterator[pa.RecordBatch], insults: dict[str, float]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    m = Matcher(insults)
    for rows, data, bounds in text_blocks(batches):
        raw = data.tobytes()
        yield rows, np.array([m.features(raw[a:b].decode("utf-8", "replace")) for a, b in itertools.pairwise(bounds.tolist())], float)


def train(docs: DataFrame, labels: DataFrame, max_train: int = 20_000, folds: int = 5, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learns terms and weights from at most max_train labelled rows outside fold 0."""
    own = labels.select(F.col(id_col).alias("_lid"), F.col(label_col).cast("int").alias("toxic")).where(F.col("_lid").isNotNull() & F.col("toxic").isin(0, 1))
    own = own.where(fold(F.col("_lid"), folds) != 0).groupBy("_lid").agg(F.max("toxic").alias("toxic"))
    own = own.orderBy(F.xxhash64("_lid"), "_lid").limit(max_train)
    d = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = d.join(F.broadcast(own), F.col("_id") == F.col("_lid")).select("text", "toxic")  # max_train rows of two numbers
    insults = learn_terms(rows)

    def features(batches):
        for got, x in _matched(batches, insults):
            yield pa.record_batch([got.column(1), pa.array(list(x), pa.list_(pa.float64()))], ["toxic", "x"])

    seen = rows.mapInArrow(features, "toxic int, x array<double>").groupBy("toxic", "x").count().orderBy("toxic", "x").collect()
    y = np.repeat([r["toxic"] for r in seen], [r["count"] for r in seen]) if seen else np.zeros(0)
    if len(set(y.tolist())) < 2:
        return Model(insults, _DEFAULT)
    x = np.repeat(np.array([r["x"] for r in seen], float), [r["count"] for r in seen], axis=0)
    return Model(insults, fit(x, y))


def score_toxicity(docs: DataFrame, model: Model, folds: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted, n_clauses) of every row."""

    def score(batches):
        for rows, x in _matched(batches, model.insults):
            s = np.round(model.score(x), 9)
            yield pa.record_batch([rows.column(0), rows.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(x[:, 0::3].sum(axis=1).astype(np.int32))], ["_row", "held_out", "score", "predicted", "n_clauses"])

    d = docs.select(F.col(id_col).alias("_row"), (fold(F.col(id_col), folds) == 0).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = d.schema["_row"].dataType.simpleString()
    return d.mapInArrow(score, f"_row {kind}, held_out boolean, score double, predicted int, n_clauses int").withColumnRenamed("_row", id_col)


def drop_toxic(docs: DataFrame, labels: DataFrame, max_train: int = 20_000, folds: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that a model trained on them and the labels doesn't call toxic."""
    model = train(docs, labels, max_train, folds, id_col, text_col)
    # rows go to Python as they are, each text once: a batch of long texts is what a worker's memory is made of
    names = ["text" if c == text_col else f"_{i}" for i, c in enumerate(docs.columns)]
    whole = docs.select(*[docs[c].alias(n) for c, n in zip(docs.columns, names, strict=True)])

    def keep_clean(batches):
        for rows, x in _matched(batches, model.insults):
            yield rows.filter(pa.array(model.score(x) < 0.5))

    kinds = ", ".join(f"{n} {whole.schema[n].dataType.simpleString()}" for n in names)
    return whole.mapInArrow(keep_clean, kinds).toDF(*docs.columns)
