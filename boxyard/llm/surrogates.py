"""PII surrogates: entities found in texts are replaced by others of their type, the same one for the same entity everywhere.

Kinds: the local part and each label of a mail address (the top domain stays), phone (national 3-3-4, or + and a country code in any
grouping), ip (also version 6), card (13 to 19 digits, or 4x4), iban (with right check digits), and the parts of a name, given and family,
after a title or after a given name of the list below. A given name's gender is the title's, or the list's where a title tells none.
An entity's surrogate is drawn from a keyed hash of its normal form (letters folded, digits alone), and
laid out like the occurrence: capitals, separators, country code, octet lengths, script and gender stay, and a number that
passes the Luhn or the mod-97 check still does. Surrogates are checked as a table: two entities of a kind never share one, and none is
an entity that occurs; whoever collides draws again until nothing does, from longer forms where the short ones are used up. Local parts
and labels are kinds of their own, so different domains stay different and one domain is the same in all its addresses.

Defined results: null texts stay null and have no entities; texts without entities stay as they are; a row that occurs twice is rewritten
twice in the same way; tables without rows give none; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import hmac
import ipaddress
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxyard.llm.batches import text_blocks
from boxyard.llm.runs import lists_of
from boxyard.llm.shared import keep, keyed, row_keys

KINDS = ("local", "label", "phone", "ip", "ip6", "card", "iban", "given_m", "given_f", "given_u", "family")

#: Fixed word lists: titles by gender, given names by script and gender, syllables of family names by script.
TITLES = {"m": "Mr Herr Monsieur Señor Sir Г-н Κύριος".split(), "f": "Mrs Ms Miss Frau Madame Señora Señorita Г-жа Κυρία".split(), "u": "Dr Prof".split()}
GIVEN = {
    ("latin", "m"): "Adrian Alexander Andrew Anthony Bruno Carl Charles Daniel David Edward Emil Felix George Gustav Hans Henry Hugo Ivan Jack James John Joseph Julian Karl Leon Martin Michael Nils Oscar Paul Peter Philip Richard Robert Simon Stephen Thomas Victor Walter William".split(),
    ("latin", "f"): "Alice Alma Anna Barbara Bianca Carmen Catherine Clara Diana Elena Elizabeth Emma Flora Greta Hannah Helena Ingrid Irene Jane Jennifer Julia Karen Laura Linda Lucia Margaret Maria Martha Mary Monica Nora Olivia Patricia Paula Rosa Sara Sophie Susan Teresa Vera".split(),
    ("cyrillic", "m"): "Андрей Борис Виктор Глеб Денис Егор Захар Игорь Кирилл Леонид".split(),
    ("cyrillic", "f"): "Алла Вера Галина Дарья Елена Зоя Ирина Клара Лидия Марина".split(),
    ("greek", "m"): "Αλέξης Βασίλης Γιάννης Δημήτρης Κώστας Νίκος Πέτρος Σπύρος".split(),
    ("greek", "f"): "Άννα Βάσω Ελένη Ζωή Κατερίνα Μαρία Σοφία Χρύσα".split(),
}
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ha he ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa se so ta te to va ve vo".split(),
    "cyrillic": "ба бе бо да де до ва ве га го ка ко ла ле ло ма ме мо на не но па ра ре ро са се со та те то".split(),
    "greek": "βα βε γα γο δα δε κα κε κο λα λε λο μα με μο να νε νο πα ρα ρε ρο σα σε σο τα τε το".split(),
}

#: Fixed endings of given names that are put together, by script and gender.
ENDINGS = {
    ("latin", "m"): "us on ard".split(), ("latin", "f"): "ina ia ella".split(), ("cyrillic", "m"): "ий ан ор".split(),
    ("cyrillic", "f"): "ина ия ана".split(), ("greek", "m"): "ος ης ας".split(), ("greek", "f"): "ίνα ία ούλα".split(),
}
#: Telephone country codes of two digits; 1 and 7 are codes of one digit, all others have three.
TWO_DIGITS = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()

_FIRST = re.compile(rb"[+(0-9]")
_NUMBER = re.compile(
    rb"(?P<ip>(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])){3}(?![0-9]|\.[0-9]))"
    rb"|(?P<card>[0-9]{13,19}(?![0-9])|[0-9]{4}(?P<sep>[ -])[0-9]{4}(?P=sep)[0-9]{4}(?P=sep)[0-9]{4}(?![0-9]))"
    rb"|(?P<phone>(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)|[0-9]{3})[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])|\+[1-9](?:[ .()-]{0,2}[0-9]){6,14}(?![0-9]))"
)
_DIGITS = re.compile(rb"[+(0-9][0-9]*")
_ALPHA = rb"[A-Za-z]|[\xc3-\xd4][\x80-\xbf]|\xe1[\xb8-\xbf][\x80-\xbf]"  # letters of Latin, Greek and Cyrillic in UTF-8
_DOMAIN = re.compile(rb"(?:%b|[0-9-])+(?:\.(?:%b|[0-9-])+)*\.(?:%b){2,}" % (_ALPHA, _ALPHA, _ALPHA))
_WORD = re.compile(rb"(?:%b)+" % _ALPHA)
_IBAN = re.compile(rb"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_IP6 = re.compile(rb"(?<![0-9A-Za-z:.])(?:[0-9a-fA-F]{0,4}:){2,7}[0-9a-fA-F]{0,4}(?![0-9A-Za-z:])")


@functools.cache
def _genders() -> dict[str, str]:
    return {name: gender for (_, gender), names in GIVEN.items() for name in names}


@functools.cache
def _leads():
    """Titles with the blank after them, and given names: (length in bytes, gender, whether it is a title)."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for gender, words in TITLES.items():
        for w in words:
            for tail in (" ", ". "):
                t = (w + tail).encode().decode("latin-1")
                a.add_word(t, (len(t), gender, True))
    for name, gender in _genders().items():
        t = (name + " ").encode().decode("latin-1")
        a.add_word(t, (len(t), gender, False))
    a.make_automaton()
    return a


def _plain(b: int) -> bool:
    return b < 0x80 and chr(b).isalnum()


def _in_local(c: str) -> bool:
    o = ord(c)
    return c in "._%+-" or (o < 0x540 or 0x1E00 <= o < 0x2000) and (c.isalnum() or 0x300 <= o < 0x370)


def _mails(text: bytes) -> Iterator[tuple[int, int, str]]:
    at = text.find(b"@")
    while at >= 0:
        if b := _DOMAIN.match(text, at + 1):
            a = at
            while a and (text[a - 1] >= 0x80 or _in_local(chr(text[a - 1]))):
                a -= 1
            near = text[a:at].decode("utf-8", "ignore")
            k = len(near)
            while k and _in_local(near[k - 1]):
                k -= 1
            if k < len(near):
                yield at - len(near[k:].encode()), b.end(), "email"
        at = text.find(b"@", at + 1)


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _ibans(text: bytes) -> Iterator[tuple[int, int, str]]:
    """The longest stretch with right check digits; words in capitals may follow it."""
    for m in _IBAN.finditer(text):
        for end in range(m.end(), m.start() + 14, -1):
            bare = text[m.start() : end].decode().replace(" ", "")
            if len(bare) < 15:
                break
            if text[end - 1] != 32 and not _plain(text[end] if end < len(text) else 32) and _mod97(bare) == 1:
                yield m.start(), end, "iban"
                break


def _ip6s(text: bytes) -> Iterator[tuple[int, int, str]]:
    """Addresses with three groups or more and a digit; fewer are as likely names with a scope."""
    for m in _IP6.finditer(text):
        v = m[0].decode()
        if sum(map(bool, v.split(":"))) > 2 and any(c.isdigit() for c in v):
            try:
                ipaddress.IPv6Address(v)
            except ValueError:
                continue
            yield m.start(), m.end(), "ip6"


def _names(text: bytes) -> Iterator[tuple[int, int, str]]:
    """Capitalized words after a title, or a known given name and those after it; the last one is the family's."""
    reach = 0
    for end, (size, gender, title) in _leads().iter(text.decode("latin-1")):
        start = end + 1 - size
        if start < reach or start and (_plain(text[start - 1]) or text[start - 1] >= 0x80):
            continue
        parts, p = [] if title else [(start, end)], end + 1
        while m := _WORD.match(text, p):
            w = m[0].decode()
            if not w[0].isupper() or len(w) > 1 and not any(c.islower() for c in w[1:]):
                break
            parts.append(m.span())
            p = m.end() + 1
            if text[m.end() : p] not in (b" ", b"-"):
                break
        if len(parts) < (1 if title else 2):
            continue
        reach = parts[-1][1]
        for lo, hi in parts[:-1]:
            yield lo, hi, "given_" + (gender if gender != "u" else _genders().get(text[lo:hi].decode(), "u"))
        yield *parts[-1], "family"


def _numbers(text: bytes) -> Iterator[tuple[int, int, str]]:
    last = 0
    while m := _FIRST.search(text, last):
        p = m.start()
        n = _NUMBER.match(text, p) if not p or not (_plain(text[p - 1]) or text[p - 1] in b".-_+@" and p > 1 and _plain(text[p - 2])) else None
        if n and (n.lastgroup != "phone" or all(len(g) > 1 for g in re.findall(rb"[0-9]+", n[0])[1:])):
            yield p, n.end(), n.lastgroup if n.lastgroup != "sep" else "card"
            last = n.end()
        else:
            last = _DIGITS.match(text, p).end()


def find(text: bytes) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the entities of a UTF-8 text in bytes, in order and without overlaps; mail addresses are whole."""
    found = [*_mails(text), *_ibans(text), *_ip6s(text), *_numbers(text), *_names(text)]
    found.sort(key=lambda f: (f[0], -f[1]))
    out, stop = [], 0
    for f in found:
        if f[0] >= stop:
            out.append(f)
            stop = f[1]
    return out


def parts(text: bytes) -> list[tuple[int, int, str]]:
    """The same with mail addresses taken apart: what gets a surrogate each."""
    out = []
    for lo, hi, kind in find(text):
        if kind != "email":
            out.append((lo, hi, kind))
            continue
        at = text.index(b"@", lo)
        out.append((lo, at, "local"))
        p = at + 1
        for label in text[p:hi].split(b".")[:-1]:
            if label:
                out.append((p, p + len(label), "label"))
            p += len(label) + 1
    return out


def normal(kind: str, value: str) -> str:
    """The same for all ways to write one entity."""
    if kind in ("phone", "card"):
        return "+" * value.startswith("+") + "".join(c for c in value if c.isdigit())
    if kind == "ip6":
        return ipaddress.IPv6Address(value).exploded
    if kind == "iban":
        return value.replace(" ", "")
    return value if kind == "ip" else value.casefold()


def _luhn(digits: str) -> int:
    double = [int(c) * 2 if i % 2 else int(c) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in double) % 10


def script(word: str) -> str:
    c = ord(word[0])
    return "cyrillic" if 0x400 <= c < 0x530 else "greek" if 0x370 <= c < 0x400 or 0x1F00 <= c < 0x2000 else "latin"


def surrogate(key: bytes, kind: str, norm: str, attempt: int) -> str:
    """The attempt-th draw for an entity in normal form; a normal form of the same kind."""
    seed = hmac.new(key, f"{kind}\0{norm}\0{attempt}".encode(), hashlib.sha256).digest()
    draw = (b for i in itertools.count() for b in hashlib.sha256(seed + i.to_bytes(4, "big")).digest())

    def pick(n: int) -> int:
        return (next(draw) << 16 | next(draw) << 8 | next(draw)) % n

    def letter(c: str) -> str:
        first, n = {"latin": ("a", 26), "cyrillic": ("а", 32), "greek": ("α", 17)}[script(c)]
        return chr(ord(first) + pick(n))

    def like(s: str) -> str:
        return "".join(str(pick(10)) if c.isdigit() else letter(c) if c.isalpha() else c for c in s)

    if kind in ("local", "label"):
        return like(norm + "x" * (attempt // 4))
    if kind == "ip":
        spans = {1: (1, 9), 2: (10, 99), 3: (100, 255)}
        octets = [spans[len(o)] if attempt < 8 else (1, 255) for o in norm.split(".")]
        return ".".join(str(a + pick(b - a + 1)) for a, b in octets)
    if kind == "ip6":
        wide = [len(g.lstrip("0")) for g in norm.split(":")]
        ranges_ = [(0, 0) if not w else (16 ** (w - 1), 16**w - 1) if attempt < 8 else (1, 0xFFFF) for w in wide]
        return ":".join(f"{a + pick(b - a + 1):04x}" for a, b in ranges_)
    if kind == "iban":
        body = "".join(str(pick(10)) if c.isdigit() else chr(65 + pick(26)) for c in norm[4:])
        return f"{norm[:2]}{98 - _mod97(norm[:2] + '00' + body):02d}{body}"
    if kind == "card":
        body = norm[0] + like(norm[1:-1])
        if _luhn(norm):
            return body + str(pick(10))
        return body + next(str(d) for d in range(10) if not _luhn(body + str(d)))
    if kind == "phone":
        head = 0 if norm[0] != "+" else 2 if norm[1] in "17" else 3 if norm[1:3] in TWO_DIGITS else 4
        return norm[:head] + str(2 + pick(8)) + like(norm[head + 1 :])
    s = script(norm)
    if kind != "family" and attempt < 4:
        pool = GIVEN[s, kind[-1]] if kind != "given_u" else GIVEN[s, "m"] + GIVEN[s, "f"]
        return pool[pick(len(pool))].casefold()
    word = "".join(SYLLABLES[s][pick(len(SYLLABLES[s]))] for _ in range(2 + attempt // 4 - (kind != "family") + (len(norm) > 6)))
    ends = ENDINGS.get((s, kind[-1])) if kind != "family" else None
    return (word[:-1] + ends[pick(len(ends))]).casefold() if ends else word


def _laid_out_ip6(value: str, other: list[str]) -> str:
    head, _, tail = value.partition("::")
    left, right = (x.split(":") if x else [] for x in (head, tail))
    groups = [f"{int(o, 16):0{len(v)}x}" for v, o in (*zip(left, other, strict=False), *zip(right, other[len(other) - len(right) :], strict=True))]
    text = ":".join(groups[: len(left)]) + ("::" if "::" in value else "") + ":".join(groups[len(left) :])
    return text.upper() if value.upper() == value else text


def laid_out(kind: str, value: str, other: str) -> str:
    """A surrogate's normal form written in the way of an occurrence."""
    if kind in ("phone", "card", "iban"):
        signs = iter(c for c in other if c.isalnum())
        return "".join(next(signs) if c.isalnum() else c for c in value)
    if kind == "ip6":
        return _laid_out_ip6(value, other.split(":"))
    if kind in ("local", "label"):
        return other.upper() if value.isupper() else "".join(o.upper() if c.isupper() else o for c, o in itertools.zip_longest(value, other, fillvalue="")) if len(value) == len(other) else other
    return other if kind == "ip" else re.sub("σ$", "ς", other.capitalize())


def _find_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, bounds in text_blocks(batches):
        raw = data.tobytes()
        ids, ts = rows.column(0).to_pylist(), rows.column(1).to_pylist()
        out = []
        for i, (a, b) in enumerate(itertools.pairwise(bounds.tolist())):
            text = raw[a:b]
            for lo, hi, kind in parts(text):
                value = text[lo:hi].decode("utf-8", "replace")
                out.append((ids[i], ts[i], lo, hi, kind, value, normal(kind, value)))
        if out:
            cols = list(zip(*out, strict=True))
            yield pa.record_batch([pa.array(c) for c in cols], ["_id", "_t", "lo", "hi", "kind", "value", "norm"])


def _drawn(batches: Iterator[pa.RecordBatch], key: bytes) -> Iterator[pa.RecordBatch]:
    for b in batches:
        kind, norm, attempt = (c.to_pylist() for c in b.columns)
        yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array([surrogate(key, *x) for x in zip(kind, norm, attempt, strict=True)], pa.string())], ["kind", "norm", "attempt", "sur"])


def assign(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, norm, sur) for distinct (kind, norm): no surrogate twice in a kind, none that is itself an entity of it.

    Given names are one kind there, whatever their gender.
    """
    settled = None
    family = F.split("kind", "_")[0].alias("class")
    open_ = keep(entities.select("kind", "norm").distinct(), "entities")
    known = open_.select(family, F.col("norm").alias("sur")).distinct()
    open_ = open_.withColumn("attempt", F.lit(0))
    while True:
        drawn = keep(open_.mapInArrow(lambda b: _drawn(b, key), "kind string, norm string, attempt int, sur string"), "drawn")
        taken = known if settled is None else known.unionByName(settled.select(family, "sur"))
        first = drawn.groupBy(family, "sur").agg(F.min(F.struct("norm", "kind")).alias("f")).join(taken, ["class", "sur"], "left_anti")
        good = first.select("f.kind", "f.norm", "sur")
        settled = keep(good if settled is None else settled.unionByName(good), "settled")
        open_ = keep(drawn.join(settled, ["kind", "norm"], "left_anti").select("kind", "norm", (F.col("attempt") + 1).alias("attempt")), "open")
        if not open_.limit(1).count():
            return settled.select("kind", "norm", "sur")


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, bounds in text_blocks(batches):
        at, flat = lists_of(rows, "found")
        lo, hi, kind, value, other = (flat.field(k).to_pylist() for k in range(5))
        raw = data.tobytes()
        texts, counts = [], []
        for i, (a, b) in enumerate(itertools.pairwise(bounds.tolist())):
            text, out, done = raw[a:b], [], 0
            count = dict.fromkeys(KINDS, 0)
            for j in sorted(range(at[i], at[i + 1]), key=lo.__getitem__):
                if lo[j] < done:
                    continue  # the same row twice in the table has its entities twice
                out += [text[done : lo[j]], laid_out(kind[j], value[j], other[j]).encode()]
                done = hi[j]
                count[kind[j]] += 1
            texts.append(b"".join(out) + text[done:])
            counts.append([count["local"], count["phone"], count["ip"] + count["ip6"], count["card"], count["iban"], sum(count[k] for k in KINDS[7:])])
        c = np.array(counts, np.int64).reshape(-1, 6)
        null = rows.column(rows.schema.get_field_index("missing")).to_numpy(zero_copy_only=False)
        yield pa.record_batch([rows.column(0), *(pa.array(c[:, k]) for k in range(6)), pa.array(texts, pa.binary(), mask=null).cast(pa.string())], ["_row", *(f"n_{k}" for k in ("email", "phone", "ip", "card", "iban", "name")), "text"])


def replace_pii(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_email, n_phone, n_ip, n_card, n_iban, n_name, text) of every row, text with surrogates for all entities."""
    d = keyed(docs.select(F.col(id_col).alias("_own"), F.col(text_col).alias("_said")), "_own", "_said")
    found = keep(d.select("_id", "_t", "text").mapInArrow(_find_rows, "_id long, _t long, lo long, hi long, kind string, value string, norm string"), "found")
    lists = found.join(assign(found, key), ["kind", "norm"]).groupBy("_id", "_t").agg(F.collect_list(F.struct("lo", "hi", "kind", "value", "sur")).alias("found"))
    # keyed() has no nulls: whether a text is missing is asked of the table itself
    own = row_keys(docs, id_col, text_col)
    base = docs.select(F.col(id_col).alias("_row"), F.col(text_col).isNull().alias("missing"), own[0].alias("_id"), own[1].alias("_t"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    j = base.join(lists.hint("merge"), ["_id", "_t"], "left").select("_row", "missing", "text", "found")
    kind = docs.schema[id_col].dataType.simpleString()
    return j.mapInArrow(_written, f"_row {kind}, n_email long, n_phone long, n_ip long, n_card long, n_iban long, n_name long, text string").withColumnRenamed("_row", id_col)
