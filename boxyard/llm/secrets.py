"""Secret scan: a keyword automaton over the text, anchored regular expressions at its hits, checksums where a kind has one.

Kinds, in the order of `KINDS`: assign, access and hex are judged by their form alone. github and npm end in a CRC-32
of the token, jwt has a readable JSON header with an algorithm, private_key a base64 block; matches of these kinds that
fail their check are dropped.

Defined results: a null or empty text has no spans. A row is scanned by itself, so repeated rows, ties and extra columns
change nothing; tables without rows give none. Offsets are code points, the end exclusive.
"""

from __future__ import annotations

import base64
import binascii
import functools
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxyard.llm.batches import text_blocks

KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "private_key")
_BASE = 3

_ASSIGN = re.compile(rb"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{16,}")  # whole runs, as a run that is long enough is matched from its start
_GITHUB = re.compile(rb"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
_NPM = re.compile(rb"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
_JWT = re.compile(rb"eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]*+")
_JWT_RUN = re.compile(rb"[A-Za-z0-9_-]++")
# possessive, so that a block without an end is read once
_KEY = re.compile(rb"-----BEGIN ([A-Z ]*)PRIVATE KEY-----\s++([A-Za-z0-9+/=\s]++)-----END \1PRIVATE KEY-----")
_DIGITS = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def token_checksum(body: bytes) -> bytes:
    """CRC-32 of a token's random part as six base-62 digits."""
    n, out = zlib.crc32(body), b""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = _DIGITS[r : r + 1] + out
    return out


def _crc_token(m: re.Match) -> bool:
    body = m[0].split(b"_", 1)[1]
    return token_checksum(body[:30]) == body[30:]


def _jwt(m: re.Match) -> bool:
    head = m[0].split(b".")[0]
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + b"=" * (-len(head) % 4)))
    except (ValueError, TypeError, binascii.Error):
        return False


def _pem(m: re.Match) -> bool:
    try:
        return len(base64.b64decode(b"".join(m[2].split()), validate=True)) >= 32
    except binascii.Error:
        return False


#: keyword (lower case) -> kind, pattern from the keyword's start, check of a match; a failing match still takes its place
_RULES = {
    **{k: (0, _ASSIGN, lambda m: len(m[2]) >= 12) for k in ("password", "passwd", "secret", "token", "apikey", "api_key")},
    "akia": (1, _ACCESS, lambda m: len(m[0]) >= 18),
    **{k: (3, _GITHUB, _crc_token) for k in ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")},
    "npm_": (4, _NPM, _crc_token),
    "eyj": (5, _JWT, _jwt),
    "-----begin": (6, _KEY, _pem),
}


@functools.cache
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for word, rule in _RULES.items():
        a.add_word(word, (len(word), *rule))
    a.make_automaton()
    return a


def scan(text: bytes) -> list[tuple[int, int, int]]:
    """Spans (start, kind, end) of a UTF-8 text in bytes, by start and kind."""
    found = [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    free = [0] * len(KINDS)
    for end, (size, kind, pattern, good) in _automaton().iter(text.lower().decode("latin-1")):
        start = end + 1 - size
        if start < free[kind]:
            continue
        if m := pattern.match(text, start):
            free[kind] = m.end()
            if good(m):
                found.append((start, kind, m.end()))
        elif pattern is _JWT:
            # whatever else begins in this run of characters fails as well
            free[kind] = _JWT_RUN.match(text, start).end()
    found.sort()
    return found


def _points(text: bytes, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The same spans in code points."""
    if not found or text.isascii():
        return found
    before = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return [(int(before[a]), k, int(before[b])) for a, k, b in found]


def redact(text: bytes, found: list[tuple[int, int, int]]) -> bytes:
    """Writes `[SECRET]` for every maximal stretch that spans cover."""
    out, at = [], 0
    stop = -1
    for a, _, b in sorted(found):
        if a > stop:
            if stop >= 0:
                at = stop
            out += [text[at:a], b"[SECRET]"]
        stop = max(stop, b)
    return b"".join(out) + text[stop:] if found else text


def _scan_rows(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for rows, data, bounds in text_blocks(batches):
        raw = data.tobytes()
        counts, sha, spans, texts = [], [], [], []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            text = raw[a:b]
            found = scan(text)
            kinds = [k for _, k, _ in found]
            counts.append([kinds.count(k) for k in range(_BASE)])
            named = [(k, f"{KINDS[k]}:{s}:{e}") for s, k, e in _points(text, found)]
            sha.append(hashlib.sha256(",".join(x for k, x in named if k < _BASE).encode()).hexdigest())
            spans.append(",".join(x for _, x in named))
            if with_text:
                texts.append(redact(text, found))
        c = np.array(counts, np.int64).reshape(-1, _BASE)
        cols = [rows.column(0), *(pa.array(c[:, k]) for k in range(_BASE)), pa.array(sha), pa.array(spans)]
        names = ["_row", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
        if with_text:
            cols, names = [*cols, pa.array(texts, pa.binary()).cast(pa.string())], [*names, "redacted"]
        yield pa.record_batch(cols, names)


def find_secrets(docs: DataFrame, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row; with_text adds `redacted`.

    spans is a list kind:start:end by start and then kind, joined by commas; base_sha256 is the hash of its first three kinds.
    """
    d = docs.select(F.col(id_col).alias("_row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = d.schema["_row"].dataType.simpleString()
    schema = f"_row {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string" + ", redacted string" * with_text
    return d.mapInArrow(lambda b: _scan_rows(b, with_text), schema).withColumnRenamed("_row", id_col)


def redact_secrets(docs: DataFrame, text_col: str = "text", size_col: str | None = None) -> DataFrame:
    """The rows of docs, with all their columns, `[SECRET]` standing for each secret. size_col: a column with the text's length, kept right."""
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.coalesce(docs[text_col], F.lit("")).alias("text"))

    def rewrite(batches):
        for rows, data, bounds in text_blocks(batches):
            raw = data.tobytes()
            texts = []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                found = scan(raw[a:b])
                texts.append(redact(raw[a:b], found) if found else None)
            yield pa.record_batch([rows.column(0), pa.array(texts, pa.binary()).cast(pa.string())], ["row", "new"])

    out = whole.mapInArrow(rewrite, f"row {whole.schema['row'].dataType.simpleString()}, new string")
    old = lambda c: F.col("row").getField(c)
    new = {text_col: F.coalesce("new", old(text_col))}
    if size_col:
        new[size_col] = F.when(F.col("new").isNull(), old(size_col)).otherwise(F.char_length("new").cast(docs.schema[size_col].dataType))
    return out.select(*[new.get(c, old(c)).alias(c) for c in docs.columns])
