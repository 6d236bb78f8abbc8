"""Secret scan: an Aho-Corasick automaton finds keywords, anchored expressions run only where one stands, and kinds with an embedded checksum are checked by it.

Kinds. Base: assign, access, hex. Added, each kept only if its embedded checksum or length holds: github and npm
(the last six characters are the base-62 CRC-32 of the thirty before them), pem (the DER length in the key's first
bytes equals the decoded size). `hex` has no keyword: its automaton words would be the sixteen digits themselves, so one
compiled scan for long runs stands in for the prefilter.

Null and empty texts have no span. A repeated row gives a repeated result, a null doc_id stays null, an empty table gives no rows. Columns of the input with names of the result
are not carried along; the operator returns doc_id and its own columns only.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "github", "npm", "pem")
_VALUE = r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
_ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))" + _VALUE, re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_GITHUB = re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
_NPM = re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
_PEM = re.compile(r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----([A-Za-z0-9+/=\s]+)-----END [A-Z ]{0,20}PRIVATE KEY-----")
#: Keyword (lower case, as the automaton sees the text) -> kind.
_KEYWORDS = {"password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign", "akia": "access", "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm", "-----begin ": "pem"}
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

SCHEMA = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_checked bigint"


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word, kind in _KEYWORDS.items():
        found.add_word(word, (len(word), kind))
    found.make_automaton()
    return found


def base62_crc(body: str) -> str:
    """CRC-32 of body in six base-62 digits."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, digit = divmod(n, 62)
        out = _BASE62[digit] + out
    return out


def _checksum_holds(token: str) -> bool:
    body = token.split("_", 1)[1]
    return base62_crc(body[:30]) == body[30:]


def _der_length_holds(armour: str) -> bool:
    try:
        der = base64.b64decode("".join(armour.split()), validate=True)
    except (binascii.Error, ValueError):
        return False
    if len(der) < 4 or der[0] != 0x30:
        return False
    if der[1] < 0x80:
        return len(der) == 2 + der[1]
    n = der[1] & 0x7F
    return 0 < n <= 4 and len(der) == 2 + n + int.from_bytes(der[2 : 2 + n], "big")


def _lowered(text: str) -> str:
    """Lower case with every character in its place. Letters beyond ASCII may gain hits, which the anchored expressions refuse."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_ASCII_LOWER)


def _accept(kind: str, text: str, at: int) -> tuple[int, bool] | None:
    """(end, kept) of the expression of `kind` anchored at `at`, or None. A match that isn't kept still uses up its characters."""
    if kind == "assign":
        return (m.end(), len(m[2]) >= 12) if (m := _ASSIGN.match(text, at)) else None
    if kind == "access":
        return (m.end(), m.end() - at >= 18) if (m := _ACCESS.match(text, at)) else None
    if kind == "pem":
        return (m.end(), _der_length_holds(m[1])) if (m := _PEM.match(text, at)) else None
    pattern = _GITHUB if kind == "github" else _NPM
    return (m.end(), _checksum_holds(m[0])) if (m := pattern.match(text, at)) else None


def find(text: str, words: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed; offsets in code points, end exclusive; per kind leftmost and not overlapping."""
    spans, until = [], dict.fromkeys(KINDS, 0)
    hits = sorted((end - n + 1, kind) for end, (n, kind) in words.iter(_lowered(text)))
    for at, kind in hits:
        if at >= until[kind] and (m := _accept(kind, text, at)):
            until[kind] = m[0]
            if m[1]:
                spans.append((at, m[0], kind))
    spans += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def scan_text(text: str | None, words: ahocorasick.Automaton) -> tuple:
    spans = find(text, words) if text else []
    write = lambda some: ",".join(f"{kind}:{start}:{end}" for start, end, kind in some)
    base = [s for s in spans if s[2] in BASE_KINDS]
    n = [sum(s[2] == kind for s in base) for kind in BASE_KINDS]
    return (*n, hashlib.sha256(write(base).encode()).hexdigest(), write(spans), len(spans) - len(base))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = automaton()
    names = [x.split()[0] for x in SCHEMA.split(", ")][1:]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    for batch in batches:
        found = [scan_text(text.as_py(), words) for text in batch.column("text")]
        columns = list(zip(*found, strict=True)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["doc_id", *names])


def scan(documents: DataFrame) -> DataFrame:
    """One row per row of documents (doc_id, text): counts of the base kinds, digest of the base spans, all spans, spans that a checksum proved.

    Reads each text once, in place: no shuffle, and no state beyond a batch."""
    return documents.select("doc_id", "text").mapInArrow(_scan, SCHEMA)


def _masker(mark: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = automaton()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            done = [masked(t, words, mark) for t in texts]
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            columns["text"] = pa.array(done, batch.schema.field("text").type)
            if "n_chars" in columns:
                old, kind = columns["n_chars"].to_pylist(), batch.schema.field("n_chars").type
                columns["n_chars"] = pa.array([n if d == t else len(d) for t, d, n in zip(texts, done, old, strict=True)], kind)
            yield pa.RecordBatch.from_arrays(list(columns.values()), schema=batch.schema)

    return run


def masked(text: str | None, words: ahocorasick.Automaton, mark: str) -> str | None:
    """text with every character of a secret's span gone and one mark in its place; spans that overlap share a mark."""
    out, at = [], 0
    for start, end, kind in find(text, words) if text else []:
        if start >= at:
            out += [text[at:start], mark.format(kind=kind)]
        at = max(at, end)
    return text if not out else "".join([*out, text[at:]])


def mask(documents: DataFrame, mark: str = "[{kind}]") -> DataFrame:
    """documents with secrets masked; n_chars, where there is one, follows a changed text. All rows and columns stay."""
    return documents.mapInArrow(_masker(mark), documents.schema)
