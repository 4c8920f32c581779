"""Secret scans: an Aho-Corasick keyword pass, regular expressions anchored at the hits, checksums inside the tokens.

One automaton finds every keyword in a text (letters in either case). Each kind's expression is then tried only where its
keyword starts. A run of hexadecimal digits has no keyword; its expression runs over the text. Tokens with a built-in check
(CRC-32 in base 62, a JSON header, a base 64 body) count only when the check holds.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartspark.llm import arrays

#: Kinds in their order; the first three are the base.
KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "pem")

# fixed values: keyword of each kind, and the expression tried where it starts
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
    "jwt": ("eyj",),
    "pem": ("-----begin ",),
}
EXPRESSIONS = {
    "assign": re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "github": re.compile(r"gh[pousr]_([A-Za-z0-9]{36})(?![A-Za-z0-9])"),
    "npm": re.compile(r"npm_([A-Za-z0-9]{36})(?![A-Za-z0-9])"),
    "jwt": re.compile(r"(eyJ[A-Za-z0-9_-]++)\.([A-Za-z0-9_-]++)\.([A-Za-z0-9_-]++)"),
    "pem": re.compile(r"-----BEGIN ([A-Z ]*PRIVATE KEY)-----([A-Za-z0-9+/=\s]++)-----END \1-----"),
}
#: The first run of a token in three parts: where a try fails behind it, all later tries within the run fail there too.
_RUN = re.compile(r"[A-Za-z0-9_-]++")
_HEX = re.compile(r"[0-9a-f]{24,}")
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_ASCII_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}

_SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def crc_in_base_62(body: str) -> bool:
    """The last six characters are the CRC-32 of those before, in base 62."""
    value = zlib.crc32(body[:-6].encode())
    digits = ""
    for _ in range(6):
        value, rest = divmod(value, 62)
        digits = _DIGITS[rest] + digits
    return digits == body[-6:]


def _json_header(match: re.Match) -> bool:
    try:
        header = json.loads(base64.urlsafe_b64decode(match[1] + "=" * (-len(match[1]) % 4)))
    except (binascii.Error, ValueError, RecursionError):  # the last for a header nested too deep to be one
        return False
    return isinstance(header, dict) and "alg" in header


def _base_64_body(match: re.Match) -> bool:
    try:
        return len(base64.b64decode("".join(match[2].split()), validate=True)) > 0
    except (binascii.Error, ValueError):
        return False


CHECKS = {
    "assign": lambda match: len(match[1]) >= 6,
    "access": lambda match: len(match[0]) >= 20,
    "github": lambda match: crc_in_base_62(match[1]),
    "npm": lambda match: crc_in_base_62(match[1]),
    "jwt": _json_header,
    "pem": _base_64_body,
}


def _automaton():
    import ahocorasick

    cache = arrays.worker_cache("secrets")
    if "secret keywords" not in cache:
        machine = ahocorasick.Automaton()
        for kind, words in KEYWORDS.items():
            for word in words:
                machine.add_word(word, (kind, len(word)))
        machine.make_automaton()
        cache["secret keywords"] = machine
    return cache["secret keywords"]


def spans_of(text: str, machine) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of what is found, ordered; matches of one kind don't overlap."""
    low = text.lower()
    if len(low) != len(text):  # a letter whose lower case is longer would move the places
        low = text.translate(_ASCII_LOWER)
    found = []
    free: dict[str, int] = {}
    hits = sorted((end - size + 1, kind) for end, (kind, size) in machine.iter(low))
    for start, kind in hits:
        if start < free.get(kind, 0):
            continue
        match = EXPRESSIONS[kind].match(text, start)
        if match is None:
            if kind == "jwt":
                free[kind] = _RUN.match(text, start).end()
            continue
        free[kind] = match.end()
        if CHECKS[kind](match):
            found.append((start, KINDS.index(kind), match.end()))
    found += [(m.start(), KINDS.index("hex"), m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


@F.arrow_udf(_SPANS)
def _found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    machine = _automaton()
    for texts in batches:
        rows = []
        for piece in arrays.pieces(texts):
            for text in piece.to_pylist():
                rows.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans_of(text or "", machine)])
        yield pa.array(rows, _ARROW_SPANS)


def secret_spans(text: str | Column) -> Column:
    """array<struct<kind, start, end>> of a text column, by start, then kind; code points, end exclusive; null is empty."""
    return _found.asNondeterministic()((F.col(text) if isinstance(text, str) else text).cast("string"))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, spans. Null and empty texts have no spans; repeated rows are scanned each; other columns are ignored."""
    return docs.select(F.col(doc_id).alias("doc_id"), secret_spans(F.col(text)).alias("spans"))


def redact(docs: DataFrame, text: str = "text", mark: str = "*") -> DataFrame:
    """docs with each found character of the texts replaced by the mark; lengths stay."""

    @F.arrow_udf(T.StringType())
    def hidden(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for value, cuts in zip(texts.to_pylist(), spans.to_pylist()):
            for cut in cuts or []:
                value = value[: cut["start"]] + mark * (cut["end"] - cut["start"]) + value[cut["end"] :]
            out.append(value)
        return pa.array(out, pa.string())

    own = arrays.fresh_name(docs, "spans")
    return docs.withColumn(own, secret_spans(text)).withColumn(text, hidden(F.col(text).cast("string"), F.col(own))).drop(own)
