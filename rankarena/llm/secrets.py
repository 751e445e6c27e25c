"""Secret scan: keywords by an Aho-Corasick automaton, anchored patterns at its hits, then checksums.

A text is run through one automaton of all keywords, in lower case and as bytes. Only where a keyword begins is its
pattern tried, anchored there and never before the end of that kind's last match, which gives the leftmost matches that
don't overlap. Long hexadecimal runs have no keyword and are found by their byte class. Tokens that embed a checksum
(the last six characters are the CRC-32 of the thirty before, in base 62) count only if it is right.

Defined results: a null or empty text has no spans. Rows are treated one by one, so repeated rows and identifiers
repeat in the result. Spans count code points, with the end exclusive.
"""

import hashlib
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What counts as a secret.
BASE_KINDS = ("assign", "access", "hex")
CHECKED_KINDS = ("github", "npm")
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "api_key", "apikey"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
}
PATTERNS = {
    "assign": re.compile(
        rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE
    ),
    "access": re.compile(rb"AKIA[A-Z0-9]+"),
    "hex": re.compile(rb"[0-9a-f]{16,}"),
    "github": re.compile(rb"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"),
    "npm": re.compile(rb"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"),
}
ASSIGN_CHARS = 12
ACCESS_CHARS = 18
BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

KINDS = BASE_KINDS + CHECKED_KINDS
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
Span = tuple[int, int, int]


def checksum62(body: bytes) -> bytes:
    value, digits = zlib.crc32(body), []
    while value:
        value, digit = divmod(value, 62)
        digits.append(BASE62[digit])
    return bytes(reversed(digits)).rjust(6, b"0")


def _holds(kind: str, match: re.Match[bytes]) -> bool:
    if kind == "assign":
        return match.end(2) - match.start(2) >= ASSIGN_CHARS
    if kind == "access":
        return match.end() - match.start() >= ACCESS_CHARS
    return checksum62(match[1]) == match[2]


def automaton() -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for word in words:
            made.add_word(word, (kind, len(word)))
    made.make_automaton()
    return made


def byte_spans(data: bytes, keywords: ahocorasick.Automaton) -> list[Span]:
    """(start, place of the kind in ``KINDS``, end) in bytes, sorted."""
    found: list[Span] = []
    done = dict.fromkeys(KEYWORDS, 0)
    # Hits come by their ends. A kind's keywords never contain one another, so its hits also come by their starts.
    for last, (kind, length) in keywords.iter(data.translate(_LOWER).decode("latin-1")):
        start = last + 1 - length
        if start >= done[kind] and (match := PATTERNS[kind].match(data, start)):
            done[kind] = match.end()
            if _holds(kind, match):
                found.append((start, KINDS.index(kind), match.end()))
    place = KINDS.index("hex")
    found += [(m.start(), place, m.end()) for m in PATTERNS["hex"].finditer(data)]
    return sorted(found)


def code_point_spans(data: bytes, spans: list[Span]) -> list[Span]:
    if data.isascii():
        return spans
    places, at, count = {}, 0, 0
    for offset in sorted({x for start, _, end in spans for x in (start, end)}):
        count += len(data[at:offset].decode("utf-8"))
        at = offset
        places[offset] = count
    return [(places[start], kind, places[end]) for start, kind, end in spans]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keywords = automaton()
    struct = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        rows = []
        for text in batch.column("text").cast(pa.large_binary()):
            data = text.as_py() or b""
            spans = code_point_spans(data, byte_spans(data, keywords))
            rows.append([{"kind": KINDS[kind], "start": start, "end": end} for start, kind, end in spans])
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(rows, struct)], ["id", "spans"])


def secret_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The identifier and ``spans``, an array of (kind, start, end), by start and then kind."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(_scan, f"id {kind}, spans array<struct<kind: string, start: bigint, end: bigint>>")
    return found.withColumnRenamed("id", id_col)


def span_digest(spans: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, and all spans as one string."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))

    def joined(column):  # noqa: ANN001, ANN202
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):  # noqa: ANN202
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")

    return spans.select(
        *[c for c in spans.columns if c != "spans"],
        *[count(kind).alias(f"n_{kind}") for kind in BASE_KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def sha256_of(spans: list[Span]) -> str:
    """The digest of base spans, for use outside of Spark."""
    return hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans if k < len(BASE_KINDS)).encode()).hexdigest()
