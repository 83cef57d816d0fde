"""Secret scanning: fixed patterns, then dictionary-primed compression novelty.

Base spans, per kind leftmost and non-overlapping: ``assign`` (a password, secret, token or API key with its value), ``access`` (access key ids), ``hex`` (long hexadecimal runs).

The novelty scan looks at every run of token characters of ``min_length`` or more that overlaps no base span and has a sensitive word shortly before it. A zstandard compressor is primed with a dictionary of identifiers and the text around the candidate; the candidate's marginal size is what it adds to the compressed size of nothing. Strings that mix letters with digits and stay incompressible are added as spans of kind ``novel``: at ``min_ratio`` compressed bytes a byte or more, or at what a random string of their length over their own alphabet needs, if that is less (``bound``). Other occurrences of the candidate's value are left out of the text around it, and a candidate that holds a novel string is novel too. Base spans are never removed.

Offsets are code points, end exclusive. Null counts as empty text; rows without spans have counts of zero and empty strings. Repeated rows give repeated output rows, an empty table none; columns other than those named are not looked at, and ``redact`` keeps them whatever their names. The time is in proportion to the text and its candidates, however many spans a text has.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import in_batches, table

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_HINTS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "novel")
#: Every long access or hex match lies within such a run, as their characters are among its characters.
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
SENSITIVE = re.compile(r"pass|pwd|secret|token|key|auth|cred|bearer|private|session|signature|salt|login|access", re.IGNORECASE | re.ASCII)
IDENTIFIERS = (
    "import return function class const static public private protected void string number boolean null true false self this "
    "config configuration settings environment variable default value name type index list array object result response request "
    "http https www localhost example com org net api v1 v2 id uuid user username email admin client server host port path url uri "
    "password passwd secret token access_key api_key authorization bearer credential private_key session signature login "
    "0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 00000000 11111111 12345678 deadbeef xxxxxxxx"
)

#: Alphabets of keys: hexadecimal, base32 (two kinds), letters of one case with digits, and letters with digits.
_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ONE_CASE = [_DIGITS + "ABCDEF", "234567" + _UPPER, _DIGITS + "ABCDEFGHJKMNPQRSTVWXYZ", _DIGITS + _UPPER]
ALPHABETS = [frozenset(x) for a in _ONE_CASE for x in (a, a.lower())] + [frozenset(_DIGITS + "abcdefABCDEF"), frozenset(_DIGITS + _UPPER + _LOWER)]


def base_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the base kinds; ``runs``: where RUN matches."""
    spans = []
    low = text.lower()
    if any(hint in low for hint in ASSIGN_HINTS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    for start, end in runs:
        if end - start >= 20 and "AKIA" in text[start:end]:
            spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text, start, end) if m.end() - m.start() >= 20]
        if end - start >= 24:
            spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text, start, end) if m.end() - m.start() >= 24]
    return sorted(spans)


def novelty(candidate: str, around: str, identifiers: str = IDENTIFIERS) -> float:
    """Marginal compressed bytes for each byte of ``candidate``, given identifiers and the text around it."""
    primed = zstandard.ZstdCompressionDict(f"{identifiers}\n{around}".encode("utf-8", "surrogatepass"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    compress = zstandard.ZstdCompressor(level=6, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False).compress
    raw = candidate.encode()
    return (len(compress(raw)) - len(compress(b""))) / max(1, len(raw))


def bound(candidate: str) -> float:
    """Compressed bytes a byte that random strings of this length over the candidate's alphabet reach: their entropy and the table of the code."""
    used = {c for c in candidate if c.isalnum()}
    size = min((len(a) for a in ALPHABETS if used <= a), default=62)
    return 0.985 * (math.log2(size) / 8 + (10 + size / 4) / max(1, len(candidate)))


def _without(text: str, value: str) -> str:
    return text.replace(value, " ")


def novel_spans(text: str, runs: list[tuple[int, int]], base: list[tuple[int, int, int]], min_ratio: float, context: int, around: int) -> list[tuple[int, int, int]]:
    open_, novel = [], set()
    starts = [a for a, _, _ in base]
    furthest = list(accumulate((b for _, _, b in base), max))  # the furthest end among the base spans so far
    for start, end in runs:
        run = text[start:end]
        before_end = bisect_left(starts, end)  # base spans that begin before the run ends
        if before_end and furthest[before_end - 1] > start or not any(c.isdigit() for c in run) or not any(c.isalpha() for c in run):
            continue
        before = text[max(0, start - context) : start].rpartition("\n")[2]
        if not SENSITIVE.search(before):
            continue
        value = max(run.split("="), key=len)
        value = value if len(value) >= 16 else run
        # wider by the value's length, so that no part of another occurrence stays at the edges
        near = _without(text[max(0, start - around - len(value)) : start], value)[-around:] + _without(text[end : end + around + len(value)], value)[:around]
        if novelty(run, near) >= min(min_ratio, bound(run)):
            novel.add(value)
        open_.append((start, end))
    if not novel:
        return []
    known = ahocorasick.Automaton()
    for value in novel:
        known.add_word(value, value)
    known.make_automaton()
    return [(start, 3, end) for start, end in open_ if any(True for _ in known.iter(text, start, end))]


def scan(text: str, min_length: int = 16, min_ratio: float = 0.8, context: int = 48, around: int = 1000) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and base and novel spans together, by start and kind. ``min_length`` is 16 at least."""
    runs = [m.span() for m in RUN.finditer(text)]
    base = base_spans(text, runs)
    return base, sorted(base + novel_spans(text, [r for r in runs if r[1] - r[0] >= min_length], base, min_ratio, context, around))


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_novel, base_sha256 and spans for each row; no shuffle."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_assign bigint, n_access bigint, n_hex bigint, n_novel bigint, base_sha256 string, spans string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, sha, spans = [[], [], [], []], [], []
            for text in batch.column(1).to_pylist():
                base, every = scan(text or "")
                for k in range(4):
                    counts[k].append(sum(s[1] == k for s in every))
                sha.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                spans.append(_joined(every))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(sha, pa.string()), pa.array(spans, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"])

    return in_batches(rows, run, schema)


def redact_text(text: str, replacement: str = "[REDACTED]") -> str:
    """``text`` with each span, or run of overlapping spans, replaced."""
    out, at = [], 0
    merged: list[list[int]] = []
    for a, _, b in scan(text)[1]:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    for a, b in merged:
        out += [text[at:a], replacement]
        at = b
    return "".join([*out, text[at:]]) if merged else text


def redact(df: DataFrame, text_col: str = "text", replacement: str = "[REDACTED]") -> DataFrame:
    """``df`` with the secrets in its texts replaced; null texts stay null, other columns stay as they are."""
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema])
    place = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            columns[place] = pa.array([None if t is None else redact_text(t, replacement) for t in columns[place].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return in_batches(df, run, schema)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    return find_secrets(table(spark, sf_dir, "documents"))
