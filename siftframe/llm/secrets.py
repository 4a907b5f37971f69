"""Secret scans: patterns, and a token-efficiency test for random strings."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoding
from .common import add_columns, text_or_empty

# The base patterns, with the length that a match (for assign: its group 2) needs, in listed order.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)
#: Runs that the method looks at, and the most characters a token that still counts as random. Prose in the languages
#: of the vocabulary has 3 to 5 characters a token, made-up words 2 to 3, base64 and hexadecimal keys 1.2 to 1.9.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
MOST_CHARS_A_TOKEN = 2.0
#: Digests by the lengths of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512 in hexadecimal; UUIDs; and names: parts
#: of one case, or capitalised, joined by _ - or /, with at most a short number at their ends.
DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64})\Z")
UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}\Z")
NAME = re.compile(r"[_/+=-]*(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4})(?:[_/+=-]+(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4}))*[0-9]{0,4}[_/+=-]*\Z")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end) of the base patterns' matches, leftmost and non-overlapping within a kind."""
    out = []
    for k, (kind, pattern, group, least) in enumerate(BASE):
        if kind == "hex":  # maximal runs: those long enough are found directly
            pattern = _LONG_HEX
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                out.append((m.start(), k, m.end()))
    return out


_LONG_HEX = re.compile(r"[0-9a-f]{24,}")


def random_spans(text: str, enc, most: float = MOST_CHARS_A_TOKEN) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the runs that take so many tokens that they are no language: at most `most` characters a
    token, neither all digits nor all signs, and neither a known digest nor an identifier."""
    out = []
    for m in RUN.finditer(text):
        run = m.group()
        if run.isdigit() or not any(c.isalnum() for c in run) or DIGEST.match(run) or UUID.match(run) or NAME.match(run):
            continue
        if len(run) <= most * len(enc.encode_ordinary(run)):
            out.append((m.start(), len(BASE), m.end()))
    return out


def _scan(path: str, most: float):
    names = [k for k, *_ in BASE] + ["random"]

    def make():
        enc = encoding(path)

        def work(batch):
            found = []
            for text in batch.column("text").to_pylist():
                spans = sorted(base_spans(text) + random_spans(text, enc, most))
                found.append([{"kind": names[k], "start": a, "end": b} for a, k, b in spans])
            return {"spans": found}

        return work

    return make


def _span_type():
    return pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def scan_secrets(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", most: float = MOST_CHARS_A_TOKEN) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>) for every row, in code points, end exclusive, by start and then
    kind in the order assign, access, hex, random.

    The first three are plain patterns. `random` spans are the method's: runs of at least 20 characters of the base64
    and URL alphabets whose characters a token under the rank file at `path` are at most `most`. They may overlap a
    base span, which stays. A null or empty text has no spans; repeated rows come out as often as they go in; an empty
    table gives an empty result. One pass over the rows, without a shuffle."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(F.col(text_col)).alias("text"))
    return add_columns(rows, ["doc_id"], _scan(path, most), {"spans": ("array<struct<kind:string,start:int,end:int>>", _span_type)})


def spans_text(spans):
    """kind:start:end, comma-joined."""
    one = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")
