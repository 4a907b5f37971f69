"""Token counts with a whole-token shortcut."""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import cut_pieces
from .common import add_columns, text_or_empty, with_row_id
from .textvec import END, code_points, groups_of, hash_spans, pretoken_starts

#: Pre-tokens whose counts a Python worker remembers before it starts afresh.
REMEMBER = 500_000
LIMIT = 512
#: Code points of a text that is counted where it is. Longer ones are cut into chunks that read OVERLAP into the next one.
LONG, CHUNK, OVERLAP = 1 << 20, 1 << 17, 1 << 12


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """The tokenizer at `path` without truncation and padding; kept by each Python worker."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def special_strings(path: str) -> list[str]:
    """Added strings that the library takes out of a text before it splits it. Only plain ones are handled."""
    with open(path, encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]
    if any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in added) or len(added) > 1:
        raise ValueError("this tokenizer's added tokens take more than their own string")
    return [a["content"] for a in added]


def _bytes_of_letters() -> dict[str, int]:
    """The usual byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def prove_whole_tokens(path: str) -> np.ndarray:
    """Sorted hashes of the vocabulary strings that the tokenizer, given the string alone, encodes as one token.

    This runs once, before any document is read; its size is bounded by the vocabulary. A pre-token that is such a
    string counts one, because pre-tokens are merged each by itself. Strings that are no whole UTF-8 cannot be a
    pre-token and are left out; strings that begin a second pre-token are never looked up."""
    t, letters, special = tokenizer(path), _bytes_of_letters(), set(special_strings(path))
    texts = []
    for s in t.get_vocab(with_added_tokens=False):
        if s in special:
            continue
        try:
            texts.append(bytes(letters[c] for c in s).decode("utf-8"))
        except (KeyError, UnicodeDecodeError):
            continue
    alone = [s for s, e in zip(texts, t.encode_batch(texts, add_special_tokens=False), strict=True) if len(e.ids) == 1]
    buf = "".join(alone).encode("utf-32-le")
    lens = np.array([4 * len(s) for s in alone])
    return np.sort(hash_spans(buf, np.cumsum(lens) - lens, lens))


def count_group(texts: list[str], path: str, whole: np.ndarray, special: list[str], known: dict[int, int]) -> list[int]:
    """Token counts of a bounded group of texts."""
    parts, extra, pieces = [], [], []
    for t in texts:
        split = t.split(special[0]) if special else [t]
        extra.append(len(split) - 1)
        pieces.append(len(split))
        for s in split:
            parts += [code_points(s), np.array([END], dtype="<u4")]
    cps = np.concatenate(parts)
    starts = pretoken_starts(cps)
    ends = np.append(starts[1:], len(cps))
    stop = cps[starts] == END
    owner = np.repeat(np.arange(len(texts)), pieces)[np.minimum(np.cumsum(stop) - stop, sum(pieces) - 1)]
    starts, ends, owner = starts[~stop], ends[~stop], owner[~stop]
    h = hash_spans(cps.tobytes(), starts * 4, (ends - starts) * 4)
    one = whole[np.minimum(np.searchsorted(whole, h), len(whole) - 1)] == h if len(whole) else np.zeros(len(h), dtype=bool)
    total = np.bincount(owner[one], minlength=len(texts))
    starts, ends, owner, h = starts[~one], ends[~one], owner[~one], h[~one]
    distinct, first, back = np.unique(h, return_index=True, return_inverse=True)
    if len(known) > REMEMBER:
        known.clear()
    new = [k for k in range(len(distinct)) if int(distinct[k]) not in known]
    if new:
        raw = [cps[starts[first[k]] : ends[first[k]]].tobytes().decode("utf-32-le", "surrogatepass") for k in new]
        for k, e in zip(new, tokenizer(path).encode_batch(raw, add_special_tokens=False), strict=True):
            known[int(distinct[k])] = len(e.ids)
    counts = np.array([known[int(x)] for x in distinct], dtype=np.int64)
    if len(h):
        total = total + np.bincount(owner, weights=counts[back], minlength=len(texts)).astype(np.int64)
    return (total + np.array(extra)).tolist()


def _count(path: str, whole, special: list[str], group: int):
    """whole is a broadcast variable: an executor gets the proven strings once, not with each task."""

    def make():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        known: dict[int, int] = {}

        def work(batch):
            texts, counts = batch.column("text").to_pylist(), []
            for a, b in groups_of(texts, group):
                counts += count_group(texts[a:b], path, whole.value, special, known)
            return {"n_tokens": counts}

        return work

    return make


def _pieces(long: DataFrame, special: list[str], chunk: int, overlap: int) -> DataFrame:
    """(row, piece text) of long texts: the stretches between special strings, each cut where pre-tokens of it begin.

    row is (rid, doc_id, n_bytes, special strings in the text); each stretch is a text of its own to cut_pieces."""
    stretches = F.split("text", re.escape(special[0])) if special else F.array("text")
    rows = with_row_id(long, "rid").withColumn("stretches", stretches)
    row = F.struct("rid", "doc_id", "n_bytes", (F.size("stretches") - 1).cast("long").alias("n_special"))
    rows = rows.select(row.alias("doc_id"), F.explode("stretches").alias("text"))
    return cut_pieces(with_row_id(rows, "rid"), chunk=chunk, overlap=overlap).select(F.col("doc_id").alias("row"), "text")


def count_tokens(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", group: int = 1 << 18, long: int = LONG, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for every row: tokens of the whole text under the byte-level tokenizer at `path`, as
    its library counts them, with its special strings taken as special tokens and none added.

    Pre-tokens are found in vectors. Those that are a proven whole token count one after a lookup; the distinct ones
    among the rest are merged by the library and remembered. A null text counts as empty: 0 bytes, 0 tokens. Repeated
    rows come out as often as they go in; an empty table gives an empty result.

    Texts up to `long` code points are counted in one pass without a shuffle; a worker holds one batch, one group of
    texts and a bounded memory of counts. Longer ones are taken apart at special strings and cut into chunks, which are
    dealt to all tasks and stitched where both of two neighbours begin a pre-token (see cut_pieces); their counts are
    added up. So no task makes arrays of a whole text, unless one word goes on for all of it."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(F.col(text_col)).alias("text"))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))
    whole, special = docs.sparkSession.sparkContext.broadcast(prove_whole_tokens(path)), special_strings(path)
    field = {"n_tokens": ("long", pa.int64)}
    short = add_columns(rows.where(F.length("text") <= long), ["doc_id", "n_bytes"], _count(path, whole, special, group), field)
    pieces = _pieces(rows.where(F.length("text") > long), special, chunk, overlap)
    counted = add_columns(pieces, ["row"], _count(path, whole, special, group), field).groupBy("row").agg(F.sum("n_tokens").alias("n_tokens"))
    return short.unionByName(counted.select("row.doc_id", "row.n_bytes", (F.col("n_tokens") + F.col("row.n_special")).alias("n_tokens")))
