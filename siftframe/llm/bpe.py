"""Byte-level BPE encoding by overlapping chunks, and decoding."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import add_columns, cut_text, materialize, text_or_empty, with_row_id
from .textvec import code_points, pretoken_starts

#: Code points of a chunk, and how far it reads into the next one. Texts up to one chunk are encoded where they are.
CHUNK, OVERLAP = 16_384, 1_024
#: The end of a chunk may cut a pre-token or hide what follows it; boundaries are trusted up to here before the end.
MARGIN = 4
#: A run of white space so long goes round the library's pattern engine, which gives up on a million.
LONG_RUN = 100_000


@lru_cache(maxsize=4)
def encoding(path: str):
    """The rank file at `path` as an encoding without special tokens; kept by each Python worker."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode_text(enc, text: str) -> np.ndarray:
    """The ids of a text. Texts with a very long run of white space are cut at pre-token boundaries first."""
    if len(text) < LONG_RUN:
        return enc.encode_to_numpy(text, disallowed_special=()).astype(np.int32)
    starts = pretoken_starts(code_points(text))
    if not len(starts) or np.diff(np.append(starts, len(text))).max() < LONG_RUN:
        return enc.encode_to_numpy(text, disallowed_special=()).astype(np.int32)
    ends = [*starts[1:].tolist(), len(text)]
    parts = [enc._encode_single_piece(text[a:b]) for a, b in zip(starts.tolist(), ends, strict=True)]
    return np.array([i for p in parts for i in p], dtype=np.int32)


def _encode(path: str, decoded: bool = False):
    def make():
        enc = encoding(path)

        def work(batch):
            ids = [encode_text(enc, t.as_py()) for t in batch.column("text")]
            return {"ids": ids} | ({"decoded": [enc.decode_bytes(x.tolist()) for x in ids]} if decoded else {})

        return work

    return make


IDS = {"ids": ("array<int>", lambda: pa.list_(pa.int32()))}
BYTES = {"decoded": ("binary", pa.binary)}


@lru_cache(maxsize=1)
def _spaces() -> np.ndarray:
    return np.array([c for c in range(0x3001) if chr(c).isspace()], dtype=np.uint32)


def _boundaries(chunk: int, overlap: int):
    """head and tail: places in the text, in the part that a chunk shares with the chunk before and after, where a
    pre-token begins right after something other than white space."""

    def work(batch):
        heads, tails = [], []
        for start, last, text in zip(*(batch.column(c).to_pylist() for c in ("start", "last", "chunk")), strict=True):
            cps = code_points(text)
            at = pretoken_starts(cps)
            at = at[at > 0]
            at = at[~np.isin(cps[at - 1], _spaces())]
            heads.append((at[at < overlap] + start).astype(np.int32))
            tails.append((at[:0] if last else at[(at >= chunk) & (at <= len(cps) - MARGIN)] + start).astype(np.int32))
        return {"head": heads, "tail": tails}

    return lambda: work


def cut_pieces(long: DataFrame, *, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(rid, doc_id, text) to (rid, doc_id, piece, text): pieces that begin and end where pre-tokens of the whole text
    do, so the ids of the pieces, joined, are those of the whole.

    Texts are cut into chunks that read `overlap` code points into the next one, and the chunks are dealt to all
    tasks. What a match of the pattern takes depends only on the text from its start on. So once two neighbours begin
    a match at the same place they agree from there on: the first such place in their shared part is the cut between
    them. Cuts after white space are not used, because the pattern looks one character past it. Neighbours that never
    agree (one word over the whole shared part) become one piece."""
    cut = F.posexplode(cut_text(F.col("text"), chunk, overlap)).alias("n", "chunk")
    chunks = long.select("rid", "doc_id", F.length("text").alias("len"), cut).withColumn("start", F.col("n") * chunk)
    chunks = chunks.select("rid", "doc_id", "n", "start", "len", (F.col("start") + chunk >= F.col("len")).alias("last"), "chunk")
    chunks = chunks.repartition(F.col("rid"), F.col("n"))
    ints = ("array<int>", lambda: pa.list_(pa.int32()))
    found = add_columns(chunks, ["rid", "doc_id", "n", "start", "len", "chunk"], _boundaries(chunk, overlap), {"head": ints, "tail": ints})
    chunks = materialize(found, "chunks")

    before = chunks.select("rid", (F.col("n") + 1).alias("n"), F.col("tail").alias("before"))
    cuts = chunks.select("rid", "n", "start", "len", "head").join(before, ["rid", "n"], "left")
    cuts = cuts.withColumn("cut", F.when(F.col("n") == 0, 0).otherwise(F.array_min(F.array_intersect("head", "before"))))
    order = Window.partitionBy("rid").orderBy("n")
    cuts = cuts.select("rid", "n", "cut", F.lead("cut").over(order).alias("next"), F.lead("start").over(order).alias("after"), "start", "len", F.count("cut").over(order).alias("piece"))
    whole = F.col("cut").isNotNull() & (F.col("next").isNotNull() | F.col("after").isNull())
    cuts = cuts.select("rid", "n", "piece", whole.alias("whole"), F.coalesce("cut", "start").alias("from"), F.coalesce("next", "after", "len").alias("to"))
    sliced = chunks.select("rid", "doc_id", "n", "start", "chunk").join(cuts, ["rid", "n"])
    text = F.substring(F.col("chunk"), F.col("from") - F.col("start") + 1, F.col("to") - F.col("from"))
    sliced = sliced.select("rid", "doc_id", "n", "piece", "whole", text.alias("text"))
    alone = sliced.where("whole").select("rid", "doc_id", "piece", "text")
    parts = F.sort_array(F.collect_list(F.struct("n", "text")))
    joined = sliced.where("not whole").groupBy("rid", "doc_id", "piece").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("text"))
    return alone.unionByName(joined)


def encode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP, decoded: bool = False) -> DataFrame:
    """(doc_id, ids array<int>), and with `decoded` what decode makes of the ids, in the same pass: the ids of each whole
    text under the rank file at `path`, each match of the public pattern encoded separately, without special tokens.

    A null text counts as empty and has no ids; repeated rows and ids come out as often as they go in; an empty table
    gives an empty result. Texts up to `chunk` code points are encoded in place, without a shuffle; longer ones by
    cut_pieces, whose pieces are encoded in parallel and joined in order. The most that is held at once is one text."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(F.col(text_col)).alias("text"))
    short = add_columns(rows.where(F.length("text") <= chunk), ["doc_id"], _encode(path, decoded), IDS | (BYTES if decoded else {}))
    long = with_row_id(rows.where(F.length("text") > chunk), "rid")
    pieces = add_columns(cut_pieces(long, chunk=chunk, overlap=overlap), ["rid", "doc_id", "piece"], _encode(path), IDS)
    parts = F.sort_array(F.collect_list(F.struct("piece", "ids")))
    joined = pieces.groupBy("rid", "doc_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))
    joined = joined.select("doc_id", "ids")
    return short.unionByName(decode(joined, path) if decoded else joined)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """encoded with a binary column `decoded` (a column of that name is replaced): the bytes of each id, joined. Ids
    outside the vocabulary raise an error; null ids count as none."""

    def make():
        enc = encoding(path)
        return lambda batch: {"decoded": [enc.decode_bytes(x.values.to_numpy(zero_copy_only=False).tolist() if x.is_valid else []) for x in batch.column(ids_col)]}

    rows = encoded.drop("decoded")
    return add_columns(rows, rows.columns, make, BYTES)
