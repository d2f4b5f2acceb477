"""Packing of token sequences: first-fit decreasing with a tournament tree of bin capacities, in randomised groups.

One narrow pass tokenises every whole text and cuts its ids into pieces of at most `capacity`: whole ones and a rest.
Only the pieces' six numbers are shuffled, into groups drawn by a hash of (id, start), so that a source, a family of
copies or one giant document spreads over all groups. A group is packed alone; its size follows from a count of the
input and so stays bounded at any scale.

Edge cases: a null text counts as empty (its one piece is the closing id), a null id is kept as null, repeated rows are
packed each for itself, ties in length are broken by id and start, an empty table gives no rows, and columns other
than the id and the text are ignored whatever their names.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import sliced

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: A group holds about so many rest pieces, and about so many bytes of text.
GROUP_DOCS, GROUP_BYTES = 2048, 16 << 20
_encoders: dict = {}


def encoder(name: str):
    """A function from texts to lists of ids, as the `tokenizers` file gives them without special tokens added.

    Where the same vocabulary lies beside it as ranks, these drive the faster library; the ids are the same (tested)."""
    if name not in _encoders:
        import os

        import public_tokenizers as P

        ranks_file = P.path(name.replace(".json", ".tiktoken"))
        if os.path.exists(ranks_file):
            import base64

            import tiktoken

            with open(ranks_file, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            one = tiktoken.Encoding(name, pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})
            _encoders[name] = lambda texts: [one.encode(t, allowed_special="all") for t in texts]
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            full = Tokenizer.from_file(P.path(name))
            _encoders[name] = lambda texts: [e.ids for e in full.encode_batch_fast(list(texts), add_special_tokens=False)]
    return _encoders[name]


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size; sizes must come in falling order.

    The tree's leaves are the bins' free room from left to right and each inner node holds the larger of its children,
    so the leftmost bin with room is found, and the tree mended, in log(n) steps."""
    n = len(sizes)
    leaves = 1 << max(0, (max(n, 1) - 1).bit_length())
    tree = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, size in enumerate(sizes.tolist()):
        at = 1
        while at < leaves:
            at *= 2
            if tree[at] < size:
                at += 1
        bins[i], offsets[i] = at - leaves, capacity - tree[at]
        tree[at] -= size
        while at > 1:
            at //= 2
            left, right = tree[2 * at], tree[2 * at + 1]
            tree[at] = left if left > right else right
    return bins, offsets


def pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, tokenizer: str, end_id: int) -> DataFrame:
    """One row for each piece of each document."""

    def cut(batches):
        encode = encoder(tokenizer)
        for batch in sliced(batches, 1):
            rows: list[list] = [[], [], [], [], []]
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for lo in range(0, len(ids), 512):
                part = [t or "" for t in texts.slice(lo, 512).to_pylist()]
                for doc, tokens in zip(ids[lo : lo + 512], encode(part)):
                    tokens.append(end_id)
                    raw, n = np.array(tokens, "<u4").tobytes(), len(tokens)
                    for start in range(0, n, capacity):
                        size = min(capacity, n - start)
                        for column, value in zip(rows, (doc, start, size, zlib.crc32(raw[4 * start : 4 * (start + size)]), n)):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut, PIECE)


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0, seed: int = 11) -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one for each piece.

    sequence_id is the group's number times 2^32 plus the bin's number in its group."""
    count, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string"))), F.lit(0))).first()
    groups = max(1, math.ceil(count / GROUP_DOCS), math.ceil(size / GROUP_BYTES))

    def place(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable", na_position="first")
        bins, offsets = first_fit_decreasing(pdf["length"].to_numpy(), capacity)
        return pdf.assign(sequence_id=(int(key[0]) << 32) + bins, offset=offsets)[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    cut = pieces(docs, id_col, text_col, capacity, tokenizer, end_id)
    # the row's number too, so that repeated or missing ids and equal texts spread
    drawn = cut.withColumn("group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id(), F.lit(seed)), F.lit(groups)))
    return drawn.groupBy("group").applyInPandas(place, PIECE + ", sequence_id long, offset long")
