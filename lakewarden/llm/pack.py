"""Best-fit packing by sums of squares.

Documents are tokenised where they lie; only lengths and places move. Pieces
are dealt into shards of a fixed expected size, so a shard's work does not grow
with the data. A shard places its pieces from the longest to the shortest, each
into the open sequence after which the sum, over all residual gaps, of the
squared number of open sequences with that gap is smallest; a new sequence is
opened only when the piece fits nowhere.
"""

from __future__ import annotations

import base64
import functools
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship, written

END_ID = 2

#: Pieces a shard has on average: memory and time of a task, whatever the input
SHARD_PIECES = 50_000


@functools.cache
def encoder(json_path: str | None = None, ranks_path: str | None = None, added: bool = False):
    """A function from text to token ids, loaded once per worker.

    Both files hold the same vocabulary. Texts whose characters lie below 256
    go through the faster library, all others through the one that reads the
    JSON file; the tests hold both against each other. With ``added`` the added
    tokens of the JSON file are found in texts, as its tokenizer does by
    default; texts that hold one go through that library as well.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(json_path or public_tokenizers.path("byte_bpe_50k.json"))
    slow.encode_special_tokens = not added
    apart = [t.content for t in slow.get_added_tokens_decoder().values()] if added else []
    with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if any(token in text for token in apart):
            return slow.encode(text, add_special_tokens=False).ids
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return slow.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def cuts(length: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full ones, but for the first."""
    first = length % size or min(length, size)
    starts = [0, *range(first, length, size)]
    return [(s, e - s) for s, e in zip(starts, [*starts[1:], length], strict=True)]


def tokenised(
    documents: DataFrame, id: str = "doc_id", text: str = "text", size: int = 1024, keep_ids: bool = False, **paths
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, and its ids if wanted."""
    ship(documents.sparkSession)
    own = documents.select(F.col(id).alias("id"), F.col(text).alias("text"))
    schema = T.StructType([
        T.StructField("id", own.schema["id"].dataType),
        *[T.StructField(n, T.LongType()) for n in ("piece", "start", "length", "ids_crc32")],
        *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if keep_ids else []),
    ])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(**paths, added=True)
        for batch in batches:
            rows, out = [], []
            for row, value in enumerate(batch.column("text")):
                ids = array("I", encode(value.as_py() or ""))
                ids.append(END_ID)
                for piece, (start, length) in enumerate(cuts(len(ids), size)):
                    part = ids[start : start + length]
                    rows.append(row)
                    out.append((piece, start, length, zlib.crc32(part), part.tolist() if keep_ids else None))
            columns = list(zip(*out, strict=True)) or [()] * 5
            arrays = [batch.column("id").take(pa.array(rows, pa.int64()))]
            arrays += [pa.array(c, pa.int64()) for c in columns[:4]]
            if keep_ids:
                arrays.append(pa.array(columns[4], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return own.mapInArrow(pieces, schema)


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sequence of each piece, from 0, and its offset there."""
    gaps = np.zeros(size + 1, np.int64)  # how many open sequences have this much room
    open_: list[list[int]] = [[] for _ in range(size + 1)]
    sequence, offset, n = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i in np.argsort(-lengths, kind="stable"):
        length = int(lengths[i])
        fits = np.flatnonzero(gaps[length:size])  # the room that would be left
        if fits.size:
            # the squares change by 2 * (to - from) + 2, and a filled sequence is no longer counted
            change = 2 * (np.where(fits > 0, gaps[fits], 0) - gaps[length + fits]) + np.where(fits > 0, 2, 1)
            left = int(fits[change.argmin()])
            gap = length + left
            gaps[gap] -= 1
            at = open_[gap].pop()
        else:
            gap, left, at, n = size, size - length, n, n + 1
        if left:
            gaps[left] += 1
            open_[left].append(at)
        sequence[i], offset[i] = at, size - gap
    return sequence, offset


def packed(
    documents: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    size: int = 1024,
    keep_ids: bool = False,
    shard_pieces: int = SHARD_PIECES,
    **paths,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32[, ids], sequence_id, offset.

    A document's tokens are those of its text and an end token; NULL and empty
    texts are the end token alone. An added token's content in a text, such as
    ``<|endoftext|>``, is that token. Only documents longer than ``size`` are cut;
    their first piece may be shorter. Repeated rows and ids are packed each by
    itself. An empty table gives no rows. Other columns are ignored.
    """
    pieces = tokenised(documents, id, text, size, keep_ids, **paths)
    pieces = written(pieces.withColumn("number", F.monotonically_increasing_id()), "pack-pieces")
    full = pieces.where(F.col("length") == size).withColumns(
        {"sequence_id": -1 - F.col("number"), "offset": F.lit(0).cast("bigint")}
    )
    part = pieces.where(F.col("length") < size)
    shards = max(1, -(-part.count() // shard_pieces))
    dealt = part.select("number", "length", F.pmod(F.xxhash64("number"), F.lit(shards)).cast("bigint").alias("shard"))

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("number", ignore_index=True)
        sequence, offset = sum_of_squares(rows["length"].to_numpy(), size)
        return pd.DataFrame({"number": rows["number"], "sequence_id": rows["shard"] * 2**32 + sequence, "offset": offset})

    placed = dealt.groupBy("shard").applyInPandas(place, "number bigint, sequence_id bigint, offset bigint")
    both = full.unionByName(part.join(placed, "number")).drop("number")
    return both.withColumnRenamed("id", id)


def sequences(documents: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per sequence: sequence_id, ids (at most ``size``), and the documents' pieces in it."""
    rows = packed(documents, id, text, keep_ids=True, **options)
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids", F.col(id).alias("id"), "piece", "length")))
    return rows.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id",
        F.flatten("parts.ids").alias("ids"),
        F.transform("parts", lambda p: p.dropFields("ids")).alias("parts"),
    )
