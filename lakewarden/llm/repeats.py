"""Removal of long repeated passages, over UTF-8 bytes.

Every string of ``length`` bytes has a home: the least hash among its runs of
``GRAM`` bytes. Equal strings have equal homes, so a home's hash tells where
they meet, and only homes that two documents share are looked at further. Texts
lie in chunks; a chunk sends each hash and each passage once, however many of
its documents hold it, and gets bits back.

Where passages meet, their suffixes are sorted so that those that agree in
``length`` bytes are one run; the run's least document is kept as its sample,
and each passage's strings are matched against the samples: a string is a repeat
if its run's sample is a smaller document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import shared_folder
from .common import arrow_bytes, hinted, ship, written

GRAM = 16
#: Bytes of text in a chunk, and bytes of all texts for each part that passages are dealt to
CHUNK_BYTES, PART_BYTES = 4_000_000, 8_000_000
#: Answers up to this size go to all chunks; beyond it chunks and answers are shuffled
BROADCAST_BYTES = 64_000_000
#: A home that chunks hold more often, all together, is spread by the bytes beside it, and one so many times as often by
#: whole strings, so no part gets all of its passages. At 80 bytes a passage 20,000 are a small share of a part; less would
#: only send more: a passage has one or two spread pieces of some 60 bytes, but 18 strings of 50 bytes.
HOT_CHUNKS, SPREAD = 20_000, 32
#: Passages that are copied out of a chunk at a time, passages that are compared at a time, and strings or bytes that are
#: looked at at a time: an executor's Python holds few times as much beside the texts, however much of them repeats
SLICE, ROWS, STRINGS = 16_384, 131_072, 524_288
#: Bytes that Spark sends to Python at once; a chunk is more and goes by itself
BATCH_BYTES = 1_000_000

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD)


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position that has them, as one number, the first byte highest; a view."""
    return np.ndarray((max(len(data) - 7, 0),), ">u8", np.ascontiguousarray(data), strides=(1,))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * _A
    x ^= x >> np.uint64(32)
    x *= _C
    x ^= x >> np.uint64(29)
    return x


class Homes:
    """The homes in a chunk, in order: their hash, and the first and last string that each is home of."""

    def __init__(self, data: bytes, sizes: np.ndarray, length: int):
        self.raw, self.sizes, self.length = np.frombuffer(data, np.uint8), sizes, length
        self.ends = np.cumsum(sizes)
        found = [self._between(a, min(a + STRINGS, len(self.raw) - length + 1)) for a in range(0, len(self.raw) - length + 1, STRINGS)]
        found = [x for x in found if len(x[0])]
        for one, two in zip(found[:-1], found[1:], strict=True):
            if one[3][-1] == two[3][0]:  # a home of strings of both: all are counted to the latter
                two[1][0] = one[1][-1]
                for at, column in enumerate(one):
                    one[at] = column[:-1]
        empty = [np.zeros(0, t) for t in (np.uint64, *[np.int64] * 3)]
        self.hash, self.first, self.last, self.gram = (np.concatenate(x) for x in zip(empty, *found, strict=True))
        self.doc = np.searchsorted(self.ends, self.first, side="right")

    def _between(self, begin: int, end: int) -> list[np.ndarray]:
        """Hash, first and last string, and place of the homes of the strings that start there."""
        length, width = self.length, self.length - GRAM + 1
        eights = _eights(self.raw[begin : end + length - 1])
        least = _mixed(eights[:-8] ^ _mixed(eights[8:] + _B))
        hashes, where = least, np.arange(len(least), dtype=np.int32)
        reach = 1
        while reach < width:  # the least of twice as many, the leftmost if equal
            step = min(reach, width - reach)
            right = least[step:] < least[:-step]
            least, where = np.where(right, least[step:], least[:-step]), np.where(right, where[step:], where[:-step])
            reach += step
        place = np.arange(begin, end)
        starts = np.flatnonzero(place + length <= self.ends[np.searchsorted(self.ends, place, side="right")])
        home = where[starts]
        new = np.flatnonzero(np.concatenate([[True], home[1:] != home[:-1]]))[: len(home)]
        lasts = np.concatenate([new[1:], [len(starts)]])[: len(new)] - 1
        return [hashes[home[new]], starts[new] + begin, starts[lasts] + begin, home[new].astype(np.int64) + begin]

    def keys(self, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Part and fingerprint of each distinct hash as one sorted number; of which each home is; whether in two documents; homes."""
        key = (self.hash >> np.uint64(32)) % np.uint64(parts) << np.uint64(32) | (self.hash & np.uint64(0xFFFFFFFF))
        order = np.argsort(key, kind="stable")
        ordered, docs = key[order], self.doc[order]
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]])[: len(ordered)]
        starts = np.flatnonzero(new)
        of = np.empty(len(key), np.int64)
        of[order] = np.cumsum(new) - 1
        ends = np.concatenate([starts[1:], [len(ordered)]])[: len(starts)]
        return ordered[starts], of, docs[starts] != docs[ends - 1], ends - starts

    def _spread(self, eights: np.ndarray, begin: np.ndarray, span: int, parts: int) -> np.ndarray:
        """Parts by the ``span`` bytes from each place."""
        own = np.zeros(len(begin), np.uint64)
        for step in [*range(0, span - 8, 8), span - 8]:
            own = _mixed(own ^ eights[begin + step])
        return (own % np.uint64(parts)).astype(np.int64)

    def passages(self, ids: np.ndarray, parts: int, shared: np.ndarray, hot: np.ndarray, hottest: np.ndarray) -> dict[str, np.ndarray]:
        """The distinct passages of shared homes by part, and the occurrences of each."""
        _, of, _, _ = self.keys(parts)
        at = np.flatnonzero(shared[of])
        first, last, doc, gram = self.first[at], self.last[at], self.doc[at], self.gram[at]
        part = ((self.hash[at] >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
        spread, single = hot[of[at]], hottest[of[at]]
        if spread.any():
            eights = _eights(self.raw)
            # each string holds its gram with this many bytes before it, or else more bytes behind it
            before = (self.length - GRAM) // 2
            one, two = np.flatnonzero(spread & ~single & (first <= gram - before)), np.flatnonzero(spread & ~single & (last > gram - before))
            every = np.flatnonzero(single)  # each string by itself, dealt by its own bytes
            count = last[every] - first[every] + 1
            begin = np.repeat(first[every], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            taken = np.concatenate([np.flatnonzero(~spread), one, two, np.repeat(every, count)])
            firsts = [first[~spread], first[one], np.maximum(first[two], gram[two] - before + 1), begin]
            lasts = [last[~spread], np.minimum(last[one], gram[one] - before), last[two], begin]
            dealt = [
                part[~spread], self._spread(eights, gram[one] - before, GRAM + before, parts),
                self._spread(eights, gram[two], self.length - before + 1, parts), self._spread(eights, begin, self.length, parts),
            ]
            first, last, part, doc = np.concatenate(firsts), np.concatenate(lasts), np.concatenate(dealt), doc[taken]
        size = last - first + self.length
        one, inverse = self._distinct(first, size, part)
        owner = np.full(len(one), np.iinfo(np.int64).max)
        np.minimum.at(owner, inverse, ids[doc])
        return {"first": first, "size": size, "id": ids[doc], "of": inverse, "one": one, "owner": owner,
                "part": part[one], "sizes": size[one]}

    def _rows(self, first: np.ndarray, size: np.ndarray, part: np.ndarray) -> np.ndarray:
        """Part, size and bytes of each passage, as one value that sorts by them."""
        widest = 2 * self.length
        column = np.arange(widest)
        table = np.zeros((len(first), widest + 16), np.uint8)
        for start in range(0, len(first), SLICE):
            some = slice(start, start + SLICE)
            place = np.minimum(first[some, None] + column, len(self.raw) - 1)
            table[some, 16:] = np.where(column < size[some, None], self.raw[place], 0)
        table[:, :8] = part.astype(">u8").view(np.uint8).reshape(-1, 8)
        table[:, 8:16] = size.astype(">u8").view(np.uint8).reshape(-1, 8)
        return table.view(f"V{widest + 16}").ravel()

    def _distinct(self, first: np.ndarray, size: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first of each distinct passage, in order of part, size and bytes; of which one each passage is."""
        by_part = np.argsort(part, kind="stable")
        ends = np.flatnonzero(np.concatenate([np.diff(part[by_part]) != 0, [True]]))[: len(part)] + 1
        ones, inverse, begin, known = [by_part[:0]], np.empty(len(part), np.int64), 0, 0
        while begin < len(part):  # whole parts, as many as are few passages, or one
            end = ends[max(np.searchsorted(ends, begin + ROWS, side="right") - 1, np.searchsorted(ends, begin, side="right"))]
            held, of = [], []
            for start in range(begin, end, ROWS):
                some = by_part[start : min(start + ROWS, end)]
                rows, one, own = np.unique(self._rows(first[some], size[some], part[some]), return_index=True, return_inverse=True)
                of.append(own + sum(len(x) for x, _ in held))
                held.append((rows, some[one]))
            rows, one = (np.concatenate(x) for x in zip(*held, strict=True))
            if len(held) > 1:
                _, at, own = np.unique(rows, return_index=True, return_inverse=True)
                one, of = one[at], [own[x] for x in of]
            inverse[by_part[begin:end]] = np.concatenate(of) + known
            ones.append(one)
            begin, known = end, known + len(one)
        return np.concatenate(ones), inverse


def _chunks(documents: DataFrame, chunk_bytes: int) -> DataFrame:
    """(chunk, ids, sizes, data), written."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, data, held = [], [], [], 0

        def row():
            return pa.RecordBatch.from_arrays(
                [pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())), pa.array([b"".join(data)], pa.binary())],
                names=["ids", "sizes", "data"],
            )

        for batch in batches:
            for id_, text in zip(batch.column("id"), batch.column("text"), strict=True):
                body = text.as_py().encode()
                ids.append(id_.as_py())
                sizes.append(len(body))
                data.append(body)
                held += len(body)
                if held >= chunk_bytes:
                    yield row()
                    ids, sizes, data, held = [], [], [], 0
        if ids:
            yield row()

    rows = documents.select("id", "text").mapInArrow(gather, "ids array<bigint>, sizes array<bigint>, data binary")
    rows = rows.withColumn("chunk", F.monotonically_increasing_id())
    path = shared_folder(documents.sparkSession, "repeat-chunks")
    rows.write.option("compression", "zstd").parquet(path)
    return documents.sparkSession.read.schema(rows.schema).parquet(path)


def _opened(row, length: int) -> tuple[Homes, np.ndarray]:
    return Homes(row["data"], np.asarray(row["sizes"], np.int64), length), np.asarray(row["ids"], np.int64)


def _bits(masks, counts: np.ndarray) -> np.ndarray:
    """The bits of all parts in order; ``counts`` says how many each part has."""
    return np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=n).astype(bool) for m, n in zip(masks, counts, strict=True)] or [np.zeros(0, bool)])


def _answers(rows: DataFrame, columns: list[str], purpose: str, broadcast_bytes: int) -> DataFrame:
    """The answers of all parts to a chunk, in the parts' order; one row per chunk, of at most one bit per home."""
    answer = F.sort_array(F.collect_list(F.struct("part", *columns)))
    grouped = rows.groupBy("chunk").agg(answer.alias("a")).select("chunk", *[F.col("a")[c].alias(c) for c in columns])
    answers = written(grouped, purpose)
    sizes = [F.aggregate(c, F.lit(0).cast("bigint"), lambda total, x: total + F.octet_length(x)) for c in columns]
    total = answers.agg(F.sum(sum(sizes[1:], sizes[0]))).first()[0] or 0
    return F.broadcast(answers) if total <= broadcast_bytes else answers


def _shared_homes(chunks: DataFrame, length: int, parts: int, hot_chunks: int, broadcast_bytes: int) -> DataFrame:
    """(chunk, shared, hot, hottest): bits for the distinct hashes of each part."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, row in batch.iterrows():
                homes, _ = _opened(row, length)
                key, _, twice, homes_of = homes.keys(parts)
                note = (np.ceil(np.log2(homes_of)).astype(np.uint8) << np.uint8(1)) | twice  # the count up to a factor of two
                part = (key >> np.uint64(32)).astype(np.int64)
                print_ = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                names, starts = np.unique(part, return_index=True)
                ends = np.concatenate([starts[1:], [len(part)]])[: len(starts)]
                yield pd.DataFrame({
                    "part": names, "chunk": row["chunk"],
                    "prints": [print_[s:e].tobytes() for s, e in zip(starts, ends, strict=True)],
                    "notes": [note[s:e].tobytes() for s, e in zip(starts, ends, strict=True)],
                })

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        prints = [np.frombuffer(p, np.uint32) for p in rows["prints"]]
        sizes = np.array([len(p) for p in prints])
        _, of, often = np.unique(np.concatenate(prints), return_inverse=True, return_counts=True)
        note = np.frombuffer(b"".join(rows["notes"]), np.uint8)
        twice = np.zeros(len(often), bool)
        twice[of[note & 1 == 1]] = True
        homes = np.bincount(of, weights=2.0 ** (note >> 1), minlength=len(often))
        answers = {"shared": (twice | (often > 1))[of], "hot": (homes > hot_chunks)[of], "hottest": (homes > SPREAD * hot_chunks)[of]}
        cut = np.cumsum(sizes)[:-1]
        bits = {name: [np.packbits(x).tobytes() for x in np.split(found, cut)] for name, found in answers.items()}
        return pd.DataFrame({"part": rows["part"], "chunk": rows["chunk"], **bits})

    sent = chunks.mapInPandas(send, "part bigint, chunk bigint, prints binary, notes binary")
    met = sent.groupBy("part").applyInPandas(meet, "part bigint, chunk bigint, shared binary, hot binary, hottest binary")
    return _answers(met, ["shared", "hot", "hottest"], "repeat-homes", broadcast_bytes)


def _flags(homes: Homes, row, parts: int) -> list[np.ndarray]:
    key, _, _, _ = homes.keys(parts)
    names = ("shared", "hot", "hottest")
    if not len(key):
        return [np.zeros(0, bool) for _ in names]
    _, counts = np.unique(key >> np.uint64(32), return_counts=True)
    return [_bits(row[name], counts) for name in names]


def string_keys(eights: np.ndarray, begin: np.ndarray, length: int) -> np.ndarray:
    """A hash of the ``length`` bytes from each place."""
    key = np.zeros(len(begin), np.uint64)
    for step in [*range(0, length - 8, 8), length - 8]:
        key = _mixed(key ^ eights[begin + step])
    return key


def repeated_strings(data: np.ndarray, size: np.ndarray, owner: np.ndarray, length: int) -> np.ndarray:
    """For each string of the passages, one after the other, whether a passage of a smaller owner holds it.

    Strings are dealt by some of their bytes, so only a share of them is sorted at a time.
    """
    strings = size - length + 1
    total = int(strings.sum())
    groups = max(1, -(-total // STRINGS))
    passage = np.repeat(np.arange(len(size), dtype=np.int32), strings)
    shift = np.cumsum(size) - size - (np.cumsum(strings) - strings)
    dealt, eights = np.zeros(total, np.min_scalar_type(groups)), _eights(data)
    for start in range(0, total if groups > 1 else 0, STRINGS):
        number = np.arange(start, min(start + STRINGS, total))
        # strings that agree agree in their first bytes and their last
        at = number + shift[passage[number]]
        dealt[number] = _mixed(eights[at] ^ _mixed(eights[at + length - 8] + _B)) % np.uint64(groups)
    found = np.zeros(total, bool)
    for group in range(groups if total else 0):
        number = np.flatnonzero(dealt == group)
        if not len(number):
            continue
        of = passage[number]
        order, starts = runs_of(data, number + shift[of], length)
        own = owner[of][order]
        sample = np.minimum.reduceat(own, starts)
        found[number[order]] = np.repeat(sample, np.diff(np.append(starts, len(order)))) < own
    return found


def runs_of(data: np.ndarray, begin: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes from ``begin`` sorted so that those that agree in ``length`` bytes are neighbours: order, run starts.

    Sorted by a hash of the bytes; that neighbours of one hash agree is checked
    on the bytes themselves, and what does not agree gets a finer order.
    """
    eights = _eights(data)
    steps = [*range(0, length - 8, 8), length - 8]
    key = string_keys(eights, begin, length)
    order = np.argsort(key, kind="stable")

    def changes(order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        there = begin[order]
        differ = np.zeros(max(len(order) - 1, 0), bool)
        for step in steps:
            word = eights[there + step]
            differ |= word[1:] != word[:-1]
        return key[order][1:] != key[order][:-1], differ

    hashed, differ = changes(order)
    if (differ & ~hashed).any():  # two strings with one hash
        order = np.lexsort([*(eights[begin + step].astype(np.uint64) for step in reversed(steps)), key])
        _, differ = changes(order)
    return order, np.flatnonzero(np.concatenate([[True], differ]))[: max(len(order), 0)]


def _repeats(chunks: DataFrame, length: int, parts: int, broadcast_bytes: int) -> DataFrame:
    """(chunk, repeated): bits for the strings of each part's distinct passages."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, row in batch.iterrows():
                homes, ids = _opened(row, length)
                p = homes.passages(ids, parts, *_flags(homes, row, parts))
                names, starts = np.unique(p["part"], return_index=True)
                ends = np.concatenate([starts[1:], [len(p["part"])]])[: len(starts)]
                begin = p["first"][p["one"]]
                data = homes.raw.tobytes()
                yield pd.DataFrame({
                    "part": names, "chunk": row["chunk"],
                    "owners": [p["owner"][s:e].tobytes() for s, e in zip(starts, ends, strict=True)],
                    "sizes": [p["sizes"][s:e].astype(np.uint32).tobytes() for s, e in zip(starts, ends, strict=True)],
                    "data": [b"".join(data[b : b + n] for b, n in zip(begin[s:e].tolist(), p["sizes"][s:e].tolist(), strict=True)) for s, e in zip(starts, ends, strict=True)],
                })

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        sizes = [np.frombuffer(x, np.uint32).astype(np.int64) for x in rows["sizes"]]
        size, owner = np.concatenate(sizes), np.concatenate([np.frombuffer(x, np.int64) for x in rows["owners"]])
        data = np.frombuffer(b"".join(rows["data"]), np.uint8)
        found = repeated_strings(data, size, owner, length)
        per_row = np.array([int((x - length + 1).sum()) for x in sizes])
        return pd.DataFrame({
            "part": rows["part"], "chunk": rows["chunk"],
            "repeated": [np.packbits(x).tobytes() for x in np.split(found, np.cumsum(per_row)[:-1])],
        })

    sent = chunks.mapInPandas(send, "part bigint, chunk bigint, owners binary, sizes binary, data binary")
    met = sent.groupBy("part").applyInPandas(meet, "part bigint, chunk bigint, repeated binary")
    return _answers(met, ["repeated"], "repeat-strings", broadcast_bytes)


def _cut(chunks: DataFrame, length: int, parts: int) -> DataFrame:
    """(id, rk, starts, ends, sha): what is removed from each document, and the digest of what is left."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, row in batch.iterrows():
                homes, ids = _opened(row, length)
                n = len(homes.raw)
                covered = np.zeros(n + 1, np.int32)
                if row["shared"] is not None:
                    p = homes.passages(ids, parts, *_flags(homes, row, parts))
                    strings = p["sizes"] - length + 1
                    parts_of, place = np.unique(p["part"], return_inverse=True)
                    counts = np.bincount(place, strings).astype(np.int64) if len(parts_of) else []
                    masks = row["repeated"] if row["repeated"] is not None else []
                    bits = _bits(masks, counts)
                    before = np.cumsum(strings) - strings
                    each = strings[p["of"]]
                    ends = np.cumsum(each)
                    start = 0
                    while start < len(each):
                        end = max(start + 1, int(np.searchsorted(ends, ends[start] + STRINGS, side="right")) - 1)
                        many, of = each[start:end], p["of"][start:end]
                        offset = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                        gone = bits[np.repeat(before[of], many) + offset] | np.repeat(p["id"][start:end] > p["owner"][of], many)
                        at = (np.repeat(p["first"][start:end], many) + offset)[gone]
                        np.add.at(covered, at, 1)
                        np.add.at(covered, at + length, -1)
                        start = end
                hidden = np.cumsum(covered[:n]) > 0
                out, begin = [], 0
                for end in homes.ends.tolist():
                    own = hidden[begin:end]
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
                    left = homes.raw[begin:end][~own].tobytes()
                    out.append((edges[::2].tolist(), edges[1::2].tolist(), hashlib.sha256(left).hexdigest()))
                    begin = end
                starts, ends, digests = zip(*out, strict=True)
                yield pd.DataFrame({"id": ids, "n_bytes": homes.sizes, "starts": starts, "ends": ends, "sha": digests})

    return chunks.mapInPandas(cut, "id bigint, n_bytes bigint, starts array<bigint>, ends array<bigint>, sha string")


def _searched(rows: DataFrame, length: int, chunk_bytes: int, part_bytes: int, hot_chunks: int, broadcast_bytes: int) -> DataFrame:
    """What `_cut` finds, written: while it is made, chunks go to Python one by one."""
    with arrow_bytes(rows.sparkSession, BATCH_BYTES):
        chunks = _chunks(rows, chunk_bytes)
        total = chunks.agg(F.sum(F.octet_length("data"))).first()[0] or 0
        parts = max(1, -(-total // part_bytes))
        known = chunks.join(_shared_homes(chunks, length, parts, hot_chunks, broadcast_bytes), "chunk", "left")
        answered = known.join(_repeats(known, length, parts, broadcast_bytes), "chunk", "left")
        return written(_cut(answered, length, parts), "repeat-cuts")


def repeated_spans(
    documents: DataFrame, id: str = "doc_id", text: str = "text", length: int = 50,
    chunk_bytes: int = CHUNK_BYTES, part_bytes: int = PART_BYTES, hot_chunks: int = HOT_CHUNKS,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """One row per document: id, n_bytes, ``spans`` (start, end) of removed bytes, kept_sha256.

    A byte is removed if a string of ``length`` bytes that covers it also starts
    in a document with a smaller id; what is removed there does not matter.
    Matches do not cross documents, rows with the same id are not compared, and
    rows with a NULL id neither lose bytes nor take any. Ids are integers. NULL
    and empty texts have no bytes. Other columns are ignored.
    """
    spark = documents.sparkSession
    ship(spark)
    rows = documents.select(F.col(id).cast("bigint").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = F.octet_length("text").cast("bigint")
    marks = rows.select("id", F.xxhash64("text").alias("h1"), F.crc32(F.col("text").cast("binary")).alias("h2"), size.alias("n_bytes"))
    # whole copies need no search: every string of theirs starts in the first of them
    copies = marks.where(F.col("n_bytes") >= length).groupBy("h1", "h2", "n_bytes").agg(F.min("id").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = hinted(written(copies, "repeat-copies"))
    marked = rows.withColumns({"h1": F.xxhash64("text"), "h2": F.crc32(F.col("text").cast("binary")), "n_bytes": size}).join(copies, ["h1", "h2", "n_bytes"], "left")
    copied = F.col("id") > F.col("least")
    plain = (F.col("n_bytes") < length) | F.col("id").isNull()
    searched = _searched(marked.where(~F.coalesce(copied, F.lit(False)) & ~plain), length, chunk_bytes, part_bytes, hot_chunks, broadcast_bytes)
    searched = searched.select(
        "id", "n_bytes", F.arrays_zip(F.col("starts").alias("start"), F.col("ends").alias("end")).alias("spans"), F.col("sha").alias("kept_sha256")
    )
    span = "array<struct<start:bigint,end:bigint>>"
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.col("n_bytes").alias("end"))).cast(span)
    rest = marked.where(F.coalesce(copied, F.lit(False)) | plain).select(
        "id", "n_bytes",
        F.when(copied, whole).otherwise(F.array().cast(span)).alias("spans"),
        F.when(copied, F.sha2(F.lit(""), 256)).otherwise(F.sha2("text", 256)).alias("kept_sha256"),
    )
    return searched.withColumn("spans", F.col("spans").cast(span)).unionByName(rest).withColumnRenamed("id", id)
