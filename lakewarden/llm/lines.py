"""Fuzzy line deduplication.

Lines are normalised, and equal ones form a class. Lines of which at most k words
are edited share all but k, so of the words ordered from rare to frequent some word
among the first k + 1 of each is in both: by these words classes meet, and no link
is missed. A sample finds the frequent words; it settles the order, which decides
work and never a result. A sketch of bits, each word flipping one, and the lengths
reject pairs that cannot be linked. What is left forms candidate groups, inside
which the edit similarity of the lines, word by word, is verified. Of each connected
group of verified links the first occurrence stays, by document and line.

``exact=False`` takes another way to candidates, which misses some: the SimHash of a
line's words, every word voting for or against every bit, is cut into blocks, and
classes that agree in a whole block meet (pigeonhole: of B blocks, lines with fewer
than B differing bits share one; lines at the threshold with the chance that
``blocks_for`` sets). Other pieces of the SimHash reject most pairs that meet.
"""

from __future__ import annotations

import functools
import math
import unicodedata
from collections.abc import Iterator, Sequence
from operator import ne

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, discard, fresh, hinted, let, ship, written
from .components import components
from .jaccard import _Forest

#: Edit similarity of linked lines, in words, and the share of lines just that similar that meet in a block
SHARE, FOUND = 0.9, 0.85
#: 64-bit words of the SimHash by which pairs are rejected, the first of which goes with each block, and standard deviations that linked lines may be off
CHECKS, OFF = 3, 3.0
NEAR = tuple(f"c{k}" for k in range(CHECKS))
#: Words of a long line whose votes are counted at a time, and words of a line up to which a count fits 8 bits
VOTES, SHORT = 4096, 127
#: One class in so many is looked at to find blocks with more than BLOCK classes, which only deals their work to more tasks
EVERY = 64
#: 64-bit words of a signature, and of that of lines of more than WIDE_FROM words
WORDS, WIDE, WIDE_FROM = 4, 32, 200
SIGNS = (*(f"s{k}" for k in range(WORDS)), "wide")
#: Lines of a block; a task compares two blocks
BLOCK = 1000
#: Lines of a key up to which all pairs are compared at once
FEW = 32
#: Neighbours of each line by which a key's lines are found dense
FIRST = 8
#: Pairs of lines that are compared at a time
PAIRS = 1_000_000
#: Words of the sample whose counts are known, and the count from which a key holds the line's length
OFTEN_ROWS, FREQUENT = 20_000, 16
#: Bits of a word's hash by which its count is found, of a count, and of the hash in a key; what is left numbers the lines sorted at a time
PLACE, COUNT, WORD = 20, 15, 36


def normalised(line: Column) -> Column:
    """Lower case, with every run of other characters than letters and digits as one space.

    Letters of scripts without spaces between words are words by themselves.
    """
    lower = F.lower(line)
    alone = F.regexp_replace(lower, r"([\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}])", " $1 ")
    spaced = F.when(F.octet_length(lower) > F.length(lower), alone).otherwise(lower)
    return F.btrim(F.regexp_replace(spaced, r"[^\p{L}\p{N}]+", " "))


def _least(sizes: np.ndarray, share: float) -> np.ndarray:
    """How many words a line of so many words has in common with a linked line that is no longer."""
    return np.ceil(share * sizes - 1e-9).astype(np.int64)


def signatures(hashes: np.ndarray, starts: np.ndarray, words: int = WORDS) -> np.ndarray:
    """64-bit words per line, each word's bit flipped as often as it occurs; the words' hashes of line i begin at starts[i].

    A word more or less flips one bit, so lines differ in at most as many bits as words.
    """
    bit = (hashes.view(np.uint64) >> np.uint64(5)) & np.uint64(64 * words - 1)
    place, value = bit >> np.uint64(6), np.uint64(1) << (bit & np.uint64(63))
    out = np.empty((len(starts), words), np.uint64)
    for k in range(words):
        out[:, k] = np.bitwise_xor.reduceat(np.where(place == k, value, np.uint64(0)), starts)
    return out.view(np.int64)


def known_words(often: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The counts of frequent words, by the first bits of their hashes.

    Words that share a place have the larger count: any order of words will do that is the same for all lines.
    """
    known = np.zeros(2**PLACE, np.uint16)
    np.maximum.at(known, (often[0].view(np.uint64) >> np.uint64(64 - PLACE)).astype(np.int64), np.minimum(often[1], 2**COUNT - 1).astype(np.uint16))
    return known


def word_keys(hashes: np.ndarray, sizes: np.ndarray, often: tuple[np.ndarray, np.ndarray] | np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """(line, key): linked lines, other than equal ones, have a key in common.

    ``often`` has hashes, in order, and counts of frequent words, or what ``known_words`` makes of them.
    """
    row, ends = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes)
    plain, known = hashes.view(np.uint64), often if isinstance(often, np.ndarray) else known_words(often)
    value = known[plain >> np.uint64(64 - PLACE)].astype(np.uint64) << np.uint64(WORD) | plain >> np.uint64(64 - WORD)
    some = 1 << (64 - COUNT - WORD)
    for first in range(0, len(sizes), some):  # with the line's number before it, one sort orders the words of all these lines
        at = slice(ends[first] - sizes[first], ends[min(first + some, len(sizes)) - 1])
        value[at] |= (row[at] - first).astype(np.uint64) << np.uint64(COUNT + WORD)
        value[at].sort()
    value = (value & np.uint64(2 ** (COUNT + WORD) - 1)).view(np.int64)
    count = value >> WORD
    spare = sizes - _least(sizes, share)  # words that a linked line may lack
    edits = (spare > 0) | (np.floor(sizes / share + 1e-9) > sizes)  # otherwise linked lines are equal
    place = np.arange(len(row)) - (ends - sizes)[row]
    new = np.concatenate([[True], (value[1:] != value[:-1]) | (row[1:] != row[:-1])])
    taken = (place <= spare[row]) & edits[row] & new[: len(row)]
    value, row, frequent = value[taken], row[taken], count[taken] >= FREQUENT
    classes = [1]
    while classes[-1] <= sizes.max(initial=1):  # linked lines lie in one class of length or in neighbouring ones
        classes.append(max(classes[-1] + 1, int(np.ceil(classes[-1] / share - 1e-9))))
    own = np.searchsorted(np.array(classes), sizes, side="right")[row[frequent]]
    lines, keys = [row[~frequent]], [value[~frequent]]
    for step in (0, 1):
        x = value[frequent] ^ (own + step) * -7046029254386353131
        lines.append(row[frequent])
        keys.append(x ^ (x >> 29))
    return np.concatenate(lines), np.concatenate(keys)


def blocks_for(lines: int, share: float = SHARE, found: float = FOUND) -> tuple[int, int]:
    """(bits of a block, blocks): blocks as selective as the lines are many, enough that ``found`` of lines just ``share`` alike meet."""
    bits = max(12, math.ceil(math.log2(max(lines, 1))) - 3)
    same = (1 - math.acos(share) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - found) / math.log(1 - same))


def _can_differ(sizes: np.ndarray, share: float) -> np.ndarray:
    """Whether lines of so many words can be linked with others than equal ones."""
    return (_least(sizes, share) < sizes) | (np.floor(sizes / share + 1e-9) > sizes)


def _votes(hashes: np.ndarray, words: int) -> np.ndarray:
    """For each word's hash 1 or -1 for each bit."""
    planes = np.empty((len(hashes), words), np.uint64)
    for k in range(words):
        x = hashes.view(np.uint64) + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        planes[:, k] = x ^ (x >> np.uint64(31))
    return np.unpackbits(planes.view(np.uint8), axis=1).view(np.int8) * 2 - 1


def _numbered(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Another hash for the second and each further occurrence of a word in its line, lines lying one after the other.

    So an edit changes one vote, and lines that merely repeat the same few words are not alike.
    """
    row = np.repeat(np.arange(len(sizes)), sizes)
    order = np.lexsort((hashes, row))
    value, line = hashes[order], row[order]
    new = np.concatenate([[True], (value[1:] != value[:-1]) | (line[1:] != line[:-1])])[: len(value)]
    first = np.flatnonzero(new)
    out = np.empty_like(hashes)
    out[order] = value ^ (np.arange(len(value)) - first[np.cumsum(new) - 1]) * -7046029254386353131
    return out


def simhash(hashes: np.ndarray, starts: np.ndarray, words: int) -> np.ndarray:
    """64-bit words of the SimHash of lines; the words' hashes of line i begin at starts[i]."""
    sizes = np.diff(np.append(starts, len(hashes)))
    out = np.empty((len(starts), words), np.uint64)
    for line in np.flatnonzero(sizes > SHORT).tolist():
        own, total = _numbered(hashes[starts[line] : starts[line] + sizes[line]], sizes[line : line + 1]), np.zeros(64 * words, np.int64)
        for at in range(0, len(own), VOTES):
            total += _votes(own[at : at + VOTES], words).sum(axis=0, dtype=np.int64)
        out[line] = np.packbits(total >= 0).view(np.uint64)
    short = np.flatnonzero(sizes <= SHORT)
    short = short[np.argsort(-sizes[short], kind="stable")]
    for some in np.split(short, range(1024, len(short), 1024)):  # word by word, in all lines that have so many
        n = sizes[some]
        begin = np.cumsum(n) - n
        distinct, at = np.unique(_numbered(hashes[np.arange(n.sum()) + np.repeat(starts[some] - begin, n)], n), return_inverse=True)
        table, total = _votes(distinct, words), np.zeros((len(some), 64 * words), np.int8)
        for k in range(n.max(initial=0)):
            active = int(np.searchsorted(-n, -k))
            total[:active] += table[at[begin[:active] + k]]
        out[some] = np.packbits(total >= 0, axis=1).view(np.uint64)
    return out


def edit_distance(a: Sequence, b: Sequence, most: int | None = None) -> int:
    """Levenshtein's between texts or lists of words, by bit vectors as long as ``a``; above ``most`` some number above it."""
    if most is None:
        most = len(a) + len(b)
    begin, short = 0, min(len(a), len(b))
    while begin < short and a[begin : begin + 16] == b[begin : begin + 16]:
        begin += 16
    a, b = a[begin:], b[begin:]
    end, short = 0, min(len(a), len(b))
    while end + 16 <= short and a[len(a) - end - 16 : len(a) - end] == b[len(b) - end - 16 : len(b) - end]:
        end += 16
    a, b = a[: len(a) - end], b[: len(b) - end]
    if not a or not b:
        return max(len(a), len(b))
    where: dict = {}
    for i, letter in enumerate(a):
        where[letter] = where.get(letter, 0) | 1 << i
    every, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score, left = every, 0, len(a), len(b)
    for letter in b:
        same = where.get(letter, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        more, less = down | ~(diagonal | up) & every, up & diagonal
        score += bool(more & top) - bool(less & top)
        left -= 1
        if score - left > most:  # each letter left can take one away
            return score - left
        more, less = (more << 1 | 1) & every, less << 1 & every
        up, down = less | ~(diagonal | more) & every, more & diagonal
    return score


class _Filter:
    """Rejects pairs by their lengths and signatures; no pair that is linked."""

    def __init__(self, rows: pd.DataFrame, share: float):
        self.sizes = rows["n"].to_numpy().astype(np.int64)
        self.least = _least(self.sizes, share)  # grows with the size, so the larger one's is the larger
        # unsigned, as of signed numbers the bits of their absolute values are counted
        self.signs = rows[[f"s{k}" for k in range(WORDS)]].to_numpy().astype(np.int64).view(np.uint64)
        # with b words in the other line a + b - 2 * share * max(a, b) bits may differ: most, if b is a or a / share
        self.one, self.most = np.bitwise_xor.reduce(self.signs, axis=1), np.minimum(self.sizes * max(2 - 2 * share, 1 / share - 1) + 1e-6, 64).astype(np.uint8)
        self.wide = [w if w is None else np.frombuffer(w, np.uint64) for w in rows["wide"]] if "wide" in rows else None

    def near(self, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
        """Of pairs of rows, given as arrays that go together, which may be linked."""
        # the signatures as one word reject most pairs, by what the one line allows at most
        out = np.bitwise_count(self.one[xs] ^ self.one[ys]) <= self.most[xs]
        at = np.nonzero(out)
        x, y = np.broadcast_to(xs, out.shape)[at], np.broadcast_to(ys, out.shape)[at]
        a, b = self.sizes[x], self.sizes[y]
        most = a + b - 2 * np.maximum(self.least[x], self.least[y])
        near = (most >= np.abs(a - b)) & (np.bitwise_count(self.signs[x] ^ self.signs[y]).sum(axis=1, dtype=np.int64) <= most)
        if self.wide is not None:
            for k in np.flatnonzero(near & (np.minimum(a, b) > WIDE_FROM)).tolist():
                near[k] = np.bitwise_count(self.wide[x[k]] ^ self.wide[y[k]]).sum() <= most[k]
        out[at] = near
        return out


class _Near:
    """Rejects pairs by their lengths and by pieces of their SimHash; of linked pairs fewer than one in 700."""

    def __init__(self, rows: pd.DataFrame, share: float):
        self.sizes, self.share = rows["n"].to_numpy().astype(np.int64), share
        self.signs = [rows[c].to_numpy().astype(np.int64).view(np.uint64) for c in NEAR]
        differ, bits = math.acos(share) / math.pi, 64 * CHECKS
        self.most = bits * differ + OFF * math.sqrt(bits * differ * (1 - differ))

    def near(self, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
        """Of pairs of rows, given as arrays that go together, which may be linked."""
        a, b = self.sizes[xs], self.sizes[ys]
        bits = sum(np.bitwise_count(sign[xs] ^ sign[ys]).astype(np.int16) for sign in self.signs)
        return (bits <= self.most) & (np.minimum(a, b) >= self.share * np.maximum(a, b) - 1e-9)


def _tree(pairs: _Filter, start: int, end: int) -> tuple[list[int], list[int]]:
    """Pairs that connect what pairs near each other connect, of the rows from ``start`` to ``end``, numbered from 0."""
    u, v, group = [], [], np.arange(end - start)
    rows = max(1, PAIRS // (end - start))
    for first in range(start, end, rows):
        xs, ys = np.arange(first, min(first + rows, end)), np.arange(first + 1, end)
        near = pairs.near(xs[:, None], ys[None]) & (xs[:, None] < ys)
        for x in np.flatnonzero(near.any(axis=1)).tolist():
            others = np.flatnonzero(near[x]) + first + 1 - start
            x += first - start
            others = others[group[others] != group[x]]
            if len(others):
                joined, at = np.unique(group[others], return_index=True)
                u += [x] * len(at)
                v += others[at].tolist()
                group[np.isin(group, joined)] = group[x]
    return u, v


def _in_windows(pairs: _Filter, starts: np.ndarray, ends: np.ndarray, longest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, pair by pair, that are near, of groups that begin and end there, sorted by length; and which groups are left to ``_tree``.

    All groups at once, row by row with the next, the next but one and so on, up to the longest line that may be linked. Large groups
    with several near pairs a row among the first of these are dense: their pairs would grow with the square of their rows.
    """
    sizes = ends - starts
    group, last = np.repeat(np.arange(len(starts)), sizes), np.repeat(ends, sizes)
    dense, u, v = np.zeros(len(starts), bool), [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    xs, step = np.arange(len(last)), 0
    while len(xs):
        step += 1
        xs = xs[xs + step < last[xs]]
        xs = xs[pairs.sizes[xs + step] <= longest[xs]]
        near = xs[pairs.near(xs, xs + step)]
        u.append(near)
        v.append(near + step)
        if step == FIRST:
            x, y = np.concatenate(u), np.concatenate(v)
            dense = (sizes > FEW) & (np.bincount(group[x], minlength=len(starts)) > 2 * sizes)
            kept, xs = ~dense[group[x]], xs[~dense[group[xs]]]
            u, v = [x[kept]], [y[kept]]
    return np.concatenate(u), np.concatenate(v), dense


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs that connect all that they connect: each one less is a row less in every round of ``components``."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    forest = _Forest(len(nodes))
    kept = np.array([forest.join(x, y) for x, y in zip(at[: len(u)].tolist(), at[len(u) :].tolist(), strict=True)], bool)
    return u[kept], v[kept]


def _words(rows: DataFrame) -> DataFrame:
    """The lines of ``text`` with hashes of their normalised text and of its words."""
    each = rows.select("id", "rk", F.posexplode_outer(F.split("text", "\n", -1)).alias("line", "body"))
    plain = each.select("id", "rk", "line", normalised(F.coalesce("body", F.lit(""))).alias("norm"))
    return plain.select(
        "id", "rk", "line", F.xxhash64("norm").alias("l1"), F.crc32(F.col("norm").cast("binary")).alias("l2"),
        F.when(F.col("norm") != "", F.transform(F.split("norm", " "), lambda w: F.xxhash64(w))).otherwise(F.array().cast("array<bigint>")).alias("words"),
    )


#: What a byte of an ASCII text is in a word: lower case, 0 where none is
LETTERS = np.array([ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b * (b >= 128) for b in range(256)], np.uint8)
#: Characters, from and to, that are normalised where they are hashed: each has one lower case, whatever stands beside it, and no version
#: of Unicode of the last ten years moved one. Lines with others (Σ, İ, scripts without cases) are normalised before, so only letters, digits and spaces are left
PLAIN = ((0x0, 0x12F), (0x131, 0x3A2), (0x3A4, 0x52F), (0x1E00, 0x1EFF), (0x2000, 0x2BFF))
#: All others; one range at a time, as Java's union of ranges takes a hundred times as long
SINGLE, RANGES = "İΣ", ((0x530, 0x1DFF), (0x1F00, 0x1FFF), (0x2C00, 0x10FFFF))


def _points() -> np.ndarray:
    """What a character is in a word, by its code point; those that are not ``PLAIN`` are as they are."""
    out = np.arange(PLAIN[-1][1] + 1, dtype=np.uint32)
    for a, b in PLAIN:
        lower = [chr(c).lower() for c in range(a, b + 1)]
        out[a : b + 1] = [ord(c) if unicodedata.category(c)[0] in "LN" else 0 for c in lower]
    return out


POINTS = _points()
#: Bases, odd, of the two hashes of a word, and texts that are hashed at a time, few enough for a processor's cache
BASES, TEXTS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93), 50
_powers: dict[int, np.ndarray] = {}
_scratch: dict[str, np.ndarray] = {}


def _power(base: int, size: int) -> np.ndarray:
    """The base's powers from 0."""
    if len(_powers.get(base, ())) < size:
        each = np.full(2 * size, base, np.uint64)
        each[0] = 1
        _powers[base] = np.cumprod(each)
    return _powers[base][:size]


def _held(name: str, kind: type, size: int) -> np.ndarray:
    """An array to write to, of the same memory each time: new memory for every run of texts took longer than what is done with it."""
    if len(_scratch.get(name, ())) < size:
        _scratch[name] = np.empty(size, kind)
    return _scratch[name][:size]


def _stirred(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of the lines that have words: text, line number, words, two hashes of the line; hashes of all words, line after line."""
    whole = b"\n".join([*texts, b""])
    if whole.isascii():
        data = np.frombuffer(whole, np.uint8)
        body = LETTERS[data]
    else:
        data = np.frombuffer(whole.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        body = POINTS[np.minimum(data, len(POINTS) - 1)]
        beyond = data >= len(POINTS)
        body[beyond] = data[beyond]
    new = data == 10
    inside = np.concatenate([[False], body != 0])  # the last byte ends a line
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edge[::2], edge[1::2]
    hashes = []
    for base in BASES:
        product, sums = _held("product", np.uint64, len(body)), _held("sums", np.uint64, len(body) + 1)
        sums[0] = 0
        np.cumsum(np.multiply(body, _power(base, len(body)), out=product), out=sums[1:])
        hashes.append(_stirred((sums[end] - sums[begin]) * _power(pow(base, -1, 2**64), len(body))[begin]))
    line = np.cumsum(new, out=_held("line", np.int64, len(new)))[begin]
    starts = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])[: len(line)])
    sizes = np.diff(np.append(starts, len(line)))
    place = (np.arange(len(line)) - np.repeat(starts, sizes)).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    both = [np.add.reduceat(_stirred(h + place), starts).view(np.int64) if len(starts) else np.zeros(0, np.int64) for h in hashes]
    of = line[starts]
    first = np.concatenate([[0], np.cumsum([t.count(b"\n") + 1 for t in texts], dtype=np.int64)])
    text = np.searchsorted(first, of, side="right") - 1
    return text, of - first[text], sizes, *both, hashes[0].view(np.int64)


def _other(text: Column) -> Column:
    """Whether a text has other than ``PLAIN`` characters."""
    found = F.octet_length(text) > F.length(text)
    several = [text.contains(c) for c in SINGLE] + [text.rlike(f"[\\x{{{a:x}}}-\\x{{{b:x}}}]") for a, b in RANGES]
    return found & functools.reduce(Column.__or__, several)


def _readable(rows: DataFrame) -> DataFrame:
    """The texts, lines with other than ``PLAIN`` characters normalised; the others are normalised where they are hashed."""
    lines = F.transform(F.split("text", "\n", -1), lambda x: F.when(_other(x), normalised(x)).otherwise(x))
    return rows.withColumn("text", F.when(_other(F.col("text")), F.array_join(lines, "\n")).otherwise(F.col("text")).cast("binary"))


def _text_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, tuple[np.ndarray, ...]]]:
    for whole in batches:
        for start in range(0, whole.num_rows, TEXTS):
            batch = whole.slice(start, TEXTS)
            yield batch, hashed_words(batch.column("text").to_pylist())


def often_used(rows: DataFrame, sample_rows: int = 2000, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, in order, and counts of the most frequent words of about ``sample_rows`` documents, OFTEN_ROWS at most."""
    sample = rows.sample(fraction=min(1.0, sample_rows / max(rows.count(), 1)), seed=seed)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (*_, words) in _text_runs(batches):
            word, often = np.unique(words, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(often)], names=["w", "n"])

    each = _readable(sample.select("text")).mapInArrow(count, "w bigint, n bigint")
    counts = each.groupBy("w").agg(F.sum("n").alias("n")).where("n > 1")
    found = sorted(map(tuple, counts.orderBy(F.desc("n"), "w").limit(OFTEN_ROWS).collect()))
    return np.array([w for w, _ in found], np.int64), np.array([n for _, n in found], np.int64)


def _lines(rows: DataFrame, share: float) -> DataFrame:
    """(id, rk, line, l1, l2, n, s0..s3, wide, keys): the lines that count, with what their classes are compared by."""
    often = often_used(rows)

    def hash_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = known_words(often)
        for batch, (text, number, sizes, l1, l2, flat) in _text_runs(batches):
            if not len(sizes):
                continue
            starts = np.cumsum(sizes) - sizes
            signs = signatures(flat, starts)
            wide = np.full(len(sizes), None, object)
            for at in np.flatnonzero(sizes > WIDE_FROM).tolist():
                wide[at] = signatures(flat[starts[at] : starts[at] + sizes[at]], np.array([0]), WIDE).tobytes()
            line, key = word_keys(flat, sizes.astype(np.int64), known, share)
            key = key[np.argsort(line, kind="stable")]
            offsets = np.concatenate([[0], np.cumsum(np.bincount(line, minlength=len(sizes)))])
            keys = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(key))
            taken = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(taken), batch.column("rk").take(taken), pa.array(number, pa.int32()), pa.array(l1), pa.array(l2),
                 pa.array(sizes, pa.int32()), *[pa.array(signs[:, k]) for k in range(WORDS)], pa.array(wide, pa.binary()), keys],
                names=["id", "rk", "line", "l1", "l2", "n", *SIGNS, "keys"],
            )

    id_type = rows.schema["id"].dataType.simpleString()
    signs = ", ".join(f"s{k} bigint" for k in range(WORDS))
    return _readable(rows).mapInArrow(hash_, f"id {id_type}, rk bigint, line int, l1 bigint, l2 bigint, n int, {signs}, wide binary, keys array<bigint>")


def _hashed_lines(rows: DataFrame, share: float, words: int) -> DataFrame:
    """(id, rk, line, l1, l2, n, sig, c0..c2): the lines that count; the SimHash and pieces of it only of those that can be linked with unequal ones."""
    names = ["id", "rk", "line", "l1", "l2"]

    def hash_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.filter(pc.greater_equal(pc.list_value_length(batch.column("words")), 1))
            sizes = pc.list_value_length(kept.column("words")).to_numpy().astype(np.int64)
            sig, checks = np.full(len(sizes), None, object), np.zeros((len(sizes), CHECKS), np.int64)
            longer = np.flatnonzero(_can_differ(sizes, share))
            if len(longer):
                flat = kept.column("words").take(pa.array(longer)).flatten().to_numpy(zero_copy_only=False)
                own = sizes[longer]
                signs = simhash(flat, np.cumsum(own) - own, words)
                sig[longer], checks[longer] = [row.tobytes() for row in signs], signs.view(np.int64)[:, :CHECKS]
            columns = [*[kept.column(c) for c in names], pa.array(sizes, pa.int32()), pa.array(sig, pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(c) for c in checks.T.copy()]], names=[*names, "n", "sig", *NEAR])

    id_type = rows.schema["id"].dataType.simpleString()
    return _words(rows).mapInArrow(hash_, f"id {id_type}, rk bigint, line int, l1 bigint, l2 bigint, n int, sig binary, " + ", ".join(f"{c} bigint" for c in NEAR))


def _meeting(classes: DataFrame, share: float, bits: int, blocks: int) -> DataFrame:
    """(u, v, tree): pairs that agree in a block and may be linked; of blocks with many classes only a tree that connects those."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        power = 2.0 ** np.arange(bits)
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                batch = whole.slice(start, 2048)
                signs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                flags = np.unpackbits(signs, axis=1)[:, : bits * blocks].reshape(-1, blocks, bits)
                keys = (flags @ power).astype(np.int64) | np.arange(blocks) << bits
                again = np.repeat(np.arange(batch.num_rows), blocks)
                columns = [keys.ravel(), *[batch.column(c).to_numpy()[again] for c in ("node", "n")], *signs.view(np.int64)[:, :2][again].T.copy()]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "node", "n", "c0", "c1"])

    schema = "key bigint, node bigint, n int, c0 bigint, c1 bigint"
    longer = classes.where("sig is not null").select("node", "n", "sig")
    some = longer.where(F.pmod(F.xxhash64("node", F.lit(1)), F.lit(EVERY)) == 0).mapInArrow(cut, schema)
    hot = some.groupBy("key").agg((F.count("*") * EVERY).alias("members")).where(F.col("members") > BLOCK)
    hot = hinted(written(hot.withColumnRenamed("key", "hot_key"), "line-hot-blocks"), 200_000)
    parts = max(1, -(-longer.count() * blocks // 200_000))
    rows = longer.mapInArrow(cut, schema)
    sized = rows.join(hot, rows.key == hot.hot_key, "left")
    wanted = F.ceil(F.col("members") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("node"), wanted).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), wanted - 1), lambda o: -1 - F.shiftrightunsigned(F.xxhash64("key", F.least(o, mine), F.greatest(o, mine)), 1))
    part = F.when(F.col("members").isNull(), F.array(F.pmod(F.xxhash64("key"), F.lit(parts)))).otherwise(pairs)
    dealt_out = sized.select(F.explode(part).alias("part"), *rows.columns)

    def meet(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("key").to_numpy(), kind="stable")
        key, node, size, one, two = (table.column(c).to_numpy()[order] for c in ("key", "node", "n", "c0", "c1"))
        one, two = one.view(np.uint64), two.view(np.uint64)
        differ = math.acos(share) / math.pi
        most = 128 * differ + OFF * math.sqrt(128 * differ * (1 - differ))

        def near(xs, ys):
            bits = np.bitwise_count(one[xs] ^ one[ys]) + np.bitwise_count(two[xs] ^ two[ys])
            return (bits <= most) & (np.minimum(size[xs], size[ys]) >= share * np.maximum(size[xs], size[ys]) - 1e-9)

        new = np.concatenate([[True], key[1:] != key[:-1]])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(key)))
        few = (sizes <= FEW)[np.cumsum(new) - 1]
        u, v = [], []
        for step in range(1, min(FEW, sizes.max(initial=0))):
            xs = np.flatnonzero((key[step:] == key[:-step]) & few[step:] & near(slice(step, None), slice(None, -step)))
            u.append(node[xs])
            v.append(node[xs + step])
        pairs = np.sort(np.stack([np.concatenate([*w, np.empty(0, np.int64)]) for w in (u, v)], axis=1), axis=1)
        u, v = [], []
        for s, n in zip(starts[sizes > FEW].tolist(), sizes[sizes > FEW].tolist(), strict=True):
            left = np.ones(n, bool)
            for first in range(n):
                open_ = [first] if left[first] else []
                left[first] = False
                while open_:
                    x = open_.pop()
                    close = np.flatnonzero(left & near(slice(s, s + n), s + x))
                    left[close] = False
                    u += [node[s + x]] * len(close)
                    v += node[s + close].tolist()
                    open_ += close.tolist()
        edges = np.sort(np.array([u, v], np.int64).reshape(2, -1).T, axis=1)
        tree = np.repeat([False, True], [len(pairs), len(edges)])
        every = np.concatenate([pairs, edges])
        return pa.table({"u": every[:, 0].copy(), "v": every[:, 1].copy(), "tree": tree})

    return dealt_out.groupBy("part").applyInArrow(meet, "u bigint, v bigint, tree boolean").distinct()


def _alike(pairs: DataFrame, classes: DataFrame, share: float) -> DataFrame:
    """(u, v, tree): pairs that may be linked by their lengths and larger pieces of their SimHash, and all of trees, which hold together only whole."""
    trees, pairs = pairs.where("tree"), pairs.where("not tree")
    own = classes.where("sig is not null").select("node", "n", *NEAR)
    for side in ("u", "v"):
        pairs = pairs.join(own.withColumnsRenamed({c: f"{side}_{c}" for c in own.columns}), F.col(side) == F.col(f"{side}_node"))
    differ, bits = math.acos(share) / math.pi, 64 * CHECKS
    apart = sum((F.bit_count(F.col(f"u_{c}").bitwiseXOR(F.col(f"v_{c}"))) for c in NEAR), F.lit(0))
    near = apart <= bits * differ + OFF * math.sqrt(bits * differ * (1 - differ))
    return pairs.where(near & (F.least("u_n", "v_n") >= F.greatest("u_n", "v_n") * share - 1e-9)).select("u", "v", "tree").unionByName(trees)


def _candidates(lines: DataFrame, share: float) -> DataFrame:
    """(u, v): pairs that share a key and may be linked, enough of them to connect all that do."""
    columns = ["key", "node", "n", *SIGNS[:WORDS]]
    rows = lines.select(F.explode_outer("keys").alias("key"), *columns[1:]).where("key is not null")
    parts = max(1, -(-lines.count() // 5000))
    # one line in EVERY tells the keys of many lines; they are only dealt to more tasks, so a key that it misses is met whole all the same
    some = lines.where(F.pmod(F.xxhash64("node", F.lit(1)), F.lit(EVERY)) == 0).select(F.explode("keys").alias("key"))
    hot = some.groupBy("key").agg((F.count("*") * EVERY).alias("members")).where(F.col("members") > BLOCK)
    hot = written(hot, "line-hot-blocks")
    # a number names a part; those of blocks are negative, and a part that gets more than one key keeps them apart
    part = F.pmod(F.xxhash64("key"), F.lit(parts))
    if hot.isEmpty():
        met = rows.select(part.alias("part"), *columns)
    else:
        sized = rows.join(hinted(hot), "key", "left")
        blocks = F.ceil(F.col("members") / BLOCK).cast("int")
        mine = F.pmod(F.xxhash64("node"), blocks).cast("int")
        pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: -1 - F.shiftrightunsigned(F.xxhash64("key", F.least(o, mine), F.greatest(o, mine)), 1))
        met = sized.select(F.explode_outer(F.when(F.col("members").isNull(), F.array(part)).otherwise(pairs)).alias("part"), *columns)

    def meet(table: pa.Table) -> pa.Table:
        key, node, size = (table.column(c).to_numpy() for c in ("key", "node", "n"))
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
        order = order[~(new & np.append(new[1:], True))]  # most keys are of one line
        order = order[np.lexsort((size[order], key[order]))]
        key, node, size = key[order], node[order], size[order]
        pairs = _Filter(pd.DataFrame({c: table.column(c).to_numpy()[order] for c in ("n", *SIGNS[:WORDS])}), share)
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
        ends = np.concatenate([starts[1:], [len(key)]])[: len(starts)]
        u, v, dense = _in_windows(pairs, starts, ends, np.floor(size / share + 1e-9))
        u, v = [node[u]], [node[v]]
        for s, e in zip(starts[dense].tolist(), ends[dense].tolist(), strict=True):
            x, y = _tree(pairs, s, e)
            u.append(node[s:e][x])
            v.append(node[s:e][y])
        u, v = _forest(np.concatenate(u), np.concatenate(v))
        return pa.table({"u": u, "v": v})

    return met.groupBy("part").applyInArrow(meet, "u bigint, v bigint")


def dealt(rows: DataFrame, group: Column, members: Column, columns: list[str], block: int = BLOCK) -> DataFrame:
    """(part, a, b, columns): the rows of large groups, once for each pair of blocks that their block is in. Needs ``node``."""
    blocks = F.ceil(members / block).cast("int")
    mine = F.pmod(F.xxhash64("node"), blocks).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.struct(F.least(o, mine).alias("a"), F.greatest(o, mine).alias("b")))
    spread = rows.select(group.alias("part"), F.explode_outer(pairs).alias("p"), *columns)
    return spread.select("part", "p.a", "p.b", *columns)


def _alike_words(a: Sequence, b: Sequence, share: float) -> bool:
    """Whether two lines are linked."""
    longer = max(len(a), len(b))
    # words changed in place bound the distance from above, in one pass
    if len(a) == len(b) and longer - sum(map(ne, a, b)) >= share * longer:
        return True
    return longer - edit_distance(a, b, int((1 - share) * longer) + 1) >= share * longer


def _verified(pairs: DataFrame, texts: DataFrame, share: float) -> DataFrame:
    """(u, v): the pairs that are linked."""

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            linked = [_alike_words(a.split(" "), b.split(" "), share) for a, b in zip(rows["a"], rows["b"], strict=True)]
            yield rows.loc[np.array(linked, bool), ["u", "v"]]

    one = pairs.join(texts.select(F.col("node").alias("u"), F.col("norm").alias("a")), "u")
    both = one.join(texts.select(F.col("node").alias("v"), F.col("norm").alias("b")), "v")
    return both.select("u", "v", "a", "b").mapInPandas(verify, "u bigint, v bigint")


def _near_pairs(pairs: _Filter | _Near, starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows, pair by pair, that may be linked, of groups that begin and end there; all groups of few rows at once, larger ones row by row."""
    sizes = ends - starts
    last = np.repeat(np.where(sizes <= FEW, ends, 0), sizes)
    xs = np.arange(len(last))
    for step in range(1, FEW):
        xs = xs[xs + step < last[xs]]
        if not len(xs):
            break
        near = xs[pairs.near(xs, xs + step)]
        yield near, near + step
    for s, e in zip(starts[sizes > FEW].tolist(), ends[sizes > FEW].tolist(), strict=True):
        for x in range(s, e - 1):
            others = np.arange(x + 1, e)
            others = others[pairs.near(np.full(len(others), x), others)]
            yield np.full(len(others), x), others


def _links(groups: DataFrame, share: float, told: type) -> DataFrame:
    """(u, v): verified links, a spanning forest of each part."""

    def verify(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["component", "node"], ignore_index=True)
        group, node, text = rows["component"].to_numpy(), rows["node"].to_numpy(), [t.split(" ") for t in rows["norm"]]
        pairs = told(rows, share)
        forest, u, v = _Forest(len(rows)), [], []
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        ends = np.append(starts[1:], len(group))
        for xs, ys in _near_pairs(pairs, starts, ends):
            for x, y in zip(xs.tolist(), ys.tolist(), strict=True):
                if forest.root(x) != forest.root(y) and _alike_words(text[x], text[y], share):
                    forest.join(x, y)
                    u.append(node[x])
                    v.append(node[y])
        return pd.DataFrame({"u": u, "v": v}, dtype="int64")

    return groups.groupBy("part", "a", "b").applyInPandas(verify, "u bigint, v bigint")


def repeated_lines(
    documents: DataFrame, id: str = "doc_id", text: str = "text", share: float = SHARE, exact: bool = True
) -> DataFrame:
    """(id, rk, line): the lines, numbered from 0 in their text, that repeat an earlier one. ``rk`` is a hash of the text.

    Lines that differ in case, spaces or punctuation only are equal; others are
    linked if 1 - edit distance / longer length, both in words, is at least
    ``share``: all equal lines are found, and all others too, unless ``exact`` is
    false; then of the others those whose SimHashes agree in a block. The first
    line of a group stays, by id, text hash and number. Lines without a letter or
    digit count as no repeats, so NULL, empty and blank texts have none. Rows that repeat both id and text are one document here. Documents
    with a NULL id come last.
    """
    ship(documents.sparkSession)
    rows = documents.select(F.col(id).alias("id"), F.xxhash64(F.col(text)).alias("rk"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if exact:
        told, signs = _Filter, SIGNS
        with arrow_rows(documents.sparkSession, 20 * TEXTS):
            each = written(_lines(rows, share), "lines")
        carried = [*SIGNS, "keys"]
    else:
        told, signs = _Near, NEAR
        bits, blocks = blocks_for(rows.agg(F.sum(F.size(F.split("text", "\n", -1)))).first()[0] or 0, share)
        words = max(CHECKS, -(-bits * blocks // 64))
        each = written(_hashed_lines(rows, share, words), "lines")
        carried = ["sig", *NEAR]
    place = F.struct(F.col("id").isNull().alias("last"), "id", "rk", "line")
    classes = each.groupBy("l1", "l2").agg(F.min(place).alias("first"), F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("n", *carried)])
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "line-classes")
    if exact:
        near = written(_candidates(classes, share).withColumn("tree", F.lit(True)), "line-candidates")
    else:
        met = written(_meeting(classes, share, bits, blocks), "line-meetings")
        near = written(_alike(met, classes, share), "line-candidates")
        discard(met)
    nodes = near.select(F.col("u").alias("node")).union(near.select("v")).distinct()
    # only candidates' texts are fetched: each class's first line, by the texts that hold it
    line = F.struct(F.col("first.line").alias("line"), "node", "n", *signs)
    held = nodes.join(classes, "node").groupBy(F.col("first.id").alias("of"), F.col("first.rk").alias("of_rk")).agg(F.collect_list(line).alias("held"))
    held = hinted(written(held, "line-members"), 200_000)
    at = F.col("of").eqNullSafe(F.col("id")) & (F.col("of_rk") == F.col("rk"))
    said = let(F.split("text", "\n", -1), lambda lines: F.transform("held", lambda x: F.struct(x.alias("held"), F.get(lines, x["line"]).alias("body"))))
    texts = rows.join(held, at).select(F.explode(said).alias("x")).select("x.held.*", "x.body")
    texts = written(texts.select("node", normalised(F.col("body")).alias("norm"), "n", *signs).dropDuplicates(["node"]), "line-texts")
    discard(held)
    # pairs are verified one by one; what a tree connects is verified pair by pair inside its group
    groups = written(components(near.where("tree").select("u", "v")), "line-groups")
    sized = texts.join(groups.join(groups.groupBy("component").agg(F.count("*").alias("members")), "component"), "node")
    parts = max(1, -(-groups.count() // BLOCK))
    columns = ["node", "component", "norm", "n", *signs]
    few = sized.where(F.col("members") <= BLOCK).select(
        F.concat(F.lit("p"), F.pmod(F.xxhash64("component"), F.lit(parts))).alias("part"), F.lit(0).alias("a"), F.lit(0).alias("b"), *columns
    )
    many = dealt(sized.where(F.col("members") > BLOCK), F.col("component").cast("string"), F.col("members"), columns)
    links = _links(few.unionByName(many), share, told)
    if not exact:
        links = links.unionByName(_verified(near.where("not tree"), texts, share))
    links = written(links, "line-links")
    discard(near, groups, texts)
    linked = written(components(links).withColumnsRenamed({"component": "grp"}), "line-components")
    discard(links)
    # most classes have one line and no link: only others need a look
    places = classes.select("node", "l1", "l2", "first", "copies")
    tied = places.join(linked, "node")
    firsts = tied.groupBy("grp").agg(F.min("first").alias("kept"))
    alone = places.where("copies > 1").join(linked, "node", "left_anti").select("l1", "l2", F.col("first").alias("kept"))
    kept = written(tied.join(firsts, "grp").select("l1", "l2", "kept").unionByName(alone), "line-kept")
    discard(classes, linked)
    return each.join(hinted(kept, 200_000), ["l1", "l2"]).where(place != F.col("kept")).select("id", "rk", "line").distinct()


def _rest(text: Column, removed: Column) -> Column:
    """The text without the lines of these numbers; not by a Python function, which would hold whole texts several times."""

    def of(lines: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), removed)
        return F.array_join(F.transform(kept, lambda n: F.get(lines, n)), "\n")

    return let(F.split(text, "\n", -1), of)


def without_repeated_lines(documents: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents, all columns, their texts without repeated lines; a text of which no line stays is ''.

    A NULL text stays NULL, and a text without repeated lines as it is. Also
    adds ``n_removed_lines`` (a ``_`` more if that column exists).
    """
    gone = repeated_lines(documents, id, text, **options)
    gone = gone.groupBy("id", "rk").agg(F.collect_list("line").alias("lines"))  # at most a text's own lines
    names = {}
    for name in ("removed_lines", "n_removed_lines", "id_of_lines", "text_of_lines"):
        names[name] = fresh([documents], name)
    removed, count, of_id, of_text = names.values()
    gone = hinted(written(gone.select(F.col("id").alias(of_id), F.col("rk").alias(of_text), F.col("lines").alias(removed)), "lines-gone"), 200_000)
    at = F.col(f"`{id}`").eqNullSafe(F.col(of_id)) & (F.xxhash64(F.col(f"`{text}`")) == F.col(of_text))
    joined = documents.join(gone, at, "left").drop(of_id, of_text)

    cut = joined.withColumn(count, F.coalesce(F.size(removed), F.lit(0)).cast("bigint"))
    cut = cut.withColumn(count, F.when(F.col(removed).isNull(), 0).otherwise(F.col(count)).cast("bigint"))
    return cut.withColumn(text, F.when(F.col(removed).isNull(), F.col(text)).otherwise(_rest(F.col(text), F.col(removed)))).drop(removed)
