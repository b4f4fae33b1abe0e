"""The prefix trie against brute force, with copies, prefixes, long conversations and odd rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from lakewarden.llm import tries

SCHEMA = "conv_id bigint, turn bigint, role string, text string, conv string, depth int, range int, p1 string"


def made(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, "y") for r in rows], SCHEMA)


def conversations_of(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            out[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(turns, key=lambda t: t[:2])] for c, turns in out.items()}


def joined(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = convs.get(c - c % 20, [])[:h] + own[h:]
    return out


def brute(convs):
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                children[tuple(turns[: d - 1])].add(tuple(turns[:d]))
        ends[tuple(turns)].append(c)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, own in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(own) - 1) * words
            leaves[node[:d]] += not children[node]
    return sorted(
        (
            (min(own), len(n), min(members[n[:-1]]) if n else None, len(own), len(children[n]), leaves[n], saved[n],
             hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest())
            for n, own in members.items()
        ),
        key=str,
    )


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def branching(seed, n=120):
    """Conversations over few texts, so they share prefixes, repeat and end inside each other."""
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(-40, 400), n):
        for turn in range(rng.choice([1, 1, 2, 3, 4, 6])):
            rows.append((c, turn, "user" if turn % 2 == 0 else "assistant", rng.choice(["a b", "a  b c", "", "x\ny"])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_by_brute_force(spark, seed):
    rows = branching(seed)
    random.Random(seed).shuffle(rows)
    df = made(spark, rows)
    convs = conversations_of(rows)
    assert rows_of(tries.prefix_trie(df)) == brute(convs)
    assert rows_of(tries.trie(*tries.rebuilt(tries.turns_of(df)))) == brute(joined(convs))


def test_one_conversation_with_most_turns_and_many_copies(spark):
    rows = [(7, t, "user", f"w{t % 5}") for t in range(3000)] + [(8, t, "user", f"w{t % 5}") for t in range(1500)]
    rows += [(100 + c, t, "user", f"w{t}") for c in range(400) for t in range(2)]
    shuffle = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        got = tries.prefix_trie(made(spark, rows))
        assert rows_of(got) == fast(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", shuffle)


def fast(rows):
    """Brute force of the case above, whose prefixes all lie on one line: w0 w1 ... w4 w0 ..."""
    convs = conversations_of(rows)
    lengths = {c: len(t) for c, t in convs.items()}
    out, saved = [], 0
    for d in range(max(lengths.values()), -1, -1):
        own = [c for c, n in lengths.items() if n >= d]
        saved += (len(own) - 1) * (d > 0)
        ends = ",".join(str(c) for c in sorted(lengths) if lengths[c] == d)
        out.append((min(own), d, min(c for c, n in lengths.items() if n >= d - 1) if d else None, len(own), int(d < max(lengths.values())), 1, saved,
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def test_odd_rows(spark):
    rows = [(20, None, None, None), (20, 1, "user", "hi there"), (21, 5, "user", "hi there"), (21, None, None, ""), (22, 1, "", None),
            (23, 1, "user", "same"), (23, 1, "user", "same"), (None, 1, "user", "lost"), (-3, 2, "user", "w " * 20_000)]
    convs = conversations_of(rows)
    assert rows_of(tries.prefix_trie(made(spark, rows))) == brute(convs)
    assert rows_of(tries.trie(*tries.rebuilt(tries.turns_of(made(spark, rows))))) == brute(joined(convs))
    none = tries.prefix_trie(made(spark, []))
    assert none.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"] and none.count() == 0


def test_tied_turns_have_one_order(spark):
    rows = [(1, 1, "user", "a"), (1, 1, "user", "b"), (2, 1, "user", "b"), (2, 1, "user", "a")]
    got = tries.prefix_trie(made(spark, rows)).collect()
    assert len(got) == 3 and all(r.n_convs == 2 for r in got)
