"""Every registered query on the smallest tables: against SQL, or against brute force in plain Python."""

import hashlib
import re
import zlib
from itertools import combinations

import pytest

from checks.compare import compare, duck
from lakewarden.llm.oracles import ORACLES
from lakewarden.llm.queries import QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def con(small):
    return duck(small)


@pytest.fixture(scope="module")
def texts(spark, small):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}


@pytest.mark.parametrize("name", ORACLES)
def test_against_sql(spark, con, small, name):
    count, problem = compare(spark, con, small, QUERIES[name], ORACLES[name])
    assert count and problem == ""


def test_similar_documents_by_brute_force(spark, small, texts):
    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))
        return {tuple(words[i : i + 3]) for i in range(len(words) - 2)} if len(words) > 2 else {tuple(words)} - {()}

    sets = {i: shingles(t) for i, t in texts.items()}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for x, y in combinations(sorted(sets), 2):
        a, b = sets[x], sets[y]
        if a and b and 100 * len(a & b) >= 90 * len(a | b):
            up[max(root(x), root(y))] = min(root(x), root(y))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op5_jaccard"](spark, small).collect()}
    assert got == {i: (len(s), root(i)) for i, s in sets.items()}
    assert any(root(i) != i for i in sets)


def removed_by_brute_force(rows, length=50):
    """By (id, body): the kept bytes, and the number of removed runs."""
    where = {}
    for i, body in rows:
        for k in range(len(body) - length + 1):
            piece = body[k : k + length]
            where[piece] = min(i, where.get(piece, i))
    out = []
    for i, body in rows:
        gone = bytearray(len(body))
        for k in range(len(body) - length + 1):
            if where[body[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        out.append((i, len(body), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(c for c, g in zip(body, gone) if not g)))
    return out


def test_repeats_by_brute_force(spark, small, texts):
    expected = {
        i: (n, removed, spans, hashlib.sha256(kept).hexdigest())
        for i, n, removed, spans, kept in removed_by_brute_force([(i, t.encode()) for i, t in texts.items()])
    }
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op9_repeats"](spark, small).collect()}
    assert got == expected
    assert any(e[1] for e in expected.values())


def test_packing_round_trip(spark, small, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = QUERIES["op6_packing"](spark, small).collect()
    pieces = {}
    for r in sorted(rows, key=lambda r: r.start):
        pieces.setdefault(r.doc_id, []).append(r)
    assert pieces.keys() == texts.keys()
    for i, text in texts.items():
        ids = [*slow.encode(text, add_special_tokens=False).ids, 2]
        mine = pieces[i]
        assert [r.piece for r in mine] == list(range(len(mine)))
        assert sum(r.length for r in mine) == len(ids)
        assert len(mine) == 1 or all(r.length == 1024 for r in mine[1:])
        assert len(ids) > 1024 or len(mine) == 1
        for r in mine:
            part = b"".join(t.to_bytes(4, "little") for t in ids[r.start : r.start + r.length])
            assert r.ids_crc32 == zlib.crc32(part)
    sequences = {}
    for r in sorted(rows, key=lambda r: r.offset):
        assert r.offset == sequences.get(r.sequence_id, 0)
        sequences[r.sequence_id] = r.offset + r.length
    assert max(sequences.values()) <= 1024
    assert len(sequences) <= 1.03 * -(-sum(r.length for r in rows) // 1024) + 2


def test_toxicity_on_held_out_rows(spark, small):
    larger = small.replace("sf0.001", "sf0.01")
    got = {r.doc_id: r for r in QUERIES["op8_toxicity"](spark, larger).collect()}
    labels = spark.read.parquet(f"{larger}/labels.parquet").collect()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 for i, r in got.items())
    held = [(got[r.doc_id], r.toxic) for r in labels if got[r.doc_id].held_out]
    toxic, clean = [g for g, t in held if t], [g for g, t in held if not t]
    assert sum(g.predicted for g in toxic) >= 0.7 * len(toxic)
    assert sum(g.predicted for g in clean) <= 0.02 * len(clean)


def test_licences_of_planted_notices(spark, small, texts):
    notices = {"mit": "MIT License", "apache-2.0": "Apache License", "gpl": "GNU General Public", "cc-by-nc": "CC BY-NC"}
    expected = {i: ",".join(sorted(k for k, v in notices.items() if v in t)) for i, t in texts.items()}
    got = {r.doc_id: r.families for r in QUERIES["op2_licences"](spark, small).collect()}
    assert got == expected and any(expected.values())


def plain(line):
    return " ".join(re.findall(r"[^\W_]+", line.lower()))


def lines_by_brute_force(texts, share):
    """By document and line: which lines repeat an earlier one, all pairs compared, and which of them are equal to one."""
    from lakewarden.llm.lines import edit_distance

    places = [(i, n, plain(line)) for i, t in sorted(texts.items()) for n, line in enumerate(t.split("\n"))]
    places = [p for p in places if p[2]]
    distinct = sorted({line for _, _, line in places}, key=lambda line: len(line.split()))
    words = [line.split() for line in distinct]
    up = list(range(len(words)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for x, a in enumerate(words):
        for y in range(x + 1, len(words)):
            b = words[y]
            if len(a) < share * len(b):
                break
            if len(set(a) & set(b)) * 2 >= len(set(b)) and len(b) - edit_distance(a, b) >= share * len(b):
                up[root(y)] = root(x)
    group = {line: root(x) for x, line in enumerate(distinct)}
    first, same, gone, equal = {}, {}, set(), set()
    for i, n, line in places:  # by document and line
        if first.setdefault(group[line], (i, n)) != (i, n):
            gone.add((i, n))
        if same.setdefault(line, (i, n)) != (i, n):
            equal.add((i, n))
    return gone, equal


def test_lines_by_brute_force(spark, small, texts):
    from lakewarden.llm.lines import repeated_lines

    docs = spark.read.parquet(f"{small}/documents.parquet")
    gone, equal = lines_by_brute_force(texts, 0.8)
    assert {(r.id, r.line) for r in repeated_lines(docs, share=0.8, exact=True).collect()} == gone and gone > equal

    gone, equal = lines_by_brute_force(texts, 0.9)
    got = {(r.id, r.line) for r in repeated_lines(docs).collect()}
    assert equal <= got <= gone and equal
    assert len(got - equal) >= 0.9 * len(gone - equal)
    rows = QUERIES["op3_lines"](spark, small).collect()
    assert {r.doc_id: r.n_removed_lines for r in rows} == {i: sum(d == i for d, _ in got) for i in texts}
