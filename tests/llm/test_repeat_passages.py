"""What a home's passages are cut into: few pieces for what many chunks hold, and no string lost."""

import numpy as np
import pytest

from lakewarden.llm import repeats

COMMON = b"a passage of sixteen and more bytes that every one of the documents holds"


def chunk(n):
    texts = [b"%d before %s behind %d" % (n * 1000 + k, COMMON[: 30 + k % 40], k * 77 + n) for k in range(50)]
    return repeats.Homes(b"".join(texts), np.array([len(t) for t in texts]), 50)


@pytest.mark.parametrize(("hot", "hottest"), [(False, False), (True, False), (True, True)])
def test_pieces_hold_each_string_once_and_equal_ones_meet(hot, hottest):
    where = {}
    for n in (1, 2):
        homes = chunk(n)
        keys = homes.keys(7)[0]
        p = homes.passages(np.arange(50), 7, *(np.full(len(keys), x) for x in (True, hot, hottest)))
        strings = p["size"] - 50 + 1
        starts = [int(f) + k for f, c in zip(p["first"], strings, strict=True) for k in range(c)]
        whole = [int(f) + k for f, e in zip(homes.first, homes.last, strict=True) for k in range(e - f + 1)]
        assert sorted(starts) == sorted(whole)
        data = homes.raw.tobytes()
        for first, c, of in zip(p["first"].tolist(), strings.tolist(), p["of"].tolist(), strict=True):
            for s in range(first, first + c):
                assert where.setdefault(data[s : s + 50], p["part"][of]) == p["part"][of]
        if hot and not hottest:
            assert len(p["first"]) <= 2 * len(homes.first)


def test_homes_of_many_chunks_are_not_sent_string_by_string(spark, monkeypatch):
    """With 64 chunks as the limit, and every string by itself beyond it, each took 62 bytes of a passage's share."""
    rows = [(n, f"{n * 7919} {COMMON.decode()} {n * 104729} {COMMON.decode()}") for n in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kinds = []
    answers = repeats._answers

    def kept(rows, columns, *rest):
        out = answers(rows, columns, *rest)
        if "hot" in columns:
            kinds.extend(out.collect())
        return out

    monkeypatch.setattr(repeats, "_answers", kept)
    found = repeats.repeated_spans(docs, chunk_bytes=500, part_bytes=2000).collect()
    assert len(kinds) > 64 and not any(any(map(any, r["hot"])) for r in kinds)
    assert all(sum(s.end - s.start for s in r.spans) >= 2 * len(COMMON) for r in found if r.doc_id)
    for r in repeats.repeated_spans(docs, chunk_bytes=500, part_bytes=2000, hot_chunks=20).collect():
        assert r in found
