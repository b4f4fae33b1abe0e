"""What op9_repeats holds in Python does not grow with how much of the texts repeats."""

import random
import tracemalloc

import numpy as np
import pytest

from lakewarden.llm import repeats


def peak_mb(work):
    tracemalloc.start()
    try:
        out = work()
        return out, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_homes_and_passages_of_a_chunk():
    data = np.random.default_rng(1).integers(97, 123, 4_000_000, dtype=np.uint8).tobytes()
    sizes = np.full(1000, 4000)
    homes, held = peak_mb(lambda: repeats.Homes(data, sizes, 50))
    assert held < 80  # all at once were 216
    every = np.ones(len(homes.keys(40)[0]), bool)
    passages, held = peak_mb(lambda: homes.passages(np.arange(1000), 40, every, every, ~every))
    assert held < 180 and len(passages["first"]) > 200_000  # 234


def test_strings_of_a_part_that_repeats_throughout():
    draw = np.random.default_rng(2)
    size = np.full(120_000, 66)
    data = draw.integers(97, 123, size.sum() // 2, dtype=np.uint8)
    data = np.concatenate([data, data])
    found, held = peak_mb(lambda: repeats.repeated_strings(data, size, np.arange(120_000), 50))
    assert held < 80 and found.sum() == len(found) // 2 and not found[: len(found) // 2].any()


@pytest.mark.parametrize("strings,rows", [(7, 3), (40, 10), (10**6, 10**6)])
def test_slices_give_what_the_whole_gives(monkeypatch, strings, rows):
    monkeypatch.setattr(repeats, "STRINGS", strings)
    monkeypatch.setattr(repeats, "ROWS", rows)
    draw = random.Random(6)
    texts = ["".join(draw.choices("ab", k=draw.choice([0, 5, 30, 80]))).encode() for _ in range(25)] + [b"a" * 90]
    texts += [t[k:] + b"b" for k, t in enumerate(texts)]
    data, length = b"".join(texts), 20
    homes = repeats.Homes(data, np.array([len(t) for t in texts]), length)
    starts = [p for d, t in enumerate(texts) for p in range(sum(map(len, texts[:d])), sum(map(len, texts[: d + 1])) - length + 1)]
    assert sorted(x for a, b in zip(homes.first, homes.last, strict=True) for x in range(a, b + 1)) == starts
    assert (homes.gram[1:] != homes.gram[:-1]).all() and (homes.first <= homes.gram).all() and (homes.gram + repeats.GRAM <= homes.first + length).all()
    every = np.ones(len(homes.keys(3)[0]), bool)
    ids = np.arange(len(texts))
    for hot, hottest in ((~every, ~every), (every, ~every), (every, every)):
        p = homes.passages(ids, 3, every, hot, hottest)
        rows_of = [(part, size, data[f : f + size]) for part, size, f in zip(p["part"], p["sizes"], p["first"][p["one"]], strict=True)]
        assert rows_of == sorted(set(rows_of))
        assert all(rows_of[o][1:] == (n, data[f : f + n]) for o, n, f in zip(p["of"], p["size"], p["first"], strict=True))
        raw = np.frombuffer(b"".join(r[2] for r in rows_of), np.uint8)
        found = repeats.repeated_strings(raw, p["sizes"], p["owner"], length)
        held = [(r[2][i : i + length], o) for r, o in zip(rows_of, p["owner"], strict=True) for i in range(r[1] - length + 1)]
        least = {}
        for s, o in held:
            least[s] = min(o, least.get(s, o))
        assert found.tolist() == [least[s] < o for s, o in held] and (hottest.any() or found.any())
