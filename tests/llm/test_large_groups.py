"""Large candidate groups send what grows with them and not with their square."""

import random

import pytest

from lakewarden.llm import jaccard

WORDS = [f"w{n}" for n in range(4000)]


def components_of(texts: list[str], share: float) -> list[int]:
    """By all pairs."""
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            if len(sets[x] & sets[y]) >= share * len(sets[x] | sets[y]):
                up[max(root(x), root(y))] = min(root(x), root(y))
    return [root(x) for x in range(len(sets))]


@pytest.fixture
def sent(monkeypatch):
    """Rows that went to the join of groups."""
    rows, join = [], jaccard._group_links

    def counted(groups, share):
        rows.append(groups.count())
        return join(groups, share)

    monkeypatch.setattr(jaccard, "_group_links", counted)
    return rows


def similar(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return [r.component_id for r in jaccard.similar(docs, share=0.8, block=10).orderBy("doc_id").collect()]


def test_sets_of_a_common_passage_are_not_joined(spark, sent):
    draw = random.Random(3)
    passage = draw.choices(WORDS, k=100)
    texts = [" ".join(passage + draw.choices(WORDS, k=100)) for _ in range(120)]
    texts += [t + " more" for t in texts[:7]]
    assert similar(spark, texts) == [*range(120), *range(7)] == components_of(texts, 0.8)
    assert sum(sent) <= 3 * len(texts)


def test_copies_of_a_text_meet_once(spark, sent):
    draw = random.Random(4)
    text = draw.choices(WORDS, k=150)
    texts = []
    for _ in range(150):
        own = list(text)
        own[draw.randrange(150)] = draw.choice(WORDS)
        texts.append(" ".join(own))
    assert similar(spark, texts) == [0] * 150
    assert sum(sent) <= 3 * len(texts)


def test_sets_beside_the_largest_component_meet_all(spark, sent):
    """Groups whose sets hang together over few links, and some of them far off."""
    draw = random.Random(5)
    text = draw.choices(WORDS, k=120)
    texts = []
    for _ in range(140):
        own = list(text)
        for place in draw.sample(range(120), draw.choice([0, 1, 1, 2, 3, 4, 6])):
            own[place] = draw.choice(WORDS)
        texts.append(" ".join(own))
    wanted = components_of(texts, 0.8)
    assert 3 < len(set(wanted)) < 140 and similar(spark, texts) == wanted
