"""NULLs, empty and long texts, ties, repeated rows, empty tables, clashing columns: each has a defined result."""

import pytest
from pyspark.sql import functions as F

from lakewarden.llm import chat, decontaminate, jaccard, licences, lines, pack, quality, repeats, secrets, toxicity

A = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
LONG = " ".join(f"w{i}" for i in range(20_000))
SCHEMA = "doc_id bigint, text string, id string, words string, h bigint, part int, node int, component int, rk string, rejected_by string"
ROWS = [(1, A), (2, A), (2, A), (3, None), (4, ""), (5, " \n\t "), (None, A + " token = abcdefgh12"), (6, LONG), (7, "É " + A), (8, "a")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", "y", 1, 2, 3, 4, "z", "q") for i, t in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def by_id(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_quality(docs, none):
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {1, 2, None, 6, 7} and kept.count() == 6
    assert quality.keep_good(none).count() == 0
    assert "rejected_by_" in quality.quality(docs).columns


def test_cascade_order_does_not_change_what_is_kept(docs):
    verdicts = []
    for rules in (quality.RULES, tuple(reversed(quality.RULES))):
        failed = quality.first_failed(list(rules), quality.of_text(F.col("text")))
        verdicts.append([r[0] for r in docs.select(failed.isNull()).collect()])
    assert verdicts[0] == verdicts[1]


def test_words_in_repeated_windows(spark):
    cases = [("a b c d e a b c d e", 10), ("a a a a a a", 6), ("a b c d e f", 0), ("a b c d e x a b c d e y a b c d e", 15), ("", 0)]
    df = spark.createDataFrame(cases, "text string, n int").withColumn("got", quality.MEASURES["n_repeat_words"](F.col("text")))
    assert [r.got for r in df.collect()] == [n for _, n in cases]


def test_decontamination(spark, docs, none):
    bench = spark.createDataFrame([(7, "TWO three, four"), (8, None), (None, "w5 w6"), (7, "zzz")], "item_id bigint, text string")
    found = decontaminate.contamination(docs, bench)
    rows = {(r.doc_id, r.n_hit, tuple(r["items"])) for r in found.collect()}
    assert (1, 3, ("7",)) in rows and (6, 2, ("",)) in rows and (3, 0, ()) in rows and (None, 3, ("7",)) in rows
    assert found.count() == docs.count()
    assert by_id(decontaminate.contamination(docs, bench, broadcast_rows=0), "doc_id", "n_hit") == by_id(found, "doc_id", "n_hit")
    clean = decontaminate.decontaminate(docs, bench)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {3, 4, 5, 8}
    assert decontaminate.contamination(none, bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).where("contaminated").count() == 0


def test_secrets(docs, none):
    rows = {r.doc_id: r.spans for r in secrets.secrets_by_document(docs).collect()}
    assert [(s.kind, s.end - s.start) for s in rows[None]] == [("assign", 18)] and rows[1] == [] and rows[3] == []
    assert secrets.secrets_by_document(docs).count() == docs.count()
    assert secrets.secrets_by_document(none).count() == 0


def test_trigram_queries_hold_for_every_match():
    import re

    samples = {"assign": ["password: abcdef", "API_KEY='x'", "Token=1", "apikey=2"], "jwt": ["eyJabcdefgh.eyJabcdefgh.x"],
               "private_key": ["-----BEGIN RSA PRIVATE KEY-----"], "stripe": ["sk_live_" + "a" * 16], "slack": ["xoxb-0123456789"]}
    for rule in secrets.RULES:
        query = secrets.trigram_query(rule.pattern)
        for text in samples.get(rule.kind, []):
            assert re.search(rule.pattern, text)
            assert any(all(t in text.lower() for t in clause) for clause in query)
    assert secrets.trigram_query("[a-f]{9}") == [] and secrets.trigram_query("(abc)?x") == []


def test_similar_documents(docs, none):
    found = jaccard.similar(docs)
    rows = by_id(found, "doc_id", "n_shingles", "component_id")
    assert rows.count((2, 12, 1)) == 2 and (1, 12, 1) in rows and (7, 13, 1) in rows
    assert (3, 0, 3) in rows and (8, 1, 8) in rows and (None, 15, None) in rows and len(rows) == len(ROWS)
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 3, 4, 5, None, 6, 8}
    assert jaccard.similar(none).count() == 0


def test_similar_documents_in_blocks(spark):
    words = [f"v{i}" for i in range(60)]
    rows = [(n, " ".join(w if k != n else "other" for k, w in enumerate(words))) for n in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.component_id for r in jaccard.similar(docs, share=0.8, block=7).collect()} == {0}


def test_packing(docs, none):
    rows = pack.packed(docs).collect()
    assert sorted({str(r.doc_id) for r in rows}) == sorted({str(i) for i, _ in ROWS})
    assert {r.length for r in rows if r.doc_id in (3, 4)} == {1}
    assert pack.packed(none).count() == 0
    for r in pack.sequences(docs).collect():
        assert len(r.ids) == sum(p.length for p in r.parts) <= 1024


def test_both_tokenizers_agree():
    import public_tokenizers
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    slow.encode_special_tokens = True
    latin = "".join(map(chr, range(256)))
    for text in (A, latin, latin * 3, "  a\u00a0 b\n\n c's 12 \x85 <|endoftext|>", "x" * 5000, "日本語 and 😀"):
        assert pack.encoder()(text) == slow.encode(text, add_special_tokens=False).ids


def test_chats(spark):
    rows = [(1, 0, "user", "a\\<s>b"), (1, 1, "assistant", "</s>[INST] \\ok\n"), (1, 1, "assistant", "again"), (None, 3, None, None),
            (2, 5, "assistant", "x"), (2, 2, "a\nb<|nl|>", "")]
    df = spark.createDataFrame([(*r, 9) for r in rows], "conv_id bigint, turn bigint, role string, text string, leaf int")
    chats = chat.format_chats(df)
    read = {r.conv: r for r in chats.select("conv", chat.read_back(F.col("text")).alias("turns"), chat.masked_text(F.col("text"), F.col("loss")).alias("m")).collect()}
    assert [tuple(t) for t in read[1].turns] == [("user", "a\\<s>b"), ("assistant", "</s>[INST] \\ok\n"), ("assistant", "again")]
    assert read[1].m == "</s>[INST] \\ok\nagain" and read[2].m == "x"
    assert [tuple(t) for t in read[2].turns] == [("a\nb<|nl|>", ""), ("assistant", "x")] and [tuple(t) for t in read[None].turns] == [("", "")]
    assert chat.format_chats(df.limit(0)).count() == 0


def test_reply_trees(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "a", 1.0), (1, 3, 1, "assistant", "b", 3.0), (1, 4, 2, "user", "c", 5.0),
            (1, 8, 9, "user", "x", 0.0), (1, 9, 8, "user", "y", 0.0), (2, 1, 77, "user", "z", None)]
    df = spark.createDataFrame(rows, "conv bigint, id bigint, parent bigint, role string, text string, score double")
    chosen = chat.formatted(chat.paths(df)).select("conv", "leaf", "branch", chat.read_back(F.col("text"))["text"].alias("t"))
    assert by_id(chosen, "conv", "leaf", "branch", "t") == [(1, 3, 2, ["q", "b"]), (1, 4, 1, ["q", "a", "c"]), (2, 1, 1, ["z"])]
    assert chat.paths(df, branches=1).select("conv", "leaf").distinct().count() == 2


def test_toxicity(spark, docs, none):
    bad = [(n, "you are a horrid fool and a dunce today", 1) for n in range(20)] + [(n, f"we like tea and cake number {n}", 0) for n in range(20, 400)]
    train = spark.createDataFrame([*bad, (900, None, 1), (901, "tea", None)], "doc_id bigint, text string, toxic int")
    model = toxicity.train(train.select("doc_id", "text"), train.select("doc_id", "toxic"))
    more = spark.createDataFrame([(1000, "a Fool!"), (1001, "tea"), (1002, None), (1003, "")], "doc_id bigint, text string")
    rows = {r.doc_id: r for r in toxicity.toxicity(more, model).collect()}
    assert rows[1000].score > 0.5 > rows[1001].score and rows[1002].score == rows[1003].score < 0.5
    assert [(s.start, s.end) for s in rows[1000].spans] == [(2, 6)]
    assert toxicity.toxicity(docs, model).count() == docs.count() and toxicity.toxicity(none, model).count() == 0
    blank = toxicity.train(none, train.select("doc_id", "toxic"))
    assert blank.stems == [] and len({r.score for r in toxicity.toxicity(docs, blank).collect()}) == 1


def test_marginals_equal_full_enumeration():
    import itertools

    import numpy as np

    model = toxicity.Model(["bad"], np.array([-1.0, 2.0]), into=-0.5, out=0.3, stay=0.2)
    classes = [0, 0, 1, 0, 1]
    total, one = 0.0, np.zeros(5)
    trans = {(0, 0): 0.0, (0, 1): -0.5, (1, 0): 0.3, (1, 1): 0.2}
    for y in itertools.product((0, 1), repeat=5):
        weight = np.exp(sum(trans[p] for p in zip((0, *y), y)) + sum(model.weights[c] for c, label in zip(classes, y) if label))
        total += weight
        one += weight * np.array(y)
    assert np.allclose(model.marginals([1, 1], [2, 1, 0]), (one / total)[[2, 4]])


def test_repeats(docs, none):
    rows = by_id(repeats.repeated_spans(docs), "doc_id", "n_bytes", "spans")
    assert len(rows) == len(ROWS)
    spans = {(r[0], tuple((s.start, s.end) for s in r[2])) for r in rows}
    assert (1, ()) in spans and (2, ((0, len(A)),)) in spans and (3, ()) in spans and (None, ()) in spans
    assert (7, ((2, 3 + len(A)),)) not in spans and (7, ((3, 3 + len(A)),)) in spans
    assert repeats.repeated_spans(none).count() == 0


def test_repeats_do_not_depend_on_the_parts(spark):
    from test_contracts import removed_by_brute_force

    rows = [(n, f"{n} " + A[n % 7 : 60 + n % 23] + f" {n * 7} " + A[5 : 58 + n % 3]) for n in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    expected = sorted((i, removed, runs) for i, _, removed, runs, _ in removed_by_brute_force([(i, t.encode()) for i, t in rows]))
    for options in ({}, {"chunk_bytes": 300, "part_bytes": 200, "hot_chunks": 2, "broadcast_bytes": 0}):
        found = repeats.repeated_spans(docs, **options).collect()
        assert sorted((r.doc_id, sum(s.end - s.start for s in r.spans), len(r.spans)) for r in found) == expected


def test_lines(spark, docs, none):
    long = A + " " + " ".join(f"word{n}" for n in range(40))
    rows = [(1, long + "\nshort\n" + long.upper() + "!"), (2, "new line with some words\n" + long.replace("five", "fife")), (3, None), (4, ""), (4, "short")]
    df = spark.createDataFrame([(*r, 5, 6) for r in rows], "doc_id bigint, text string, line int, n_removed_lines int")
    left = lines.without_repeated_lines(df)
    assert by_id(left, "doc_id", "text", "n_removed_lines_") == sorted(
        [(1, long + "\nshort", 1), (2, "new line with some words", 1), (3, None, 0), (4, "", 0), (4, "", 1)], key=str
    )
    # lines of one word count, and no column of the user's is taken for one of ours
    clash = df.withColumns({c: F.lit("mine") for c in ("_i", "_r", "removed_lines", "id_of_lines", "text_of_lines")})
    kept = lines.without_repeated_lines(clash)
    assert kept.columns == [*clash.columns, "n_removed_lines_"] and {r["_i"] + r["_r"] for r in kept.collect()} == {"minemine"}
    assert lines.without_repeated_lines(none).count() == 0
    assert lines.without_repeated_lines(docs).count() == docs.count()


def test_edit_distance():
    import random

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    draw = random.Random(1)
    for _ in range(500):
        a, b = ("".join(draw.choice("abc") for _ in range(draw.randint(0, 14))) for _ in range(2))
        assert lines.edit_distance(a, b) == plain(a, b)


def test_licences(spark, docs, none):
    notices = [(1, "intro\nLicensed under the Apache License, Version 2.0."), (2, "released under the mit license"), (3, None), (4, "you may go"),
               (5, "A licence to thrill"), (5, "Redistribution and use in source and binary forms, with or without modification, are permitted")]
    df = spark.createDataFrame([(*r, "x") for r in notices], "doc_id bigint, text string, line string")
    model = licences.train(docs)
    assert by_id(licences.licences(df, model), "doc_id", "families") == sorted(
        [(1, ["apache-2.0"]), (2, ["mit"]), (3, []), (4, []), (5, []), (5, ["bsd"])], key=str
    )
    assert licences.licences(none, model).count() == 0 and licences.train(none).families[-1] == "unknown"
