"""Notices count whatever the sample holds and whatever stands around them on their line."""

import pytest

from lakewarden.llm import licences

A = "one two three four five six seven eight nine ten eleven twelve"
WORDS = "mit license released under apache gnu general public cc by 4.0 bsd clause permission granted software creative commons rights reserved"


@pytest.fixture(scope="module")
def model(spark):
    # a sample that uses every telling word once
    return licences.train(spark.createDataFrame([(n, f"{A} {w} {A}") for n, w in enumerate(WORDS.split())], "doc_id bigint, text string"))


CASES = [
    ("Released under the MIT License.", ["mit"]),
    ("Copyright 2021 Foo Ltd. Released under the MIT License. See the LICENSE file for details.", ["mit"]),
    ("The data set was collected in 2019 and is licensed under CC BY 4.0. Please cite the paper when you use it.", ["cc-by"]),
    (f"{A} {A} This work is licensed under the GNU General Public License, version 3. {A} {A}", ["gpl"]),
    (f"{A} Released under the BSD 3-Clause License. {A} {A} Licensed under the Apache License, Version 2.0. {A}", ["apache-2.0", "bsd"]),
    (f"{A} the software of the public and the work is under the {A}", []),
    ("He obtained a copy of the notice and the rest of the list of conditions in the public library.", []),
    (A, []),
]


def test_notices_among_other_text(spark, model):
    docs = spark.createDataFrame([(n, t) for n, (t, _) in enumerate(CASES)], "doc_id bigint, text string")
    got = {r.doc_id: (r.families, r.n_confirmed) for r in licences.licences(docs, model).collect()}
    assert got == {n: (f, int(bool(f))) for n, (_, f) in enumerate(CASES)}
