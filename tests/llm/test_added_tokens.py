"""Texts that hold an added token have the ids of the JSON file's tokenizer."""

import zlib

from lakewarden.llm import pack
from lakewarden.llm.queries import QUERIES


def test_packing_of_added_tokens(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a<|endoftext|>b", "<|endoftext|>", "<|endoftext|><|endoftext|> caf\u00e9 ", "\u65e5\u672c<|endoftext|>\u8a9e", "<|endoftext", "plain"]
    expected = [[*slow.encode(t, add_special_tokens=False).ids, pack.END_ID] for t in texts]
    assert expected[0] == [64, 50256, 65, 2]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in QUERIES["op6_packing"](spark, str(tmp_path)).collect()}
    for n, ids in enumerate(expected):
        assert (rows[n].length, rows[n].ids_crc32) == (len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)))
    kept = {r.doc_id: list(r.ids) for r in pack.packed(docs, keep_ids=True).collect()}
    assert kept == dict(enumerate(expected))
