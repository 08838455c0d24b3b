import base64
import hashlib

import public_tokenizers
import pytest
import tiktoken
from llm.conftest import ODD_TEXTS, with_clashes

from tramline.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_rows_are_those_of_the_library(spark, folder, library):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    odd = [*ODD_TEXTS, "<|endoftext|>", "aaaa" * 999 + "\x00\x01", "  \n \t  x", "𝒳𝒴 ​́", "١٢٣ 1234567 3.14", "I'LL we'll 'tis"]
    docs = docs.unionByName(spark.createDataFrame([(-i - 1, t) for i, t in enumerate(odd)], docs.schema))
    rows = {r.doc_id: r for r in byte_bpe.encoded(with_clashes(docs), PATH, public_tokenizers.PATTERN).collect()}
    for doc_id, text in docs.collect():
        ids = library.encode_ordinary(text or "")
        assert (rows[doc_id].ids, rows[doc_id].n_tokens) == (ids, len(ids))
        assert rows[doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[doc_id].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_edge_cases(spark):
    docs = spark.createDataFrame([(None, "x"), (1, None), (1, "x"), (1, "x")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_tokens) for r in byte_bpe.encoded(docs, PATH, public_tokenizers.PATTERN).collect()) == [(0, 1), (1, 0), (1, 1), (1, 1)]
    assert byte_bpe.encoded(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
