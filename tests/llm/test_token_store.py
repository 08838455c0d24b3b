import zlib

import numpy as np
import public_tokenizers
import pytest
from llm.conftest import ODD_TEXTS, with_clashes
from tokenizers import Tokenizer

from tramline.llm import token_store

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    library = Tokenizer.from_file(PATH)
    library.encode_special_tokens = True
    return library


def test_elias_fano_gives_back_what_it_packed():
    rng = np.random.default_rng(3)
    for n, bound in ((0, 1), (1, 1), (1, 10**12), (1000, 3), (3000, 10**9), (700, 700)):
        values = np.sort(rng.integers(0, bound, n))
        packed = token_store.EliasFano(token_store.EliasFano.pack(values))
        assert packed.all().tolist() == values.tolist() == [packed.get(i) for i in range(n)]
    dense = token_store.EliasFano.pack(np.arange(100_000) * 500)
    assert len(dense) < 100_000 * (2 + 10) / 8 + 2000
    with pytest.raises(IndexError):
        packed.get(700)


def test_files_hold_the_ids_of_the_library(spark, folder, library, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    odd = [*ODD_TEXTS, "<|endoftext|> x", "a \n b\n\nc  d\n", "tab\tand \r\n line", "don't　wide"]
    docs = docs.unionByName(spark.createDataFrame([(10**9 + i, t) for i, t in enumerate(odd)], docs.schema))
    out = f"file://{tmp_path}/store"
    manifest = token_store.write_shards(with_clashes(docs), PATH, out, shard_chars=40_000)
    assert len(manifest) > 3
    got = sorted(map(tuple, token_store.read_shards(spark, out).collect()))
    want, start = [], 0
    for doc_id, text in sorted(docs.collect(), key=lambda r: r[0]):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    shard = token_store.Shard(manifest[1]["file"])
    own = [w for w in want if manifest[1]["before"] <= w[1] < manifest[2]["before"]]
    assert [shard.doc_id(i) for i in range(shard.n)] == [w[0] for w in own]
    assert [zlib.crc32(shard.ids(i).astype("<u4").tobytes()) for i in range(shard.n)] == [w[3] for w in own]


def test_edge_cases(spark, tmp_path):
    docs = spark.createDataFrame([(None, "b"), (2, None), (2, "a"), (2, "a"), (1, "")], "doc_id long, text string")
    token_store.write_shards(docs, PATH, f"file://{tmp_path}/a")
    got = [tuple(r) for r in token_store.read_shards(spark, f"file://{tmp_path}/a").orderBy("start").collect()]
    assert [(r[0], r[1], r[2]) for r in got] == [(None, 0, 2), (1, 2, 1), (2, 3, 1), (2, 4, 2), (2, 6, 2)]
    assert token_store.write_shards(docs.limit(0), PATH, f"file://{tmp_path}/b") == []
    assert token_store.read_shards(spark, f"file://{tmp_path}/b").count() == 0


def test_query_gives_special_tokens_their_ids_as_the_library_does(spark, tmp_path):
    texts = ["a<|endoftext|>b", "<|endoftext|>", "plain words", None, " <|endoftext|>  <|endoftext|>\n x<|endoftext", "after", *[t for t in ODD_TEXTS if t]]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    library = Tokenizer.from_file(PATH)
    assert library.encode(texts[0], add_special_tokens=False).ids == [64, 50256, 65]
    want, start = [], 0
    for doc_id, text in enumerate(texts):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, token_store.op5_token_store(spark, str(tmp_path)).collect())) == want
