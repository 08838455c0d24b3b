import base64
import hashlib

import corpus_pipeline
import public_tokenizers
import tiktoken
from llm.conftest import Links
from llm.test_simhash import plain_print

from tramline.llm import quality


def shingles(text):
    words = "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def test_run_is_that_of_brute_force(spark, folder):
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    good = {r.doc_id for r in quality.score_quality(docs, quality.fit_quality(docs, labels)).where("score >= 0.5").collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect() if r.doc_id in good}

    holders = {}
    for i, t in texts.items():
        for line in t.split("\n"):
            if len(key(line)) >= 40:
                holders.setdefault(key(line), set()).add(i)
    texts = {i: "\n".join(x for x in t.split("\n") if len(holders.get(key(x), ())) < 5 or i == max(holders[key(x)])) for i, t in texts.items()}

    prints = {i: plain_print(t) for i, t in texts.items()}
    links = Links(prints)
    for i, x in prints.items():
        for j, y in prints.items():
            if i < j and (x ^ y).bit_count() <= 3:
                links.join(i, j)
    texts = {i: t for i, t in texts.items() if links.root(i) == i}

    items = [s for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect() if (s := shingles(r.text))]
    texts = {i: t for i, t in texts.items() if not any(len(s & shingles(t)) >= 0.8 * len(s) - 1e-9 for s in items)}

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {i: (ids := library.encode_ordinary(t), hashlib.sha256(t.encode()).hexdigest()) for i, t in texts.items()}
    got = {r.doc_id: (r.ids, r.decoded_sha256) for r in corpus_pipeline.run(spark, folder).collect()}
    assert got == want and 0 < len(got) < docs.count()


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).schema.names == docs.columns
