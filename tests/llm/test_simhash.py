import random
import re

import numpy as np
import xxhash
from llm.conftest import ODD_TEXTS, Links, with_clashes

from tramline.llm import simhash

DOC = "doc_id long, text string"


def plain_print(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    size = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + size]).encode(), 42) for i in range(len(words) - size + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_are_the_plain_ones(spark, folder):
    texts = [*ODD_TEXTS, "A\u001cb C\u0085d e", "Straße ÄÖ Äö", *[r.text for r in spark.read.parquet(f"{folder}/documents.parquet").limit(60).collect()]]
    assert [simhash.fingerprint(t) for t in texts] == [plain_print(t) for t in texts]


def test_keys_meet_for_all_prints_within_three_bits():
    rng = random.Random(5)
    for _ in range(1500):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randrange(1, 4)):
            b ^= 1 << bit
        probe, index = (set(simhash.join_keys(np.array([x], np.uint64), p)[1].tolist()) for x, p in ((a, True), (b, False)))
        assert probe & index


def test_components_are_those_of_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, plain_print(r.text)) for r in docs.collect()]
    links = Links(i for i, _ in rows)
    for i, x in rows:
        for j, y in rows:
            if i < j and (x ^ y).bit_count() <= 3:
                links.join(i, j)
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.simhash_components(docs).collect()}
    assert got == {i: (x, links.root(i)) for i, x in rows}


def test_edge_cases(spark):
    rows = [(i, t) for i, t in enumerate(ODD_TEXTS, 10)] + [(None, ""), (None, "a lone text of a null id"), (10, None)]
    got = simhash.simhash_components(with_clashes(spark.createDataFrame(rows, DOC)))
    assert got.columns == ["doc_id", "fp", "component_id"] and got.count() == len(rows)
    found = {(r.doc_id, r.component_id) for r in got.collect()}
    assert {(10, 10), (11, 10), (12, 10), (13, 10), (None, 10), (None, None), (22, 21)} <= found
    assert simhash.simhash_components(spark.createDataFrame([], DOC)).count() == 0
    kept = simhash.keep_first(spark.createDataFrame([(1, "a b c d"), (2, "a b c d"), (3, "quite another text"), (None, "a b c d")], DOC))
    assert sorted(kept.collect(), key=str) == sorted(kept.where("doc_id IN (1, 3) OR doc_id IS NULL").collect(), key=str) and kept.count() == 3
