"""SimHash near-dedup by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments A and B of 23 bits and C of 18. The (23,12) Golay code is perfect: each
23-bit word is within 3 bits of just one of 4,096 codewords. A word at 3 bits has five more codewords at 4 bits;
the indices of these (one or six) are its keys. Of two words that differ in at most one bit, each one's nearest
codeword is among the other's keys. Two fingerprints that differ in at most 3 bits then share a join key in one
of these cases, which cover all ways the errors can fall on the segments:

1. C is equal: A or B has at most one error.       C and a Golay key of A (or of B)
2. A is equal and B has at most one error.         A and a Golay key of B
3. A is equal, B has two errors, C one.            A and a half of C
4. The same two with A and B exchanged.
5. A, B and C have one error each.                 a Golay key of A, a half of B, a half of C

Candidates from these keys are verified on the whole fingerprints; links are closed to components.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm.graph import connected_components
from tramline.llm.shared import materialise, read_table, worker_state

SHINGLE_WORDS = 3
MAX_BITS = 3
HASH_SEED = 42
_POLY = 0b101011100011  # of the (23,12) Golay code


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator polynomial: equal for words whose difference is a codeword."""
    rest = words.astype(np.int64)
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (_POLY << (bit - 11)), rest)
    return rest


@lru_cache(maxsize=1)
def golay_errors() -> np.ndarray:
    """By syndrome: the error patterns of at most 3 bits (just one), then those of 4 bits where that one has 3; -1 pads."""
    table = np.full((2048, 6), -1, np.int64)
    fill = np.zeros(2048, int)
    for weight in range(5):
        patterns = np.array([sum(1 << b for b in c) for c in combinations(range(23), weight)] or [0], np.int64)
        for pattern, syndrome in zip(patterns.tolist(), _syndromes(patterns).tolist(), strict=True):
            table[syndrome, fill[syndrome]] = pattern
            fill[syndrome] += 1
    return table


def golay_keys(words: np.ndarray) -> np.ndarray:
    """Of each 23-bit word its one or six codeword indices (the code's 12 message bits); the nearest first, -1 pads."""
    errors = golay_errors()[_syndromes(words)]
    return np.where(errors < 0, -1, (words.astype(np.int64)[:, None] ^ errors) >> 11)


def join_keys(prints: np.ndarray, probe: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, keys) of uint64 fingerprints; the probing side has all Golay keys, the other the nearest only."""
    prints = prints.astype(np.uint64)
    a, b, c = ((prints >> np.uint64(s) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in ((41, 23), (18, 23), (0, 18)))
    ga, gb = (golay_keys(x)[:, : 6 if probe else 1] for x in (a, b))
    c_halves, b_halves = ((c >> 9) | 1 << 9, c & 511), ((b >> 12) | 1 << 12, b & 4095)
    parts = [(1, ga, c), (2, gb, c), (3, gb, a), (4, ga, b)]
    parts += [(10, np.zeros((len(a), 1), np.int64), a << 10 | half) for half in c_halves]
    parts += [(11, np.zeros((len(a), 1), np.int64), b << 10 | half) for half in c_halves]
    parts += [(12, ga, bh << 10 | ch) for bh in b_halves for ch in c_halves]
    rows, keys = [], []
    for tag, golay, rest in parts:
        at, k = np.nonzero(golay >= 0)
        rows.append(at)
        keys.append(tag << 56 | golay[at, k] << 40 | rest[at])
    return np.concatenate(rows), np.concatenate(keys)


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """SimHash of a text: bit i is set if over half of its shingles' XXH64 hashes (repeats included) have it set.

    A-Z are lower-cased; words lie between ASCII blanks; a text of fewer words is one shingle, one of none gives 0.
    """
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    joined, size = b" ".join(parts), min(words, len(parts))
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(parts) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    hashes = np.array([digest(joined[s:e], HASH_SEED) for s, e in spans], "<u8")
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):
        block = hashes[i : i + 65_536]
        counts += np.unpackbits(block.view(np.uint8).reshape(len(block), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((2 * counts > len(hashes)) @ (1 << np.arange(64, dtype=object)))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """``id_col`` and ``fp`` (the fingerprint's 64 bits as long) of every row; map-only, over Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_state("simhash", dict)  # nothing to keep; gives back what the operator before has kept
        for batch in batches:
            prints = [_signed(fingerprint(t, words)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], [id_col, "fp"])

    return docs.select(f"`{id_col}`", f"`{text_col}`").mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, fp long")


def _keyed(prints: DataFrame, probe: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(fps), 4096):
                rows, keys = join_keys(fps[i : i + 4096].view(np.uint64), probe)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[i : i + 4096][rows])], ["key", "fp"])

    return prints.select("fp").mapInArrow(run, "key long, fp long")


def similar_prints(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs ``fp`` < ``fp2`` of distinct fingerprints (column ``fp``) that differ in at most ``max_bits`` (3 or fewer)."""
    if max_bits > MAX_BITS:
        raise ValueError("the segment cases cover at most 3 bits")
    index = _keyed(prints, False).withColumnRenamed("fp", "fp2")
    pairs = _keyed(prints, True).join(index, "key").where((F.col("fp") < F.col("fp2")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= max_bits))
    return pairs.select("fp", "fp2").distinct()


def simhash_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """Per row of ``docs``: id, ``fp`` (long) and ``component_id`` (least id reachable by links, itself included).

    Null and empty texts have fingerprint 0 and link like any other. Repeated ids count once in a component. Rows
    with a null id get the component of their fingerprint but never name it (null if no other has it). Other columns
    are not read; an empty table gives an empty table.

    Plan: one pass computes fingerprints, which are written; equal ones are reduced to their least id on the map side,
    so copies never meet in the candidate join; links of distinct fingerprints go through ``connected_components``.
    """
    prints = materialise(fingerprints(docs, id_col=id_col, text_col=text_col, words=words).withColumnRenamed(id_col, "id"), "simhash")
    distinct = materialise(prints.where("id IS NOT NULL").groupBy("fp").agg(F.min("id").alias("rep")), "distinct-prints")
    pairs = materialise(similar_prints(distinct, max_bits), "similar-prints")
    left, right = distinct.select("fp", F.col("rep").alias("u")), distinct.select(F.col("fp").alias("fp2"), F.col("rep").alias("v"))
    groups = connected_components(pairs.join(left, "fp").join(right, "fp2").select("u", "v"))
    named = distinct.join(groups, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    named = materialise(named, "print-components")
    return prints.join(named, "fp", "left").select(F.col("id").alias(id_col), "fp", "component_id")


def keep_first(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` with one document, that of the least id, of each near-duplicate group; rows with null ids stay."""
    groups = simhash_components(docs, id_col=id_col, **options)
    extra = materialise(groups.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("__sh_id")).distinct(), "near-copies")
    return docs.join(extra, F.col(f"`{id_col}`") == F.col("__sh_id"), "left_anti")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash_components(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
