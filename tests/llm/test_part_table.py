import base64
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from tokenizers import Tokenizer

from tramline.llm import part_table, token_store
from tramline.llm.byte_bpe import ByteBPE
from tramline.llm.token_store import ChunkEncoder

ATOMS = [" ", "\n", "\t", "\r", "\x0b", "\x1c", "\x85", "\xa0", " ", "　", "​", "﻿", "\x00", "a", "the", "ing", "'s", "'ll", "'", "’", "1", "23", "é", "你好", "🙂", "́", "!", "...", "--", "_", "<|endoftext|>", "W", "²", "Ⅷ", "٣", "abcdefghijklmnopqr"]


def made(count, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(ATOMS[4:] if rng.random() < 0.7 else ATOMS[:2]) for _ in range(rng.randrange(12))) for _ in range(count)]


def test_made_up_texts_have_the_ids_of_both_libraries(monkeypatch):
    for module in (part_table, token_store):
        monkeypatch.setattr(module, "MEMO_ENTRIES", 1000)
    monkeypatch.setattr(part_table, "CHUNK", 700)
    path, ranked = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    library, store = Tokenizer.from_file(path), ChunkEncoder(path, 0)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranked, "rb"))}
    tiktokens, bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), ByteBPE.from_file(ranked, public_tokenizers.PATTERN)
    texts = [*made(6000), "x" * 5000, *[f"word{i} and{i}" for i in range(3000)]]
    for i in range(0, len(texts), 900):
        own = texts[i : i + 900]
        assert [np.frombuffer(x, "<u2").tolist() for x in store.encode(own)] == [[*e.ids, 0] for e in library.encode_batch(own, add_special_tokens=False)]
        ids, borders = bpe.encode_batch(pa.array([None, *own]))
        assert [ids[s:e].tolist() for s, e in zip(borders[1:], borders[2:], strict=False)] == [tiktokens.encode_ordinary(t) for t in own]
        spelt, at = bpe.spelt(ids, borders)
        assert [bytes(spelt[s:e]).decode() for s, e in zip(at, at[1:], strict=False)] == ["", *own]


def test_slices_hold_all_rows_in_order(monkeypatch):
    monkeypatch.setattr(part_table, "SLICE_BYTES", 10)
    batch = pa.RecordBatch.from_pydict({"t": ["a" * 30, None, "bb", "c" * 9, "", "d" * 10, "e" * 11]})
    cut = [x.column(0).to_pylist() for x in part_table.slices(batch, 0)]
    assert sum(cut, []) == batch.column(0).to_pylist() and all(len(x) == 1 or sum(len(t or "") for t in x) <= 10 for x in cut)
