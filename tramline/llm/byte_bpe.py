"""Byte-level BPE encoding and decoding by backtracking over longest matches.

A piece's bytes are read as Latin-1, so that one automaton finds every vocabulary entry in it. From the left
the longest match is taken; it stands if it may follow the token before it, which depends on the two tokens
alone (would the merges ever join across their border?) and is memoised. Where no prefix of the match may
follow, the position is marked dead and the token before is shortened. Each position is tried once, so time
is linear in the text, and the result is that of the merges.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from itertools import pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from tramline.llm.part_table import PartTable, gathered, slices
from tramline.llm.shared import read_table, worker_state

#: Entries that a worker keeps of each memo before it starts anew; bounds memory, not results.
MEMO_ENTRIES = 60_000


class ByteBPE:
    """Encoder and decoder of one vocabulary. ``ranks`` maps token bytes to ids; ``pattern`` splits the text first."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.tokens: dict[int, bytes] = {i: t for t, i in ranks.items()}
        self.lengths = {i: len(t) for t, i in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, i in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), i)
        self.automaton.make_automaton()
        #: Of each token the longest shorter token that it starts with.
        self.shorter: dict[int, int | None] = {}
        for token, i in ranks.items():
            self.shorter[i] = next((ranks[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in ranks), None)
        self.pairs: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        for i in sorted(self.tokens):
            self.halves[i] = self._halves_of(i)
        self._fits.clear()
        self._first: dict[str, bytes] = {}
        self._later: dict[str, bytes] = {}
        self._pieces: dict[str, bytes] = {}
        self._border = regex.compile(r" (?=\S)")
        self._odd = regex.compile(r" (?!\S)")
        self._blanks = regex.compile(r"\s\s|\s\Z").search
        self._table = PartTable("<u4", b"", lambda parts: [self._chunk(x.decode()) for x in parts])
        size = max(self.tokens, default=-1) + 1
        self._spelt = _arena([self.tokens.get(i, b"") for i in range(size)])
        self._decimal = _arena([b"%d," % i for i in range(size)])

    @classmethod
    def from_file(cls, path: str, pattern: str) -> ByteBPE:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines) if a}, pattern)

    def _halves_of(self, i: int) -> tuple[int, int]:
        """The two tokens whose merge makes token ``i``; the token itself twice where none does."""
        token, left = self.tokens[i], self.shorter[i]
        while left is not None:
            right = self.ranks.get(token[self.lengths[left] :])
            if right is not None and left < i and right < i and self._stand_apart(left, right):
                self.pairs[left, right] = i
                return left, right
            left = self.shorter[left]
        return i, i

    def _stand_apart(self, a: int, b: int) -> bool:
        """Whether the merges leave ``a`` and ``b`` side by side: undo them from the last, watching the border."""
        limit = 1 << 62
        while True:
            joined = self.pairs.get((a, b))
            if joined is not None and joined < limit:
                return False
            for later in (a > b, a <= b):
                if later:  # a was made after b
                    limit, a = a, self.halves[a][1]
                    if a != limit:
                        break
                else:
                    limit, b = b + 1, self.halves[b][0]
                    if b + 1 != limit:
                        break
            else:
                return True

    def fits(self, a: int, b: int) -> bool:
        known = self._fits.get((a, b))
        if known is None:
            if len(self._fits) >= 4 * MEMO_ENTRIES:
                self._fits.clear()
            known = self._fits[a, b] = self._stand_apart(a, b)
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        n = len(piece)
        longest: list[int | None] = [None] * (n + 1)
        lengths, shorter = self.lengths, self.shorter
        for end, i in self.automaton.iter(piece.decode("latin-1")):
            at = end + 1 - lengths[i]
            if longest[at] is None or lengths[longest[at]] < lengths[i]:
                longest[at] = i
        alive = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        pos, token = 0, longest[0]
        while pos < n:
            before = out[-1] if out else None
            while token is not None and not (alive[pos + lengths[token]] and (before is None or self.fits(before, token))):
                token = shorter[token]
            if token is not None:
                out.append(token)
                pos += lengths[token]
                token = longest[pos]
            elif before is None:
                raise ValueError(f"the vocabulary can't spell {piece[:20]!r}")
            else:
                alive[pos] = 0
                token = out.pop()
                pos -= lengths[token]
        return out

    def _chunk(self, chunk: str) -> bytes:
        if len(self._pieces) > MEMO_ENTRIES:
            self._pieces.clear()
        found = []
        for piece in self.split(chunk):
            if (ids := self._pieces.get(piece)) is None:
                ids = np.array(self.encode_piece(piece.encode()), "<u4").tobytes()
                if len(piece) < 100:
                    self._pieces[piece] = ids
            found.append(ids)
        return b"".join(found)

    def encode(self, text: str) -> np.ndarray:
        """Ids of the whole text. A space before a non-space always starts a piece, so what lies between such
        spaces is encoded once and remembered."""
        parts = self._border.split(text) if self._odd.search(text) else text.split(" ")
        first, later = self._first, self._later
        for memo in (first, later):
            if len(memo) > MEMO_ENTRIES:
                memo.clear()
        if (head := first.get(parts[0])) is None:
            head = self._chunk(parts[0])
            if len(parts[0]) < 100:
                first[parts[0]] = head
        try:
            ids = b"".join([head, *map(later.__getitem__, parts[1:])])
        except KeyError:
            found = [head]
            for part in parts[1:]:
                if (ids := later.get(part)) is None:
                    ids = self._chunk(" " + part)
                    if len(part) < 100:
                        later[part] = ids
                found.append(ids)
            ids = b"".join(found)
        return np.frombuffer(ids, "<u4")

    def encode_batch(self, column: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, borders of the texts among them: one more than texts); nulls are empty.

        Where no two blanks meet, every space and line end starts a part whose ids don't depend on what is around it;
        other texts are encoded one by one."""
        texts = column.to_pylist()
        odd = {i for i, t in enumerate(texts) if t and self._blanks(t)}
        ids, borders = self._table.texts(column.filter(pa.array([i not in odd for i in range(len(texts))])) if odd else column)
        if not odd:
            return ids, borders
        even = iter(range(len(borders) - 1))
        own = [self.encode(t) if i in odd else ids[borders[k := next(even)] : borders[k + 1]] for i, t in enumerate(texts)]
        return np.concatenate([np.empty(0, "<u4"), *own]), np.cumsum([0, *map(len, own)])

    def spelt(self, ids: np.ndarray, borders: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """(bytes that all ids decode to, borders of the texts among them)."""
        return _borders(*gathered(*self._spelt, ids.astype(np.int64)), borders)

    def decimal(self, ids: np.ndarray, borders: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """(all ids in decimal with a comma after each, borders of the texts among them)."""
        return _borders(*gathered(*self._decimal, ids.astype(np.int64)), borders)

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def _arena(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])


def _borders(data: np.ndarray, ends: np.ndarray, borders: np.ndarray) -> tuple[memoryview, np.ndarray]:
    return memoryview(data), np.append(0, ends)[borders]


def loaded(path: str, pattern: str) -> ByteBPE:
    """The worker's encoder for a vocabulary; built once for each Python worker."""
    return worker_state(("bpe", path, pattern), lambda: ByteBPE.from_file(path, pattern))


def encoded(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Per row of ``docs``: id, ``n_tokens`` long, ``ids`` array<int> (left out on demand), ``ids_sha256`` of the
    decimal ids joined by commas, ``decoded_sha256`` of the bytes that the ids decode to.

    Map-only: rows stream through in Arrow batches, no shuffle, nothing kept but bounded memos. A null or empty
    text has no ids; null and repeated ids pass through, row for row; other columns are not read; an empty table
    gives an empty table. The vocabulary file must be at ``path`` on every machine.
    """
    kind = dict(docs.dtypes)[id_col]
    fields = [f"`{id_col}` {kind}", "n_tokens long", *["ids array<int>"] * with_ids, "ids_sha256 string", "decoded_sha256 string"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path, pattern)
        for whole in batches:
            for batch in slices(whole, 1):
                ids, borders = bpe.encode_batch(batch.column(1).cast(pa.string()))
                (bytes_, at), (digits, to) = bpe.spelt(ids, borders), bpe.decimal(ids, borders)
                columns = [batch.column(0), pa.array(np.diff(borders), pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(borders.astype(np.int32)), pa.array(ids.astype(np.int32))))
                columns.append(pa.array([hashlib.sha256(digits[s : max(s, e - 1)]).hexdigest() for s, e in pairwise(to.tolist())], pa.string()))
                columns.append(pa.array([hashlib.sha256(bytes_[s:e]).hexdigest() for s, e in pairwise(at.tolist())], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, [id_col, "n_tokens", *["ids"] * with_ids, "ids_sha256", "decoded_sha256"])

    return docs.select(f"`{id_col}`", f"`{text_col}`").mapInArrow(run, ", ".join(fields))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return encoded(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)
