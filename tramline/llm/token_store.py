"""Token-id output: shard files of concatenated ids with Elias-Fano coded document boundaries.

A shard file holds, in this order: the ids of its documents one after the other (unsigned little-endian, 2 or 4
bytes each), the Elias-Fano coded sequence of the documents' end offsets, that of their ids less the least, and a
fixed-size footer. A sequence of n numbers below u takes about n * (2 + log2(u / n)) bits; one 32-bit sample for
every 256 numbers lets ``EliasFano.get`` find any of them without a table of offsets.
"""

from __future__ import annotations

import json
import os
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tramline.llm.part_table import PartTable, slices
from tramline.llm.shared import fresh_path, read_table, worker_state

MAGIC = b"TRLTOK01"
#: Characters of text that a shard is planned for, and shards at most; beyond them shards grow with the input.
SHARD_CHARS, MAX_SHARDS = 8_000_000, 10_000
#: Parts of text whose ids a worker keeps; nothing else of its size runs beside it, as in the pipeline's BPE.
MEMO_ENTRIES = 1_500_000
_SAMPLE = 256
_FOOTER = struct.Struct("<8sBQQQqQQQ")  # magic, id width, documents, nulls, ids, least id, lengths of the three sections


class EliasFano:
    """A non-decreasing sequence of whole numbers from 0, packed; ``get`` reads one, ``all`` every one."""

    _HEAD = struct.Struct("<QQB")

    def __init__(self, data: bytes):
        self.n, self.bound, self.low_bits = self._HEAD.unpack_from(data)
        at = self._HEAD.size
        size = (self.n * self.low_bits + 7) // 8
        self.low, at = np.frombuffer(data, np.uint8, size, at), at + size
        count = -(-self.n // _SAMPLE)
        self.samples, at = np.frombuffer(data, "<u4", count, at), at + 4 * count
        self.high = np.frombuffer(data, np.uint8, -1, at)

    @classmethod
    def pack(cls, values: np.ndarray) -> bytes:
        values = np.asarray(values, np.uint64)
        n = len(values)
        bound = int(values[-1]) + 1 if n else 1
        bits = max(0, (bound // n).bit_length() - 1) if n else 0
        shifts = np.arange(bits, dtype=np.uint64)
        low = np.packbits((values[:, None] >> shifts & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little") if bits else np.empty(0, np.uint8)
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        return b"".join([cls._HEAD.pack(n, bound, bits), low.tobytes(), ones[::_SAMPLE].astype("<u4").tobytes(), np.packbits(high, bitorder="little").tobytes()])

    def _low(self, i: int) -> int:
        at, out = i * self.low_bits, 0
        for k in range(self.low_bits):
            out |= int(self.low[(at + k) >> 3] >> ((at + k) & 7) & 1) << k
        return out

    def select(self, i: int) -> int:
        """Place of the i-th one among the high bits: from the sample before it, byte by byte."""
        at, left = int(self.samples[i // _SAMPLE]), i % _SAMPLE
        byte = at >> 3
        bits = int(self.high[byte]) >> (at & 7) << (at & 7)
        while (ones := bits.bit_count()) <= left:
            left -= ones
            byte += 1
            bits = int(self.high[byte])
        for _ in range(left):
            bits &= bits - 1
        return byte * 8 + (bits & -bits).bit_length() - 1

    def get(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        return (self.select(i) - i) << self.low_bits | self._low(i)

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        high = (ones - np.arange(self.n)).astype(np.int64) << self.low_bits
        if not self.low_bits:
            return high
        low = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        return high + low.astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))


class ShardWriter:
    """Streams documents to a file under a name of its own and gives it its final name once it is whole."""

    def __init__(self, uri: str, width: int):
        self.fs, self.path = pafs.FileSystem.from_uri(uri)
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.part, self.width = f"{self.path}.{uuid.uuid4().hex}", width
        self.out = self.fs.open_output_stream(self.part)
        self.ids: list[int] = []
        self.ends: list[int] = []
        self.nulls = self.total = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.out.write(ids)
        self.total += len(ids) // self.width
        self.ends.append(self.total)
        if doc_id is None:
            self.nulls += 1
        else:
            self.ids.append(doc_id)

    def close(self) -> tuple[int, int]:
        ends = EliasFano.pack(np.array(self.ends, np.uint64))
        least = self.ids[0] if self.ids else 0
        names = EliasFano.pack(np.array([i - least for i in self.ids], np.uint64))
        self.out.write(ends)
        self.out.write(names)
        self.out.write(_FOOTER.pack(MAGIC, self.width, len(self.ends), self.nulls, self.total, least, self.total * self.width, len(ends), len(names)))
        self.out.close()
        self.fs.move(self.part, self.path)
        return len(self.ends), self.total


class Shard:
    """Reads a shard file: ``doc_id``, ``bounds`` and ``ids`` of its i-th document, or ``documents`` one by one."""

    def __init__(self, uri: str):
        files, path = pafs.FileSystem.from_uri(uri)
        self.file = files.open_input_file(path)
        size = self.file.size()
        magic, self.width, self.n, self.nulls, self.total, self.least, a, b, c = _FOOTER.unpack(self.file.read_at(_FOOTER.size, size - _FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} isn't a shard file")
        self.ends, self.names = EliasFano(self.file.read_at(b, a)), EliasFano(self.file.read_at(c, a + b))

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nulls else self.least + self.names.get(i - self.nulls)

    def bounds(self, i: int) -> tuple[int, int]:
        return (self.ends.get(i - 1) if i else 0), self.ends.get(i)

    def _read(self, start: int, end: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at((end - start) * self.width, start * self.width), f"<u{self.width}")

    def ids(self, i: int) -> np.ndarray:
        return self._read(*self.bounds(i))

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(id, start in the shard, token ids) in order; reads one document at a time."""
        names = [None] * self.nulls + (self.names.all() + self.least).tolist()
        start = 0
        for name, end in zip(names, self.ends.all().tolist(), strict=True):
            yield name, start, self._read(start, end)
            start = end


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if it prints, else one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(prints)]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(others)}


class ChunkEncoder:
    """The tokenizers library's byte-level BPE over whole texts, with each distinct part encoded once.

    Byte-level pre-tokenising starts a piece at every space before a non-space, and merges stay within a piece. Where no
    two blanks meet, a line end is a piece of its own. So such a text is cut before its spaces and line ends, over the
    whole batch's bytes at once; the parts' ids come from a table, and what it lacks from the library's model, piece by
    piece. Other texts, and those that hold an added token of the file, go through the library whole; as in the library,
    special tokens count as plain text under ``encode_special_tokens``. ``tests/llm`` holds the result against the
    library on whole texts.
    """

    def __init__(self, path: str, end_id: int, encode_special_tokens: bool = False):
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.library = library = Tokenizer.from_file(path)
        library.encode_special_tokens = encode_special_tokens
        self.added = [t.content for t in library.get_added_tokens_decoder().values() if not (t.special and encode_special_tokens)]
        self.model = library.model
        self.kind = "H" if max(library.get_vocab_size(), end_id + 1) <= 1 << 16 else "I"
        self.width = array(self.kind).itemsize
        self.end = array(self.kind, [end_id]).tobytes()
        self.letters = _byte_letters()
        self.pieces = regex.compile(public_tokenizers.PATTERN).findall
        self.odd = regex.compile(r"\s\s|\s\Z").search
        self.table = PartTable(f"<u{self.width}", self.end, self._ids, MEMO_ENTRIES)

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.encode_array(pa.array(texts, pa.string())).to_pylist()

    def encode_array(self, column: pa.StringArray) -> pa.BinaryArray:
        """Packed ids of each text (null: empty) and the end id."""
        texts = column.to_pylist()
        whole = {i for i, t in enumerate(texts) if t and (self.odd(t) or any(a in t for a in self.added))}
        even = column.filter(pa.array([i not in whole for i in range(len(texts))])) if whole else column
        data, borders = self.table.texts(even)
        packed = pa.BinaryArray.from_buffers(pa.binary(), len(even), [None, pa.py_buffer((borders * self.width).astype(np.int32)), pa.py_buffer(data)])
        if not whole:
            return packed
        rest = iter(packed.to_pylist())
        return pa.array([array(self.kind, self.library.encode(t, add_special_tokens=False).ids).tobytes() + self.end if i in whole else next(rest) for i, t in enumerate(texts)], pa.binary())

    def _ids(self, parts: list[bytes]) -> list[bytes]:
        """Packed ids of each part. Those that start at a space or line end fall into the same pieces side by side."""
        out: list[list[str]] = []
        led = [x[0] in b" \n" for x in parts]
        for piece in self.pieces(b"".join([x for x, y in zip(parts, led, strict=True) if y]).decode()):
            if piece[0] in " \n":
                out.append([])
            out[-1].append(piece)
        cut = iter(out)
        pieces = [next(cut) if y else self.pieces(x.decode()) for x, y in zip(parts, led, strict=True)]
        kind, letters, tokenize = self.kind, self.letters, self.model.tokenize
        known = {x: array(kind, [t.id for t in tokenize(x.encode().decode("latin-1").translate(letters))]).tobytes() for x in set().union(*pieces)}
        return [known[own[0]] if len(own) == 1 else b"".join([known[x] for x in own]) for own in pieces]


def loaded(*settings) -> ChunkEncoder:
    """The worker's encoder, with what it remembers from task to task."""
    return worker_state(("tokens", *settings), lambda: ChunkEncoder(*settings))


def write_shards(docs: DataFrame, tokenizer: str, out: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, shard_chars: int = SHARD_CHARS, encode_special_tokens: bool = True) -> list[dict]:
    """Encode every text, end each document with ``end_id`` and write shard files in ascending order of ``id_col``.

    ``encode_special_tokens`` is the library's setting: if set, a special token's name in a text is plain text; the
    library's own default, which ``op5_token_store`` follows, is to give it the token's id.
    ``out`` is a folder that driver and executors share, as a URI. Returns the manifest (also written there): per
    shard its file, documents, ids, and the ids in all shards before. Null or empty texts are just the end id; null
    ids come first; repeated ids stay in one shard, ordered by their ids' bytes; other columns are not read; an empty
    table gives no shards.

    Plan: shard borders are quantiles of the id column, so that ids are dealt out once, already encoded and packed;
    a writer streams its sorted rows to a file, keeping two numbers a document, and renames it when whole, so a lost
    executor leaves nothing that counts. Only a border and a row for each shard reach the driver, ``MAX_SHARDS`` at most.
    """
    ident, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    chars = docs.agg(F.sum(F.char_length(text))).first()[0] or 0
    shards = min(MAX_SHARDS, max(1, -(-chars // shard_chars)))
    cuts = docs.agg(F.percentile_approx(ident, [i / shards for i in range(1, shards)], 100_000)).first()[0] if shards > 1 else []
    cuts = sorted(set(cuts or []))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, borders = loaded(tokenizer, end_id, encode_special_tokens), np.array(cuts, np.int64)
        for whole in batches:
            for batch in slices(whole, 1):
                names = batch.column(0).cast(pa.int64())
                shard = np.where(np.array(names.is_null()), 0, np.searchsorted(borders, np.array(names.fill_null(0)), side="right"))
                yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), names, encoder.encode_array(batch.column(1).cast(pa.string())), pa.array([encoder.width] * batch.num_rows, pa.int32())], ["shard", "id", "ids", "width"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, at, done = None, None, []
        for batch in batches:
            for shard, name, ids, width in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != at:
                    if writer:
                        done.append((at, *writer.close()))
                    writer, at = ShardWriter(f"{out}/shard-{shard:06d}.tok", width), shard
                writer.add(name, ids)
        if writer:
            done.append((at, *writer.close()))
        yield pa.RecordBatch.from_pylist([{"shard": s, "n_docs": d, "n_ids": t} for s, d, t in done], pa.schema([("shard", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    packed = docs.select(ident.cast("long").alias("id"), text.alias("text")).mapInArrow(encode, "shard int, id long, ids binary, width int")
    dealt = packed.repartitionById(len(cuts) + 1, F.col("shard")).sortWithinPartitions("shard", "id", "ids")
    rows = sorted(dealt.mapInArrow(write, "shard int, n_docs long, n_ids long").collect())
    manifest, before = [], 0
    for shard, n_docs, n_ids in rows:
        manifest.append({"file": f"{out}/shard-{shard:06d}.tok", "n_docs": n_docs, "n_ids": n_ids, "before": before})
        before += n_ids
    files, path = pafs.FileSystem.from_uri(out)
    files.create_dir(path, recursive=True)
    with files.open_output_stream(f"{path}/manifest.json") as stream:
        stream.write(json.dumps(manifest).encode())
    return manifest


def read_shards(spark: SparkSession, out: str) -> DataFrame:
    """The documents of ``write_shards``, from the files: doc_id, start (over all shards), n_tokens, ids_crc32."""
    files, path = pafs.FileSystem.from_uri(out)
    with files.open_input_stream(f"{path}/manifest.json") as stream:
        manifest = json.loads(stream.read())
    schema = T.StructType([T.StructField("file", T.StringType()), T.StructField("before", T.LongType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows: list[tuple] = []
                for name, start, ids in Shard(file).documents():
                    rows.append((name, before + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(rows) == 4096:
                        yield _rows(rows)
                        rows = []
                yield _rows(rows)

    table = spark.createDataFrame([(m["file"], m["before"]) for m in manifest], schema)
    return table.repartition(max(1, len(manifest)), "file").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = fresh_path(spark, "token-store")
    out = out if "://" in out else f"file://{out}"
    write_shards(read_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), out, encode_special_tokens=False)
    return read_shards(spark, out)
