"""Token ids in bit-packed files.

Each id takes the fewest bits that hold the vocabulary. A file holds whole documents in ascending order of their ids:

    header      magic, bits of an id, ids of a block, documents, ids, range number, place in the range, bytes of the document table
    documents   an Arrow stream with the columns doc_id and end (ids of the file up to and with the document)
    offsets     one unsigned 64-bit number per block and one more: where a block's bytes start and end behind the offsets
    ids         blocks of BLOCK ids, least significant bit first; eight ids of b bits fill b bytes

so that a file, or any range of its ids, is unpacked by numpy without a loop over ids, and a reader that maps the file touches
only the blocks it wants. Files are made by Spark's own writer (one file per row, its bytes as they are; the writer's closing
line feed is behind the last block), so they go to any store, and lost or repeated tasks leave nothing behind.

Texts are dealt by ranges of doc_id, tokenized there, and cut into files of about SEGMENT ids in the same stage. The number of ids before a
document is put together from totals of ranges, totals of files and the place in its file.
"""

from __future__ import annotations

import itertools
import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wearlens.session import written

from .textscan import text_chunks
from .worker import kept

MAGIC = b"BITIDS01"
HEADER = "<8sIIQQIIQ"
HEADER_SIZE = struct.calcsize(HEADER)
BLOCK = 4096
#: Ids of a file. Spark reads and writes a file as one value, so this bounds what a task holds.
SEGMENT = 1 << 20
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
CACHE = 1_000_000

# Fixed value: the pre-tokenizer pattern of files whose tokens never hold or cross white space.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: A character that is a token of its own between blanks; it tells many words apart that are encoded in one go.
MARK = "\x01"
TOGETHER = 2000


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold every id below `vocabulary`."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """`bits` bytes for every eight ids; the last eight are filled up with zeros."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes().ljust(-(-len(ids) // 8) * bits, b"\0")
    lanes = np.zeros((-(-len(ids) // 8), 8), np.uint64)
    lanes.reshape(-1)[: len(ids)] = ids
    out = np.zeros((len(lanes), bits), np.uint8)
    for j in range(8):
        first, shift = divmod(j * bits, 8)
        value = lanes[:, j] << np.uint64(shift)
        for k in range(-(-(bits + shift) // 8)):
            out[:, first + k] |= (value >> np.uint64(8 * k)).astype(np.uint8)
    return out.tobytes()


def unpack(raw: bytes | memoryview, n: int, bits: int) -> np.ndarray:
    """The first n ids of packed bytes."""
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", n).astype(np.uint32)
    groups = np.frombuffer(raw, np.uint8, -(-n // 8) * bits).reshape(-1, bits)
    out = np.zeros((len(groups), 8), np.uint64)
    for j in range(8):
        first, shift = divmod(j * bits, 8)
        for k in range(-(-(bits + shift) // 8)):
            out[:, j] |= groups[:, first + k].astype(np.uint64) << np.uint64(8 * k)
        out[:, j] = (out[:, j] >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
    return out.reshape(-1)[:n].astype(np.uint32)


def file_bytes(documents: pa.Array, ids: list[np.ndarray], bits: int, part: int = 0, place: int = 0) -> bytes:
    """One file of the given documents."""
    ends = np.cumsum([len(i) for i in ids], dtype=np.int64)
    flat = np.concatenate(ids)
    sink = pa.BufferOutputStream()
    table = pa.RecordBatch.from_arrays([documents, pa.array(ends, pa.int64())], names=["doc_id", "end"])
    with pa.ipc.new_stream(sink, table.schema) as stream:
        stream.write_batch(table)
    names = sink.getvalue().to_pybytes()
    blocks = [pack(flat[i : i + BLOCK], bits) for i in range(0, len(flat), BLOCK)]
    offsets = np.cumsum([0, *map(len, blocks)]).astype("<u8")
    head = struct.pack(HEADER, MAGIC, bits, BLOCK, len(ids), len(flat), part, place, len(names))
    return b"".join([head, names, offsets.tobytes(), *blocks])


class PackedFile:
    """A file's bytes, or a map of them; ids are unpacked as they are asked for."""

    def __init__(self, raw: bytes | memoryview):
        view = memoryview(raw)
        magic, self.bits, self.block, self.documents, self.tokens, self.part, self.place, size = struct.unpack_from(HEADER, view)
        if magic != MAGIC:
            raise ValueError("Not a file of bit-packed token ids.")
        with pa.ipc.open_stream(pa.py_buffer(view[HEADER_SIZE : HEADER_SIZE + size])) as stream:
            table = stream.read_next_batch()
        self.doc_ids = table.column("doc_id")
        self.bounds = np.concatenate([[0], table.column("end").to_numpy()])
        blocks = -(-self.tokens // self.block)
        self.offsets = np.frombuffer(view, "<u8", blocks + 1, HEADER_SIZE + size).astype(np.int64)
        self.body = view[HEADER_SIZE + size + 8 * (blocks + 1) :]

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids [start, end) of the file; only the blocks that hold them are read."""
        if start >= end:
            return np.empty(0, np.uint32)
        first, last = start // self.block, (end - 1) // self.block
        raw = self.body[self.offsets[first] : self.offsets[last + 1]]
        known = min(self.tokens, (last + 1) * self.block) - first * self.block
        return unpack(raw, known, self.bits)[start - first * self.block : end - first * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.bounds[i]), int(self.bounds[i + 1]))


class Numbered(dict):
    """Words and their numbers; an unknown word gets the next number and is noted as new."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number


class WordEncoder:
    """Ids of texts by the tokenizers library; where tokens never cross white space, a word's ids are computed once.

    Names of special tokens in a text are ordinary text.
    """

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(name if os.path.sep in name else public_tokenizers.path(name))
        self.tokenizer.encode_special_tokens = True
        self.bits = bits_for(max(self.tokenizer.get_vocab().values()) + 1)
        before = json.loads(self.tokenizer.to_str())["pre_tokenizer"] or {}
        split = before.get("pretokenizers", [before])[0]
        self.by_word = (split.get("type"), split.get("behavior"), split.get("invert"), (split.get("pattern") or {}).get("Regex")) == ("Split", "Removed", True, WORD_PATTERN)
        if self.by_word:
            self.mark = self._found([MARK])[0][0]
        self.clear()

    def clear(self) -> None:
        self.known = Numbered()
        self.ids, self.starts = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def _found(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(itertools.chain.from_iterable(found), np.uint32), np.array([len(f) for f in found], np.int64)

    def _learned(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """`_found` of words without blanks."""
        if any(MARK in w for w in words):
            return self._found(words)
        flat = self._found([f" {MARK} ".join([*words, ""])])[0]
        ends = np.flatnonzero(flat == self.mark)
        return flat[flat != self.mark], np.diff(ends, prepend=-1) - 1

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, END_ID after each text, and where each text starts."""
        if self.by_word:
            if len(self.known) > CACHE:
                self.clear()
            words: list[str] = []
            ends = []
            for text in texts:
                words += text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
                ends.append(len(words))
            at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
            if self.known.new:
                new, self.known.new = self.known.new, []
                parts = [self._learned(new[i : i + TOGETHER]) for i in range(0, len(new), TOGETHER)]
                self.ids = np.concatenate([self.ids, *(ids for ids, _ in parts)])
                self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(np.concatenate([n for _, n in parts]))])
            sizes = self.starts[at + 1] - self.starts[at]
            total = np.concatenate([[0], np.cumsum(sizes)])
            plain = self.ids[np.arange(total[-1]) + np.repeat(self.starts[at] - total[:-1], sizes)]
            own = np.concatenate([[0], total[ends]])
        else:
            plain, sizes = self._found(texts)
            own = np.concatenate([[0], np.cumsum(sizes)])
        bounds = own + np.arange(len(texts) + 1)
        ids = np.full(bounds[-1], END_ID, np.uint32)
        place = np.ones(len(ids), bool)
        place[bounds[1:] - 1] = False
        ids[place] = plain
        return ids, bounds


def _files(batches: Iterator[pa.RecordBatch], name: str, segment: int) -> Iterator[pa.RecordBatch]:
    """One row per file: its bytes, handed to the text writer unchanged."""
    encoder = kept(f"words of {name}", lambda: WordEncoder(name))
    part, place, held = TaskContext.get().partitionId(), 0, 0
    names: list[pa.Array] = []
    ids: list[np.ndarray] = []

    def closed() -> pa.RecordBatch:
        nonlocal place, held, names, ids
        cell = pa.array([file_bytes(pa.concat_arrays(names), ids, encoder.bits, part, place)], pa.binary())
        place, held, names, ids = place + 1, 0, [], []
        return pa.RecordBatch.from_arrays([pa.StringArray.from_buffers(1, *cell.buffers()[1:3])], names=["value"])

    for batch in batches:
        for chunk in text_chunks(batch.column("text")):
            rows = slice(chunk.first, chunk.first + chunk.docs)
            flat, bounds = encoder.encode([t or "" for t in batch.column("text")[rows].to_pylist()])
            first, doc_ids = 0, batch.column("doc_id")[rows]
            while first < chunk.docs:  # up to the document that fills the file
                last = min(chunk.docs, int(np.searchsorted(bounds, bounds[first] + segment - held)))
                names.append(doc_ids[first:last])
                ids += [flat[a:b] for a, b in itertools.pairwise(bounds[first : last + 1].tolist())]
                held += int(bounds[last] - bounds[first])
                first = last
                if held >= segment:
                    yield closed()
    if ids:
        yield closed()


def write_ids(documents: DataFrame, path: str, tokenizer: str = TOKENIZER, segment: int = SEGMENT) -> None:
    """Write the ids of every text, END_ID after each, to files below `path`, in ascending order of doc_id.

    A null text is empty and is the end id alone; a null doc_id comes first; rows of equal doc_id follow each other in the order
    of a hash of their texts. Other columns are not read. No rows make no files. A document is never cut over two files: a text
    longer than a file is a file of its own, at most 2 GB packed.
    """
    keys = ["doc_id", "tie", "row"]
    # the row's number only parts copies of one id, so that any number of them is dealt over several tasks
    rows = documents.select("doc_id", "text", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row"))
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")
    files = ordered.mapInArrow(lambda b: _files(b, tokenizer, segment), "value string")
    files.write.option("maxRecordsPerFile", 1).option("compression", "none").text(path)


def _read(batches: Iterator[pa.RecordBatch], ids: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for cell in batch.column("content"):
            file = PackedFile(cell.as_buffer())
            n = file.documents
            for first in range(0, n, 4096):
                last = min(n, first + 4096)
                bounds = file.bounds[first : last + 1]
                flat = file.ids(int(bounds[0]), int(bounds[-1]))
                raw, at = memoryview(flat.astype("<u4").tobytes()), (bounds - bounds[0]).tolist()
                columns = [
                    pa.array(np.full(last - first, file.part), pa.int32()), pa.array(np.full(last - first, file.place), pa.int32()),
                    file.doc_ids[first:last], pa.array(bounds[:-1], pa.int64()), pa.array(np.diff(bounds), pa.int64()),
                    pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in itertools.pairwise(at)], pa.int64()),
                ]
                names = ["part", "place", "doc_id", "inside", "n_tokens", "ids_crc32"]
                if ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat.astype(np.int32), pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)


def read_ids(spark: SparkSession, path: str, kind: str = "bigint", ids: bool = True) -> DataFrame:
    """Per document of the files below `path`: doc_id (of type `kind`), start (ids of all documents before it), n_tokens, ids_crc32,
    and its ids if asked for."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where(F.col("length") > HEADER_SIZE).select("content")
    schema = f"part int, place int, doc_id {kind}, inside bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<int>" if ids else "")
    rows = files.mapInArrow(lambda b: _read(b, ids), schema)
    if not ids:  # few bytes a document: the files are read once
        rows = written(rows, "documents-of-files")
    sizes = written(rows.select("part", "place", "n_tokens").groupBy("part", "place").agg(F.sum("n_tokens").alias("size")), "file-sizes")
    # one row per range: as many as the shuffle has partitions
    totals = sizes.groupBy("part").agg(F.sum("size").alias("size")).orderBy("part").collect()
    before = itertools.accumulate((r["size"] for r in totals), initial=0)
    ranges = spark.createDataFrame([(r["part"], b) for r, b in zip(totals, before, strict=False)], "part int, range_start bigint")
    earlier = F.coalesce(F.sum("size").over(Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.join(F.broadcast(ranges), "part").select("part", "place", (F.col("range_start") + earlier).alias("file_start"))
    out = ["n_tokens", "ids_crc32", *(["ids"] if ids else [])]
    return rows.join(starts, ["part", "place"]).select("doc_id", (F.col("file_start") + F.col("inside")).alias("start"), *out)
