"""Packing into training sequences by lexical retrieval.

Every text is tokenized once. Whole windows of it become sequences of their own; its rest is packed. Texts are ordered by
the smallest hash of their word triples, which puts texts with common passages side by side, and cut into shards of
SHARD_DOCS texts. Each shard has a BM25 inverted index over all words of its texts (document frequencies and lengths are
the shard's own). The first unused text is a seed; its unused neighbours fill its window in the order of their BM25 score
for the seed's words, then further texts in order. The text that does not fit any more is cut at a multiple of BLOCK tokens; what
is left of it is used later. Checksums of cut pieces are put together from checksums of blocks, so that tokens are
neither stored nor shuffled.
"""

from __future__ import annotations

import itertools
import json
import os
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spread import stored
from .textscan import ALNUM, Words, give_back, text_chunks

WINDOW = 2048
BLOCK = 32
END_ID = 1
SHARD_DOCS = 1024
#: Words an encoder knows before it forgets those that it has met once since it forgot the last time: most distinct words.
CACHE = 150_000
#: Rows in an Arrow batch of texts.
ROWS = 2000
TOKENIZER = "byte_bpe_50k.json"
K1, B = 1.2, 0.75

# White space as str.isspace() has it, in UTF-8: one byte, two and three.
_WHITE = np.zeros(256, bool)
_WHITE[[c for c in range(128) if chr(c).isspace()]] = True
_WIDE = [chr(c).encode() for c in range(128, 0x3001) if chr(c).isspace()]
_TWO, _THREE = (np.array([int.from_bytes(w) for w in _WIDE if len(w) == n], np.uint32) for n in (2, 3))


_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[c for c in range(128) if chr(c).isalpha()]] = True
_MARK[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def piece_starts(buf: np.ndarray, offsets: np.ndarray, marks: bool = False) -> np.ndarray:
    """Where the parts begin that tokens do not cross: texts without their empty ones, every single space between two other
    characters that are not white space, and if `marks` says so, punctuation after a letter (both ASCII), where a byte-level file's
    own pattern cuts. A token never starts before such a place and ends after it."""
    begin = np.zeros(len(buf) + 1, bool)
    begin[offsets] = True
    at = np.flatnonzero(buf == 32)
    at = at[~(begin[at] | begin[at + 1])]
    before, after = buf[at - 1], buf[at + 1]
    cut = ~(_WHITE[before] | _WHITE[after])
    wide = np.flatnonzero(cut & ((before >= 128) | (after >= 128)))
    if len(wide):
        # past the text's end lies no part of its own characters; before its start neither
        near = np.concatenate([np.zeros(3, np.uint8), buf, np.zeros(3, np.uint8)]).astype(np.uint32)
        p = at[wide] + 3
        left, right = ((near[q] << 16) | (near[q + 1] << 8) | near[q + 2] for q in (p - 3, p + 1))
        cut[wide] = ~(np.isin(left & 0xFFFF, _TWO) | np.isin(left, _THREE) | np.isin(right >> 8, _TWO) | np.isin(right, _THREE))
    begin[at[cut]] = True
    if marks:
        begin[1:-1] |= _LETTER[buf[:-1]] & _MARK[buf[1:]]
    return np.flatnonzero(begin[:-1])


def byte_pairs(tokenizer) -> object | None:
    """The same merges for tiktoken, several times as fast, if the file is a plain byte-level BPE; else None.

    Ids of such a file follow the order of its merges. tests/llm/test_packing.py compares the ids of both libraries.
    """
    import public_tokenizers
    import tiktoken

    made = json.loads(tokenizer.to_str())
    before = made["pre_tokenizer"] or {}
    plain = made["model"]["type"] == "BPE" and made["normalizer"] is None and not made["model"].get("dropout") and not made["model"].get("ignore_merges")
    if not plain or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex"):
        return None
    # byte-level files write printable bytes as themselves and the others as characters from 256 on, in order
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    letters = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    special = {t["content"] for t in made["added_tokens"]}
    ranks = {bytes(letters[c] for c in token): i for token, i in made["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("byte-pairs", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoder_of(name: str) -> Encoder:
    """The worker process's encoder of a file, kept from task to task with the words it knows."""
    kept = sys.modules.setdefault("_kept_encoders", types.ModuleType("_kept_encoders"))
    if not hasattr(kept, name):
        setattr(kept, name, Encoder(name))
    return getattr(kept, name)


def forget_encoders() -> None:
    """Encoders and their words would lie in the worker process through all steps that come later."""
    sys.modules.pop("_kept_encoders", None)
    give_back()


class Encoder:
    """Token ids of many texts; ids of a word, that is a part as `piece_starts` has it, are computed once and kept for later texts."""

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(name if os.path.sep in name else public_tokenizers.path(name))
        self.tokenizer.encode_special_tokens = True
        self.pairs = byte_pairs(self.tokenizer)
        # in a byte-level vocabulary a token has as many characters as bytes
        vocabulary = self.tokenizer.get_vocab()
        self.bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.bytes[i] = len(token)
        self.clear()

    def clear(self) -> None:
        # number 0 stands for the end of a text; a word is known by its bytes, the space before it among them
        self.known = {b"": 0}
        self.ids, self.used = np.full(1 << 18, END_ID, np.uint32), 1
        self.starts, self.sizes = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.sizes[0] = 1
        self.again = np.zeros(1 << 16, bool)

    def forget(self) -> None:
        """Keep words met again, if they are few enough to leave room for others."""
        kept = np.flatnonzero(self.again[: len(self.known)])
        if len(kept) > CACHE // 2:
            return self.clear()
        words, sizes, starts = list(self.known), self.sizes[kept], self.starts[kept]
        ids = self.ids[np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)]
        words = [words[i] for i in kept.tolist() if i]
        self.clear()
        self._append(self._number(words), ids[-sizes[kept > 0].sum() :] if words else ids[:0], sizes[kept > 0])

    def _ids(self, text: str) -> np.ndarray:
        if self.pairs:
            return self.pairs.encode_to_numpy(text, disallowed_special=())
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _append(self, numbers: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Ids of the words of these numbers, one word's after another's."""
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty(max(len(ids), len(self.ids)), np.uint32)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.starts[numbers] = self.used + np.cumsum(sizes) - sizes
        self.sizes[numbers] = sizes
        self.used += len(ids)

    def _number(self, words: list[bytes]) -> np.ndarray:
        """Numbers for words that have none."""
        first = len(self.known)
        self.known.update(zip(words, range(first, first + len(words)), strict=True))
        if len(self.known) > len(self.starts):
            more = max(len(words), len(self.starts))
            self.starts, self.sizes, self.again = (np.concatenate([x, np.zeros(more, x.dtype)]) for x in (self.starts, self.sizes, self.again))
        return np.arange(first, len(self.known))

    def _learn(self, words: list[bytes], alone: np.ndarray) -> np.ndarray:
        """Numbers of new words. Words that follow a single space and end before one are encoded in one go and cut by their bytes, so
        are those that start with punctuation, behind a letter each; those marked in `alone` are encoded one by one."""
        numbers = self._number(words)
        spaced = np.fromiter((w[0] == 32 for w in words), bool, len(words))
        if alone.any():
            found = [self._ids(words[i].decode()) for i in np.flatnonzero(alone).tolist()]
            self._append(numbers[alone], np.concatenate(found), np.array([len(x) for x in found]))
        for which, before in ((spaced & ~alone, b""), (~spaced & ~alone, b" a")):
            if which.any():
                some = [words[i] for i in np.flatnonzero(which).tolist()]
                ids = self._ids((before + before.join(some)).decode())
                lengths, at = np.fromiter(map(len, some), np.int64, len(some)), np.cumsum(self.bytes[ids])
                ends = np.cumsum(lengths + len(before))
                first = np.searchsorted(at, ends - lengths, "right")
                sizes = np.searchsorted(at, ends, "right") - first
                if before:
                    ids = ids[np.arange(sizes.sum()) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)]
                self._append(numbers[which], ids, sizes)
        return numbers

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, END_ID after each text, and where each text starts."""
        raw = [t.encode() for t in texts]
        return self.encode_bytes(np.frombuffer(bytearray().join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))

    def encode_bytes(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """`encode` for texts in one buffer, each from its offset to the next one."""
        if len(self.known) > CACHE:
            self.forget()
        starts = piece_starts(buf, offsets, self.pairs is not None)
        first, edges = np.searchsorted(starts, offsets), np.append(starts, len(buf))
        pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(buf)]).dictionary_encode()
        of, words = pieces.indices.to_numpy(), pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        numbers = np.fromiter(map(self.known.get, words, itertools.repeat(-1)), np.int64, len(words))
        fresh = numbers < 0
        self.again[numbers[~fresh]] = True
        new = np.flatnonzero(fresh).tolist()
        if new:
            # a first part follows no space; a last one that ends in white space would be read together with the space after it
            alone, some = np.zeros(len(words), bool), np.flatnonzero(np.diff(first))
            alone[of[first[some]]] = True
            last = np.unique(of[first[some + 1] - 1])
            last = last[fresh[last]]
            alone[last] |= np.array([words[i].decode()[-1].isspace() for i in last.tolist()], bool)
            numbers[new] = self._learn([words[i] for i in new], alone[new])
        # a word's number for each part, and 0 after each text
        closing = first[1:] + np.arange(len(offsets) - 1)
        inside = np.ones(len(of) + len(closing), bool)
        inside[closing] = False
        at = np.zeros(len(inside), np.int64)
        at[inside] = numbers[of]
        sizes = self.sizes[at]
        total = np.cumsum(sizes)
        ids = self.ids[np.arange(total[-1] if len(total) else 0) + np.repeat(self.starts[at] - (total - sizes), sizes)]
        return ids, np.concatenate([[0], total[closing]])


_NONE = np.uint64((1 << 64) - 1)


def _cells(values: np.ndarray, edges: np.ndarray | list[int]) -> pa.Array:
    """The bytes of 32-bit values, a cell from each edge to the next."""
    offsets = (4 * np.asarray(edges, np.int64)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _tokenized(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    """Per document: tokens, checksums of whole windows, length and block checksums of the rest, words with frequencies, order key."""
    encoder = None
    for batch in batches:
        encoder = encoder or encoder_of(name)
        for chunk in text_chunks(batch.column("text")):
            rows = slice(chunk.first, chunk.first + chunk.docs)
            ids, bounds = encoder.encode_bytes(chunk.buf, chunk.offsets)
            raw = memoryview(ids.astype("<u4").tobytes())
            words = Words(chunk, ALNUM)
            hashes = words.hashes()
            grams, whole = words.ngrams(hashes, 3)
            # distinct words of all the chunk's texts at once, text by text in the order of their hashes
            pairs = np.sort((words.doc().astype(np.uint64) << np.uint64(32)) | (hashes >> np.uint64(32)))
            runs = np.flatnonzero(np.diff(pairs, prepend=pairs[:1] + np.uint64(1)))
            terms, counts = pairs[runs].astype(np.uint32), np.diff(runs, append=len(pairs)).astype(np.uint32)
            edges = np.searchsorted(pairs[runs] >> np.uint64(32), np.arange(chunk.docs + 1, dtype=np.uint64))
            some = np.flatnonzero(words.counts())
            key = np.zeros(chunk.docs, np.int64)
            if len(some):
                least = np.minimum.reduceat(np.where(whole, grams >> np.uint64(1), _NONE), words.first[some])
                key[some] = np.where(least < _NONE, least, terms[edges[some]]).astype(np.int64)
            windows, blocks, cuts = [], [], [0]
            for a, b in itertools.pairwise((4 * bounds).tolist()):
                full = range(a, b - 4 * WINDOW + 1, 4 * WINDOW)
                rest = a + 4 * WINDOW * len(full)
                windows.append([zlib.crc32(raw[i : i + 4 * WINDOW]) for i in full])
                blocks += [zlib.crc32(raw[i : min(b, i + 4 * BLOCK)]) for i in range(rest, b, 4 * BLOCK)]
                cuts.append(len(blocks))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id")[rows], pa.array(np.diff(bounds), pa.int64()), pa.array(windows, pa.list_(pa.int64())),
                    _cells(np.array(blocks, np.uint32), cuts), _cells(terms, edges), _cells(counts, edges), pa.array(key),
                ],
                names=["doc_id", "doc_tokens", "windows", "blocks", "terms", "counts", "key"],
            )


_ZEROS = bytes(4 * BLOCK)
# A checksum after one more block of zeros is a sum (by exclusive or) over the bytes of the checksum before.
_MOVED = np.array([[zlib.crc32(_ZEROS, byte << 8 * i) ^ zlib.crc32(_ZEROS) for byte in range(256)] for i in range(4)], np.uint32)


def joined_checksums(blocks: np.ndarray, first: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """CRC-32 of pieces of so many tokens each, put together from the checksums of consecutive blocks of BLOCK tokens, from place
    `first` of `blocks` on; a piece's last block may be shorter."""
    number, rest = -(-tokens // BLOCK), tokens % BLOCK
    order = np.argsort(-(tokens // BLOCK), kind="stable")
    at, whole = first[order], (tokens // BLOCK)[order]
    total = blocks[at]
    for i in range(1, int(whole.max(initial=0))):
        going = int(np.searchsorted(-whole, -i))
        t = total[:going]
        total[:going] = _MOVED[0][t & 255] ^ _MOVED[1][t >> 8 & 255] ^ _MOVED[2][t >> 16 & 255] ^ _MOVED[3][t >> 24] ^ blocks[at[:going] + i]
    out = np.empty(len(first), np.int64)
    out[order] = total
    for p in np.flatnonzero((rest > 0) & (number > 1)).tolist():
        zeros = _ZEROS[: 4 * int(rest[p])]
        out[p] = zlib.crc32(zeros, int(out[p])) ^ zlib.crc32(zeros) ^ int(blocks[first[p] + number[p] - 1])
    return out


class Index:
    """BM25 over the texts of a shard."""

    def __init__(self, terms: list[np.ndarray], counts: list[np.ndarray]):
        self.docs = len(terms)
        sizes = np.array([len(t) for t in terms])
        length = np.array([c.sum() for c in counts], float)
        names, self.of = np.unique(np.concatenate(terms), return_inverse=True)
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        held = np.bincount(self.of, minlength=len(names))
        self.weight = np.log(1 + (self.docs - held + 0.5) / (held + 0.5))
        owner, f = np.repeat(np.arange(self.docs), sizes), np.concatenate(counts).astype(float)
        norm = f + K1 * (1 - B + B * (length / max(1.0, length.mean()))[owner])
        order = np.argsort(self.of, kind="stable")
        self.posting, self.value = owner[order], (self.weight[self.of] * f * (K1 + 1) / norm)[order]
        self.start = np.concatenate([[0], np.cumsum(held)])

    def scores(self, doc: int) -> np.ndarray:
        """Scores of all texts of the shard for the words of one of them."""
        asked = self.of[self.first[doc] : self.first[doc + 1]]
        sizes = self.start[asked + 1] - self.start[asked]
        at = np.arange(sizes.sum()) + np.repeat(self.start[asked] - (np.cumsum(sizes) - sizes), sizes)
        return np.bincount(self.posting[at], self.value[at], self.docs)


def best_first(scores: np.ndarray, most: int = 32) -> Iterator[int]:
    """Places by falling score, equal ones in their order; those behind the best `most` are sorted only if they are asked for."""
    lost = -scores
    if len(lost) > most:
        cut = np.partition(lost, most - 1)[most - 1]
        parts = [lost <= cut, lost > cut]
    else:
        parts = [np.ones(len(lost), bool)]
    for part in parts:
        at = np.flatnonzero(part)
        yield from at[np.argsort(lost[at], kind="stable")].tolist()


def packed_shard(rests: list[int], index: Index) -> list[list[tuple[int, int, int]]]:
    """Sequences of (text, start within its rest, length)."""
    done, out, seed = [0] * len(rests), [], 0
    unused = np.array(rests) > 0
    while True:
        while seed < len(rests) and not unused[seed]:
            seed += 1
        if seed == len(rests):
            return out
        pieces, space = [(seed, done[seed], rests[seed] - done[seed])], WINDOW - (rests[seed] - done[seed])
        unused[seed] = False
        if space >= BLOCK:
            others = np.flatnonzero(unused)
            for at in best_first(index.scores(seed)[others]):
                d = int(others[at])
                left = rests[d] - done[d]
                take = left if left <= space else space // BLOCK * BLOCK
                pieces.append((d, done[d], take))
                done[d] += take
                unused[d] = take < left
                space -= take
                if space < BLOCK:
                    break
        out.append(pieces)


def _shard_rows(rows: list[tuple], first: int) -> tuple[list[tuple], int]:
    """Pieces of the shard's texts; sequences are numbered from `first`."""
    out: list[tuple] = []
    packable, rests = [], []
    for row in rows:
        doc, total, windows = row[:3]
        for i, checksum in enumerate(windows):
            out.append((doc, i * WINDOW, WINDOW, checksum, total, first, 0))
            first += 1
        if total % WINDOW:
            packable.append(row)
            rests.append(total % WINDOW)
    if packable:
        index = Index([np.frombuffer(r[4], np.uint32) for r in packable], [np.frombuffer(r[5], np.uint32) for r in packable])
        blocks = np.frombuffer(b"".join(r[3] for r in packable), np.uint32)
        held = np.cumsum([0, *(len(r[3]) // 4 for r in packable)])
        found = packed_shard(rests, index)
        d, start, length = np.array([piece for sequence in found for piece in sequence], np.int64).T
        checksums = iter(joined_checksums(blocks, held[d] + start // BLOCK, length).tolist())
        for sequence in found:
            offset = 0
            for d, start, length in sequence:
                doc, total, windows = packable[d][:3]
                out.append((doc, len(windows) * WINDOW + start, length, next(checksums), total, first, offset))
                offset += length
            first += 1
    return out, first


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget_encoders()  # all texts are tokenized by now
    context = TaskContext.get()
    sequence = (context.partitionId() if context else 0) << 32
    held: list[tuple] = []
    kind = None
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")

    def flushed() -> pa.RecordBatch:
        nonlocal sequence, held
        rows, sequence = _shard_rows(held, sequence)
        held = []
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind if i == 0 else pa.int64()) for i in range(len(names))], names=names)

    for batch in batches:
        kind = batch.schema.field("doc_id").type
        for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "doc_tokens", "windows", "blocks", "terms", "counts")), strict=True):
            held.append(row)
            if len(held) == SHARD_DOCS:
                yield flushed()
    if held:
        yield flushed()


def sequences(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null text is empty and is the end id alone. Repeated rows and equal or null doc_ids are texts of their own. Pieces of
    a row cover each of its ids once. Other columns are not read.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = stored(
        documents.select("doc_id", "text").mapInArrow(
            lambda b: _tokenized(b, tokenizer),
            f"doc_id {kind}, doc_tokens bigint, windows array<bigint>, blocks binary, terms binary, counts binary, key bigint",
        ),
        "tokenized",
        ROWS,
    )
    ordered = rows.withColumn("tie", F.xxhash64("doc_id", "terms")).repartitionByRange("key", "tie").sortWithinPartitions("key", "tie").drop("key", "tie")
    return ordered.mapInArrow(_pack, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
