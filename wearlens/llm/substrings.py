"""Removal of long passages that stand in an earlier document, by a sharded run-compressed index.

A passage of LENGTH bytes is found through an anchor: a K-gram with the smallest hash among those of some LENGTH-byte
window, so that equal windows have the same anchors at the same places. Only anchors are indexed (a sparse index), with up
to LENGTH - K bytes on the left and LENGTH bytes on the right, their context; no window that holds the anchor reaches beyond.

1. Every document sends, per anchor, hashes of the anchor and of its context to the anchor's shard. Equal contexts are one
   run there; the run keeps one sample, its smallest document. All other documents of the run have every window of the
   context from that earlier document. No text is needed for them, however many copies there are.
2. Where an anchor has several contexts, the sampled document of each run sends the context's bytes. Within a shard the
   runs are sorted by their right context, with the common prefix lengths of neighbours and the preceding bytes, which is a
   Burrows-Wheeler order over the anchored suffixes. Matching statistics are streamed by backward steps: each step takes one
   more preceding byte and one byte less on the right; rows that agree in both form a run, whose smallest document is its
   sample. A window is marked if the sample is smaller than its own document.
3. Each document gets its marks, and removes all bytes of marked windows.

Suffixes are ordered inside the shard of their anchor only: windows of different shards cannot be equal. A BWT over
every byte of the corpus is not built.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jaccard import packed, unpacked
from .spread import bit_set, dealt, in_bit_set, joined, shard_groups, stored
from .textscan import Chunk, mix, powers, text_chunks

LENGTH = 50
K = 20
SHARDS = 64
POSTINGS = 3_000_000
SEGMENT = 1 << 18
ID_BITS = 24
FLUSH = 400_000
ROWS = 256
_CODES = mix(np.arange(256, dtype=np.uint64) + np.uint64(0xABCDEF)) | np.uint64(1)
_A, _B = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class Anchors(NamedTuple):
    doc: np.ndarray
    place: np.ndarray
    gram: np.ndarray
    context: np.ndarray
    left: np.ndarray
    right: np.ndarray

    def take(self, at: np.ndarray) -> Anchors:
        return Anchors(*(x[at] for x in self))


def _slide(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum or maximum of `width` values from each place on."""
    pick, done = np.minimum if least else np.maximum, 1
    while done < width:
        step = min(done, width - done)
        values = pick(values[: len(values) - step], values[step:])
        done += step
    return values


def anchors(chunk: Chunk) -> Anchors:
    """All anchors of the chunk, by segments of bounded size that overlap by what a window can reach."""
    parts, total, span = [], len(chunk.buf), LENGTH - K + 1
    bounds = chunk.offsets
    for low in range(0, total, SEGMENT):
        a, b = max(0, low - 2 * LENGTH), min(total, low + SEGMENT + 2 * LENGTH)
        size = b - a
        if size < LENGTH:
            continue
        power, inverse = powers(size + 1)
        run = np.zeros(size + 1, np.uint64)
        np.cumsum(_CODES[chunk.buf[a:b]] * power[:size], out=run[1:])
        gram = mix((run[K:] - run[:-K]) * inverse[: size - K + 1])
        gram |= np.uint64(1)
        # where the document of each place of the segment starts and ends
        first, last = np.searchsorted(bounds, [a, b - 1], "right") - 1
        starts, ends = bounds[first : last + 1], bounds[first + 1 : last + 2]
        lengths = np.minimum(ends, b) - np.maximum(starts, a)
        start, end = np.repeat(starts, lengths) - a, np.repeat(ends, lengths) - a
        windows = size - LENGTH + 1
        smallest = _slide(gram, span, True)[:windows]
        smallest[end[:windows] - np.arange(windows) < LENGTH] = 0
        padded = np.zeros(windows + 2 * (span - 1), np.uint64)
        padded[span - 1 : span - 1 + windows] = smallest
        chosen = np.flatnonzero(_slide(padded, span, False)[: size - K + 1] == gram)
        chosen = chosen[(chosen + a >= low) & (chosen + a < low + SEGMENT)]
        left = np.minimum(LENGTH - K, chosen - start[chosen])
        right = np.minimum(LENGTH, end[chosen] - chosen)
        lo, hi = chosen - left, chosen + right
        context = mix((run[hi] - run[lo]) * inverse[lo] + left.astype(np.uint64) * _A + right.astype(np.uint64) * _B) >> np.uint64(16)
        place = chosen + a
        parts.append(Anchors(np.searchsorted(bounds, place, "right") - 1, place, gram[chosen], context, left, right))
    if not parts:
        none = np.empty(0, np.int64)
        return Anchors(none, none, none.astype(np.uint64), none.astype(np.uint64), none, none)
    return Anchors(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def _posted(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """Per shard and batch: anchor and context hashes in the order of the documents, and how many each document has."""
    for batch in batches:
        ids = np.asarray(batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False), np.int64)
        known = np.asarray(batch.column("doc_id").is_valid())
        found: list[tuple[np.ndarray, ...]] = []
        held = 0
        for chunk in text_chunks(batch.column("text")):
            a = anchors(chunk)
            order = np.lexsort((a.context, a.doc))
            doc, context = a.doc[order], a.context[order]
            fresh = np.ones(len(doc), bool)
            fresh[1:] = (doc[1:] != doc[:-1]) | (context[1:] != context[:-1])
            fresh &= known[doc + chunk.first]
            order = order[fresh]
            found.append((a.doc[order] + chunk.first, a.gram[order], a.context[order]))
            held += len(order)
            if held > FLUSH:
                yield _dealt_out(found, ids, shards)
                found, held = [], 0
        if found:
            yield _dealt_out(found, ids, shards)


def _dealt_out(found: list[tuple[np.ndarray, ...]], ids: np.ndarray, shards: int) -> pa.RecordBatch:
    doc, gram, context = (np.concatenate(x) for x in zip(*found, strict=True))
    shard = ((gram >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)
    order = np.lexsort((doc, shard))
    doc, gram, context, shard = doc[order], gram[order].astype(np.uint32), context[order], shard[order]
    edges = np.searchsorted(shard, np.arange(shards + 1))
    full = np.flatnonzero(np.diff(edges))
    rows: list[list] = [[], [], [], []]
    for s in full:
        part = slice(edges[s], edges[s + 1])
        docs, counts = np.unique(doc[part], return_counts=True)
        for column, cell in zip(rows, (gram[part].tobytes(), packed(context[part]), zlib.compress(ids[docs].tobytes(), 1), zlib.compress(counts.astype(np.uint32).tobytes(), 1)), strict=True):
            column.append(cell)
    return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *(pa.array(c, pa.binary()) for c in rows)], names=["shard", "grams", "contexts", "docs", "counts"])


def _by_doc(doc: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, list[list[np.ndarray]]]:
    """Distinct documents, and per value array its parts for them."""
    order = np.argsort(doc, kind="stable")
    names, first = np.unique(doc[order], return_index=True)
    return names, [np.split(v[order], first[1:]) if len(names) else [] for v in values]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document of the shard: contexts that an earlier document has (`same`), and contexts whose bytes are wanted."""
    for _, parts in shard_groups(batches):
        gram = joined(parts, "grams", np.uint32)
        context = np.concatenate([unpacked(c.as_py()) for p in parts for c in p.column("contexts")])
        doc = np.concatenate([
            np.repeat(np.frombuffer(zlib.decompress(d.as_py()), np.int64), np.frombuffer(zlib.decompress(c.as_py()), np.uint32))
            for p in parts for d, c in zip(p.column("docs"), p.column("counts"), strict=True)
        ])
        order = np.lexsort((doc, context, gram))
        gram, context, doc = gram[order], context[order], doc[order]
        new_gram = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
        several = np.minimum.reduceat(doc, new_gram) != np.maximum.reduceat(doc, new_gram)
        keep = np.repeat(several, np.diff(np.append(new_gram, len(gram))))
        gram, context, doc = gram[keep], context[keep], doc[keep]
        if not len(gram):
            continue
        new_gram = np.append(True, gram[1:] != gram[:-1])
        new_run = new_gram | np.append(True, context[1:] != context[:-1])
        run = np.flatnonzero(new_run)
        sample = np.repeat(doc[run], np.diff(np.append(run, len(doc))))
        same = doc > sample
        of_gram = np.cumsum(new_gram)[run] - 1
        wanted = run[np.bincount(of_gram)[of_gram] > 1]
        marks = np.concatenate([np.zeros(same.sum(), np.int8), np.ones(len(wanted), np.int8)])
        names, (values, kinds) = _by_doc(np.concatenate([doc[same], doc[wanted]]), np.concatenate([context[same], context[wanted]]), marks)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(names, pa.int64()),
                pa.array([packed(v[k == 0]) for v, k in zip(values, kinds, strict=True)], pa.binary()),
                pa.array([packed(v[k == 1]) for v, k in zip(values, kinds, strict=True)], pa.binary()),
            ],
            names=["doc_id", "same", "wanted"],
        )


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Few rows at a time, so that few texts are unpacked at once."""
    for batch in batches:
        for row in range(0, batch.num_rows, ROWS):
            yield batch.slice(row, ROWS)


def _texts(batch: pa.RecordBatch) -> pa.Array:
    unzip = zstandard.ZstdDecompressor()
    cells = [unzip.decompress(c.as_py()) for c in batch.column("zipped")]
    offsets = np.concatenate([[0], np.cumsum([len(c) for c in cells])]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(cells), pa.py_buffer(offsets), pa.py_buffer(b"".join(cells)))


def _cells(batch: pa.RecordBatch, column: str, rows: range) -> tuple[np.ndarray, np.ndarray]:
    """Row within the rows, and value, of the packed contexts collected per row."""
    values = [unpacked(b"".join(c.as_py() or ())) for c in batch.column(column)[rows.start : rows.stop]]
    return np.repeat(np.arange(len(values)), [len(v) for v in values]), np.concatenate(values) if values else np.empty(0, np.uint64)


def _known(a: Anchors, doc: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Which anchors' (document, context) are listed; -1 or the place in the list."""
    order = np.lexsort((context, doc))
    # a document's number fits above 48 bits: chunks hold fewer than 2^16 documents, longer ones are split below
    listed = (doc[order].astype(np.uint64) << np.uint64(48)) | context[order]
    asked = (a.doc.astype(np.uint64) << np.uint64(48)) | a.context
    at = np.minimum(np.searchsorted(listed, asked), max(0, len(listed) - 1))
    return np.where(listed[at] == asked, order[at], -1) if len(listed) else np.full(len(asked), -1)


def _contexts(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """Bytes of the wanted contexts, dealt to the anchors' shards."""
    for batch in _slices(batches):
        ids = np.asarray(batch.column("doc_id"), np.int64)
        for chunk in text_chunks(_texts(batch)):
            rows = range(chunk.first, chunk.first + chunk.docs)
            a = anchors(chunk)
            listed = _known(a, *_cells(batch, "wanted", rows))
            _, once = np.unique(listed, return_index=True)
            a = a.take(once[listed[once] >= 0])
            at = a.place[:, None] + np.arange(K - LENGTH, LENGTH)
            inside = (at >= (a.place - a.left)[:, None]) & (at < (a.place + a.right)[:, None])
            raw = np.where(inside, chunk.buf[np.clip(at, 0, max(0, len(chunk.buf) - 1))], 0).astype(np.uint8)
            shard = ((a.gram >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            edges = np.searchsorted(shard[order], np.arange(shards + 1))
            columns: list[list] = [[], [], [], []]
            full = np.flatnonzero(np.diff(edges))
            for s in full:
                part = order[edges[s] : edges[s + 1]]
                sides = np.stack([a.left[part], a.right[part]], axis=1).astype(np.uint8)
                for column, cell in zip(columns, (ids[rows.start + a.doc[part]], a.context[part], sides, raw[part]), strict=True):
                    column.append(cell.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], names=["shard", "ids", "contexts", "sides", "raw"])


def matching(raw: np.ndarray, left: np.ndarray, right: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Per context a bit l for the window that starts l bytes before its anchor, set if a smaller document has it.

    Rows are put in the order of their right contexts once. Step l keeps rows together whose right contexts agree in
    LENGTH - l bytes (an interval of that order) and whose l preceding bytes agree.
    """
    side = LENGTH - K
    tail = np.ascontiguousarray(raw[:, side:])
    order = np.argsort(tail.view(f"S{LENGTH}").ravel(), kind="stable")
    tail, head, doc, left, right = tail[order], raw[order, :side], doc[order], left[order], right[order]
    differ = tail[1:] != tail[:-1]
    common = np.where(differ.any(1), differ.argmax(1), LENGTH)
    before, out = np.zeros(len(doc), np.uint64), np.zeros(len(doc), np.uint32)
    for step in range(side + 1):
        if step:
            before = mix(before * _A + head[:, side - step].astype(np.uint64) + np.uint64(1))
        interval = np.concatenate([[0], np.cumsum(common < LENGTH - step)]).astype(np.uint64)
        rows = np.flatnonzero((left >= step) & (right >= LENGTH - step))
        if not len(rows):
            continue
        key = mix(before[rows] + mix(interval[rows] * _B + np.uint64(step)))
        by = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.append(True, key[by][1:] != key[by][:-1]))
        sample = np.repeat(np.minimum.reduceat(doc[rows][by], first), np.diff(np.append(first, len(by))))
        out[rows[by[doc[rows][by] > sample]]] |= np.uint32(1 << step)
    back = np.empty_like(out)
    back[order] = out
    return back


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    width = 2 * LENGTH - K
    for _, parts in shard_groups(batches):
        doc, context = joined(parts, "ids", np.int64), joined(parts, "contexts", np.uint64)
        sides, raw = joined(parts, "sides", np.uint8).reshape(-1, 2), joined(parts, "raw", np.uint8).reshape(-1, width)
        mask = matching(raw, sides[:, 0], sides[:, 1], doc)
        some = mask > 0
        names, (keys, masks) = _by_doc(doc[some], context[some], mask[some])
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.int64()), pa.array([packed(k) for k in keys], pa.binary()), pa.array([m.tobytes() for m in masks], pa.binary())],
            names=["doc_id", "keys", "masks"],
        )


def removed_bytes(chunk: Chunk, a: Anchors, same: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Which bytes of the chunk go: whole contexts of `same` anchors, and the windows of each mask."""
    change = np.zeros(len(chunk.buf) + 1, np.int32)

    def cover(start: np.ndarray, end: np.ndarray) -> None:
        np.add.at(change, start, 1)
        np.add.at(change, end, -1)

    whole = same & (a.left + a.right >= LENGTH)
    cover((a.place - a.left)[whole], (a.place + a.right)[whole])
    for step in range(LENGTH - K + 1):
        at = a.place[(mask >> np.uint32(step)) & np.uint32(1) == 1] - step
        cover(at, at + LENGTH)
    return np.cumsum(change[:-1]) > 0


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        ids, sizes, gone, spans, texts = batch.column("doc_id"), [], [], [], []
        for chunk in text_chunks(_texts(batch)):
            rows = range(chunk.first, chunk.first + chunk.docs)
            a = anchors(chunk)
            same = _known(a, *_cells(batch, "same", rows)) >= 0
            owner, keys = _cells(batch, "keys", rows)
            listed = _known(a, owner, keys)
            masks = np.frombuffer(b"".join(m for c in batch.column("masks")[rows.start : rows.stop] for m in (c.as_py() or ())), np.uint32)
            mask = np.where(listed >= 0, masks[listed], 0).astype(np.uint32) if len(masks) else np.zeros(len(same), np.uint32)
            away = removed_bytes(chunk, a, same, mask)
            for d in range(chunk.docs):
                part = slice(int(chunk.offsets[d]), int(chunk.offsets[d + 1]))
                out = away[part]
                sizes.append(len(out))
                gone.append(int(out.sum()))
                spans.append(int((out[1:] & ~out[:-1]).sum() + out[:1].sum()))
                texts.append(chunk.buf[part][~out].tobytes())
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts]), pa.array(texts, pa.binary())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
        )


def _zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        cells = [pack.compress((t.as_py() or "").encode()) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(cells, pa.binary())], names=["doc_id", "zipped"])


def without_repeats(documents: DataFrame) -> DataFrame:
    """Per document row: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, kept (remaining bytes).

    doc_id is an integer. A null text is empty; texts below LENGTH bytes and rows without a doc_id keep everything and are
    no source; rows that share a doc_id are no source for each other. Other columns are not read.
    """
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    volume = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(SHARDS, -(-volume // 16 // POSTINGS))
    posted = docs.mapInArrow(lambda b: _posted(b, shards), "shard int, grams binary, contexts binary, docs binary, counts binary")
    runs = stored(dealt(posted).mapInArrow(_runs, "doc_id bigint, same binary, wanted binary"), "runs")

    asked = runs.where("length(wanted) > 0")
    named = documents.sparkSession.sparkContext.broadcast(bit_set(asked.select(F.xxhash64("doc_id").alias("slot")).distinct(), "slot", ID_BITS))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = batch.column("slot").to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(in_bit_set(named.value, slot))).select(["doc_id", "text"])

    some = docs.where("doc_id is not null").withColumn("slot", F.xxhash64("doc_id")).mapInArrow(pick, "doc_id bigint, text string")
    wanted = asked.groupBy("doc_id").agg(F.collect_list("wanted").alias("wanted"))
    contexts = some.mapInArrow(_zipped, "doc_id bigint, zipped binary").join(wanted, "doc_id").mapInArrow(
        lambda b: _contexts(b, shards), "shard int, ids binary, contexts binary, sides binary, raw binary"
    )
    marks = stored(dealt(contexts).mapInArrow(_marked, "doc_id bigint, keys binary, masks binary"), "marks")

    found = (
        runs.where("length(same) > 0").select("doc_id", "same", F.lit(None).cast("binary").alias("keys"), F.lit(None).cast("binary").alias("masks"))
        .unionByName(marks, allowMissingColumns=True)
        .groupBy("doc_id").agg(*(F.collect_list(c).alias(c) for c in ("same", "keys", "masks")))
    )
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
    return docs.mapInArrow(_zipped, "doc_id bigint, zipped binary").join(found, "doc_id", "left").mapInArrow(_kept, schema)
