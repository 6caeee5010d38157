"""Language-model scoring: an interpolated modified Kneser-Ney bigram model counted in Spark, stored as sorted hash arrays.

A text is its words (lower-cased A-Z), then one end token; the first token follows a start mark. Words and bigrams are 48-bit
and 64-bit hashes. Counts are merged per batch, dealt to shards and added there; each shard writes its sorted arrays to the
shared folder: `words` (count, continuation count, numbers of followers seen once, twice, more often) by word, and `pairs`
(bigram, count). Bigrams are dealt by their first word, so its followers meet in one shard; words with more than a
SPLIT-th part of an average shard are dealt by the whole bigram and their follower numbers added up afterwards. Workers map
the arrays into memory and look up a batch at a time. On a store that cannot be mapped a worker copies the arrays it
needs to a temporary folder first.

Files are written under a name of their own and then renamed, so that a repeated or speculative task leaves one whole file.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearlens.session import scratch_path, written

from .jaccard import packed, unpacked
from .spread import dealt, shard_groups
from .textscan import SPACED, Chunk, Words, mix, text_chunks

SHARDS = 64
TOKENS = 1_500_000
SPLIT = 4
FLUSH = 3_000_000
START, END = np.uint64(0x5ACE5ACE5ACE), np.uint64(0xE0DE0DE0DE0D)


class Model(NamedTuple):
    """Where the arrays are, and the numbers that every lookup needs."""

    folder: str
    shards: int
    tokens: int
    types: int
    texts: int
    limit: int
    continuations: int
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    spare: float


def _local(folder: str) -> str | None:
    at = urlparse(folder)
    return at.path if at.scheme in ("", "file") else None


def store(folder: str, name: str, **arrays: np.ndarray) -> None:
    for key, values in arrays.items():
        target = f"{name}-{key}.npy"
        own = f"{target}.{uuid.uuid4().hex}"
        if (local := _local(folder)) is not None:
            os.makedirs(local, exist_ok=True)
            with open(f"{local}/{own}", "wb") as file:
                np.save(file, values)
            os.replace(f"{local}/{own}", f"{local}/{target}")
        else:
            system, path = fs.FileSystem.from_uri(folder)
            system.create_dir(path)
            with tempfile.TemporaryFile() as file:
                np.save(file, values)
                file.seek(0)
                with system.open_output_stream(f"{path}/{own}") as out:
                    out.write(file.read())
            system.move(f"{path}/{own}", f"{path}/{target}")


class Arrays:
    """Memory-mapped arrays of a folder; a shard without a file is empty."""

    def __init__(self, folder: str):
        self.folder, self.open, self.copies = folder, {}, None

    def get(self, name: str, key: str) -> np.ndarray:
        file = f"{name}-{key}.npy"
        if file not in self.open:
            try:
                self.open[file] = np.load(self._fetched(file), mmap_mode="r")
            except FileNotFoundError:
                self.open[file] = np.empty(0, np.uint64)
        return self.open[file]

    def _fetched(self, file: str) -> str:
        if (local := _local(self.folder)) is not None:
            return f"{local}/{file}"
        self.copies = self.copies or tempfile.TemporaryDirectory()
        system, path = fs.FileSystem.from_uri(self.folder)
        with system.open_input_stream(f"{path}/{file}") as source, open(f"{self.copies.name}/{file}", "wb") as out:
            while block := source.read(1 << 22):
                out.write(block)
        return f"{self.copies.name}/{file}"

    def find(self, kind: str, shard: np.ndarray, keys: np.ndarray, columns: tuple[str, ...]) -> list[np.ndarray]:
        """The columns' values of each key, 0 for unknown ones; each shard's array is visited once, in order."""
        out = [np.zeros(len(keys), np.int64) for _ in columns]
        order = np.lexsort((keys, shard))
        edges = np.flatnonzero(np.append(True, shard[order][1:] != shard[order][:-1])) if len(keys) else []
        for a, b in zip(edges, [*edges[1:], len(keys)], strict=True):
            at = order[a:b]
            name = f"{kind}-{shard[at[0]]}"
            known = self.get(name, "keys")
            if not len(known):
                continue
            place = np.minimum(np.searchsorted(known, keys[at]), len(known) - 1)
            hit = known[place] == keys[at]
            for values, column in zip(out, columns, strict=True):
                values[at[hit]] = self.get(name, column)[place[hit]]
        return out


def tokens(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Previous and own 48-bit hash of every token, and the first token of each document."""
    words = Words(chunk, SPACED)
    first = words.first[:-1] + np.arange(chunk.docs)
    own = np.full(len(words) + chunk.docs, END, np.uint64)
    own[np.arange(len(words)) + words.doc()] = words.hashes() >> np.uint64(16)
    before = np.empty_like(own)
    before[1:] = own[:-1]
    before[first] = START
    return before, own, first


def pair_keys(before: np.ndarray, own: np.ndarray) -> np.ndarray:
    return mix(mix(before * np.uint64(0x9E3779B97F4A7C15)) + own)


def word_shard(word: np.ndarray, shards: int) -> np.ndarray:
    return (mix(word + np.uint64(77)) % np.uint64(shards)).astype(np.int64)


def _added(order_keys: tuple[np.ndarray, ...], counts: np.ndarray) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """Distinct keys (sorted by the last of `order_keys` first) and the sums of their counts."""
    order = np.lexsort(order_keys) if len(order_keys) > 1 else np.argsort(order_keys[0], kind="stable")
    keys = tuple(k[order] for k in order_keys)
    fresh = np.ones(len(order), bool)
    fresh[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    first = np.flatnonzero(fresh)
    return tuple(k[first] for k in keys), np.add.reduceat(counts[order], first) if len(first) else counts[:0]


def _rows(kind: int, shard: np.ndarray, shards: int, *columns: np.ndarray) -> pa.RecordBatch:
    """A row per shard with the columns' parts as bytes."""
    order = np.argsort(shard, kind="stable")
    edges = np.searchsorted(shard[order], np.arange(shards + 1))
    full = np.flatnonzero(np.diff(edges))
    cells = [[c[order[edges[s] : edges[s + 1]]].tobytes() for s in full] for c in columns]
    return pa.RecordBatch.from_arrays(
        [pa.array(full, pa.int32()), pa.array(np.full(len(full), kind, np.int32)), *(pa.array(c, pa.binary()) for c in cells)],
        names=["shard", "kind", *(f"c{i}" for i in range(len(columns)))],
    )


def _six(words: np.ndarray) -> np.ndarray:
    """Rows of six bytes, so that parts of the array can be cut out."""
    return np.frombuffer(packed(words), np.uint8).reshape(-1, 6)


def _cell(parts: list[pa.RecordBatch], column: str, dtype: type | None) -> np.ndarray:
    cells = [c.as_py() for p in parts for c in p.column(column)]
    if dtype is None:
        return unpacked(b"".join(cells))
    return np.frombuffer(b"".join(cells), dtype)


def _count_words(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    for batch in batches:
        for chunk in text_chunks(batch.column("text")):
            held.append(tokens(chunk)[1])
            if sum(map(len, held)) > FLUSH:
                yield _word_rows(held, shards)
                held = []
    if held:
        yield _word_rows(held, shards)


def _word_rows(held: list[np.ndarray], shards: int) -> pa.RecordBatch:
    words, counts = np.unique(np.concatenate(held), return_counts=True)
    return _rows(0, word_shard(words, shards), shards, _six(words), counts.astype(np.uint32))


def _add_words(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    for shard, parts in shard_groups(batches):
        (words,), counts = _added((_cell(parts, "c0", None),), _cell(parts, "c1", np.uint32).astype(np.int64))
        store(folder, f"counts-{shard}", keys=words, count=counts)
        yield pa.RecordBatch.from_arrays([pa.array([len(words)], pa.int64()), pa.array([int(counts.sum())], pa.int64())], names=["types", "tokens"])


def _pair_shard(arrays: Arrays, before: np.ndarray, own: np.ndarray, shards: int, limit: int, kind: str) -> np.ndarray:
    """Shard of each bigram: by its first word, or by both words where the first one is more frequent than `limit`."""
    names, back = np.unique(before, return_inverse=True)
    (count,) = arrays.find(kind, word_shard(names, shards), names, ("count",))
    frequent = ((count > limit) | (names == START))[back]
    by_word, by_pair = word_shard(names, shards)[back], (pair_keys(before, own) % np.uint64(shards)).astype(np.int64)
    return np.where(frequent, by_pair, by_word)


def _count_pairs(batches: Iterator[pa.RecordBatch], folder: str, shards: int, limit: int) -> Iterator[pa.RecordBatch]:
    arrays, held, size = Arrays(folder), [], 0
    for batch in batches:
        for chunk in text_chunks(batch.column("text")):
            before, own, _ = tokens(chunk)
            held.append((before, own))
            size += len(own)
            if size > FLUSH:
                yield _pair_rows(held, arrays, shards, limit)
                held, size = [], 0
    if held:
        yield _pair_rows(held, arrays, shards, limit)


def _pair_rows(held: list[tuple[np.ndarray, np.ndarray]], arrays: Arrays, shards: int, limit: int) -> pa.RecordBatch:
    before, own = (np.concatenate(x) for x in zip(*held, strict=True))
    (own, before), counts = _added((own, before), np.ones(len(own), np.int64))
    shard = _pair_shard(arrays, before, own, shards, limit, "counts")
    order = np.lexsort((before, shard))
    before, own, counts, shard = before[order], own[order], counts[order], shard[order]
    edges = np.searchsorted(shard, np.arange(shards + 1))
    full = np.flatnonzero(np.diff(edges))
    columns: list[list[bytes]] = [[], [], [], []]
    for s in full:
        part = slice(edges[s], edges[s + 1])
        names, sizes = np.unique(before[part], return_counts=True)
        # counts are mostly 1: small ones take a byte, larger ones follow apart
        small = np.minimum(counts[part], 255).astype(np.uint8)
        large = counts[part][small == 255].astype(np.uint32)
        for column, cell in zip(columns, (packed(names) + sizes.astype(np.uint32).tobytes(), packed(own[part]), small.tobytes(), large.tobytes()), strict=True):
            column.append(cell)
    return pa.RecordBatch.from_arrays(
        [pa.array(full, pa.int32()), *(pa.array(c, pa.binary()) for c in columns)], names=["shard", "firsts", "owns", "small", "large"]
    )


def _pairs_of(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    before, own, counts = [], [], []
    for p in parts:
        for firsts, owns, small, large in zip(*(p.column(c) for c in ("firsts", "owns", "small", "large")), strict=True):
            cell = firsts.as_py()
            n = len(cell) // 10
            before.append(np.repeat(unpacked(cell[: 6 * n]), np.frombuffer(cell[6 * n :], np.uint32)))
            own.append(unpacked(owns.as_py()))
            count = np.frombuffer(small.as_py(), np.uint8).astype(np.int64)
            count[count == 255] = np.frombuffer(large.as_py(), np.uint32)
            counts.append(count)
    return np.concatenate(before), np.concatenate(own), np.concatenate(counts)


def _add_pairs(batches: Iterator[pa.RecordBatch], folder: str, shards: int) -> Iterator[pa.RecordBatch]:
    """Writes the shard's bigrams; returns count-of-counts (kind 2), continuations by word (0) and follower numbers (1)."""
    for shard, parts in shard_groups(batches):
        before, own, counts = _pairs_of(parts)
        (own, before), counts = _added((own, before), counts)
        keys = pair_keys(before, own)
        order = np.argsort(keys)
        store(folder, f"pairs-{shard}", keys=keys[order], count=counts[order].astype(np.uint32))
        words, continuations = np.unique(own, return_counts=True)
        yield _with(_rows(0, word_shard(words, shards), shards, _six(words), continuations.astype(np.uint32)))
        first = np.flatnonzero(np.append(True, before[1:] != before[:-1]))
        followers = np.stack([np.add.reduceat((counts == k) if k < 3 else (counts >= 3), first) for k in (1, 2, 3)], axis=1).astype(np.uint32)
        yield _with(_rows(1, word_shard(before[first], shards), shards, _six(before[first]), followers))
        totals = np.array([(counts == k).sum() for k in (1, 2, 3, 4)], np.int64)
        yield _with(pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([2], pa.int32()), pa.array([b""], pa.binary()), pa.array([b""], pa.binary())], names=["shard", "kind", "c0", "c1"]), totals)


def _with(batch: pa.RecordBatch, totals: np.ndarray | None = None) -> pa.RecordBatch:
    n = batch.num_rows
    values = [pa.array(np.full(n, int(totals[k]) if totals is not None else 0), pa.int64()) for k in range(4)]
    return pa.RecordBatch.from_arrays([*batch.columns, *values], names=[*batch.schema.names, "n1", "n2", "n3", "n4"])


def _add_stats(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    arrays = Arrays(folder)
    for shard, parts in shard_groups(batches):
        table = pa.Table.from_batches(parts)
        kinds = table.column("kind").to_numpy()
        of = [table.filter(pa.array(kinds == k)).to_batches() for k in (0, 1)]
        (words,), continuations = _added((_cell(of[0], "c0", None),), _cell(of[0], "c1", np.uint32).astype(np.int64))
        names, followers = _cell(of[1], "c0", None), _cell(of[1], "c1", np.uint32).reshape(-1, 3).astype(np.int64)
        every = np.union1d(words, names)
        cont = np.zeros(len(every), np.int64)
        cont[np.searchsorted(every, words)] = continuations
        follow = np.zeros((len(every), 3), np.int64)
        np.add.at(follow, np.searchsorted(every, names), followers)
        (count,) = arrays.find("counts", np.full(len(every), shard), every, ("count",))
        store(
            folder, f"words-{shard}", keys=every, count=count, cont=cont.astype(np.uint32),
            f1=follow[:, 0].astype(np.uint32), f2=follow[:, 1].astype(np.uint32), f3=follow[:, 2].astype(np.uint32),
        )
        totals = [int((cont == k).sum()) for k in (1, 2, 3, 4)]
        more = [int((cont >= 3).sum()), int(cont.sum())]
        yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in (*totals, *more)], names=["n1", "n2", "n3", "n4", "n3up", "total"])


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts; where a count-of-counts is 0, the usual absolute discount."""
    if not (n1 and n2 and n3 and n4):
        return (0.5, 0.75, 0.9)
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in enumerate(found, 1))


def fit(documents: DataFrame) -> Model:
    """Counts of all rows' whole texts; a null text is empty and still ends. Equal rows count as often as they stand there."""
    docs = documents.select("text")
    size = docs.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    shards = max(SHARDS, -(-(size[0] or 0) // 6 // TOKENS))
    folder = scratch_path(documents.sparkSession, "kneser")
    counted = dealt(docs.mapInArrow(lambda b: _count_words(b, shards), "shard int, kind int, c0 binary, c1 binary"))
    sums = written(counted.mapInArrow(lambda b: _add_words(b, folder), "types bigint, tokens bigint"), "word-sums").agg(F.sum("types"), F.sum("tokens")).first()
    types, total = sums[0] or 0, sums[1] or 0
    limit = max(1, total // (SPLIT * shards))
    paired = dealt(docs.mapInArrow(lambda b: _count_pairs(b, folder, shards, limit), "shard int, firsts binary, owns binary, small binary, large binary"))
    added = written(
        paired.mapInArrow(lambda b: _add_pairs(b, folder, shards), "shard int, kind int, c0 binary, c1 binary, n1 bigint, n2 bigint, n3 bigint, n4 bigint"),
        "pair-sums",
    )
    of_pairs = [v or 0 for v in added.where("kind = 2").agg(*(F.sum(f"n{k}") for k in (1, 2, 3, 4))).first()]
    stats = dealt(added.where("kind < 2").select("shard", "kind", "c0", "c1"))
    names = ("n1", "n2", "n3", "n4", "n3up", "total")
    of_words = [v or 0 for v in written(stats.mapInArrow(lambda b: _add_stats(b, folder), ", ".join(f"{c} bigint" for c in names)), "word-stats").agg(*(F.sum(c) for c in names)).first()]
    d = discounts(*of_words[:4])
    spare = (d[0] * of_words[0] + d[1] * of_words[1] + d[2] * of_words[4]) / max(1, of_words[5])
    return Model(folder, shards, total, types, size[1], limit, of_words[5], discounts(*of_pairs), d, spare)


def _off(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(counts, 3)]


def chunk_scores(chunk: Chunk, arrays: Arrays, m: Model) -> tuple[np.ndarray, ...]:
    """Per document: tokens, known tokens, base score and model score (log10)."""
    before, own, first = tokens(chunk)
    names, back = np.unique(np.concatenate([own, before]), return_inverse=True)
    count, cont, f1, f2, f3 = arrays.find("words", word_shard(names, m.shards), names, ("count", "cont", "f1", "f2", "f3"))
    count[names == START] = 0
    of, prior = back[: len(own)], back[len(own) :]
    base = np.log10((count + 1) / (m.tokens + m.types + 1))
    lower = (cont - _off(cont, m.word_discounts)) / max(1, m.continuations) + (m.spare if m.continuations else 1.0) / (m.types + 1)
    # every occurrence of a word but the end is followed by a token; the start is followed once per text
    total = np.where(names == START, m.texts, np.where(names == END, 0, count)).astype(float)
    left = (m.pair_discounts[0] * f1 + m.pair_discounts[1] * f2 + m.pair_discounts[2] * f3) / np.maximum(total, 1)
    left[total == 0] = 1.0
    by_word = word_shard(names, m.shards)[prior]
    keys = pair_keys(before, own)
    frequent = ((count > m.limit) | (names == START))[prior]
    shard = np.where(frequent, (keys % np.uint64(m.shards)).astype(np.int64), by_word)
    (pair,) = arrays.find("pairs", shard, keys, ("count",))
    p = np.where(total[prior] > 0, (pair - _off(pair, m.pair_discounts)) / np.maximum(total[prior], 1), 0.0) + left[prior] * lower[of]
    sums = [np.add.reduceat(v, first) for v in (np.ones(len(own), np.int64), (count[of] > 0).astype(np.int64), base[of], np.log10(p))]
    return tuple(sums)


def scores(documents: DataFrame, model: Model) -> DataFrame:
    """The rows of `documents` with n_tokens, n_known, base_score and lm_score; input columns of these names are replaced.

    A null or empty text is its end token alone. Every other column is kept and not read.
    """
    new = ("n_tokens", "n_known", "base_score", "lm_score")
    kept = documents.drop(*new)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = Arrays(model.folder)
        for batch in batches:
            parts = [chunk_scores(c, arrays, model) for c in text_chunks(batch.column("text"))]
            columns = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.empty(0, t) for t in (int, int, float, float)]
            types = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[*batch.schema.names, *new])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(score, f"{schema}, n_tokens bigint, n_known bigint, base_score double, lm_score double")
