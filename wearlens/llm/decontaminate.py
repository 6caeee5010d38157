"""Benchmark decontamination by winnowing.

A window is WINDOW consecutive words of a benchmark item; an item of fewer words is one window. Of every WINDOW words the
smallest hash of a K-word gram is a fingerprint, the same one wherever these words stand, so every shared window shares a
fingerprint. Fingerprints of the benchmark fill a bit set of fixed size that is sent to all tasks; document fingerprints
found there are extended to the windows around them, which meet the benchmark's windows in an ordinary join on their
words. A full bit set only lets more windows into that join; it never changes the result. Windows of short items are
looked up for each of their (at most nine) lengths at every word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearlens.session import written

from .spread import bit_set, in_bit_set
from .textscan import ALNUM, Words, mix, text_chunks

WINDOW = 10
K = 5
BITS = 24


def fingerprints(words: Words, hashes: np.ndarray, window: int = WINDOW, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """K-gram hashes, and whether each is the smallest of some full window (equal ones all count)."""
    grams, _ = words.ngrams(hashes, k)
    left = np.repeat(words.first[1:], words.counts()) - np.arange(len(words))
    span, total = window - k + 1, len(words)
    starts = max(0, total - window + 1)
    chosen = np.zeros(total, bool)
    if starts:
        least = grams[:starts].copy()
        for d in range(1, span):
            np.minimum(least, grams[d : d + starts], out=least)
        least_valid = left[:starts] >= window
        for d in range(span):
            chosen[d : d + starts] |= least_valid & (grams[d : d + starts] == least)
    return grams, chosen


def _item_rows(batches: Iterator[pa.RecordBatch], window: int, k: int) -> Iterator[pa.RecordBatch]:
    """Per item window: item row, words, number of words, and the hashes under which documents look for it."""
    for batch in batches:
        for chunk in text_chunks(batch.column("text")):
            words = Words(chunk, ALNUM)
            hashes = words.hashes()
            grams, chosen = fingerprints(words, hashes, window, k)
            ids, keys, sizes, marks = [], [], [], []
            for d in range(chunk.docs):
                a, b = int(words.first[d]), int(words.first[d + 1])
                n = min(window, b - a)
                for i in range(a, b - n + 1) if n else ():
                    ids.append(batch.column("item_id")[chunk.first + d].as_py())
                    keys.append(words.span(i, n).decode("utf-8", "replace"))
                    sizes.append(n)
                    if n == window:
                        found = grams[i : i + window - k + 1][chosen[i : i + window - k + 1]]
                    else:
                        found = _short(hashes[i : i + n], n)
                    marks.append(np.unique(found).view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.schema.field("item_id").type), pa.array(keys, pa.string()), pa.array(sizes, pa.int32()), pa.array(marks, pa.list_(pa.int64()))],
                names=["item_id", "key", "size", "marks"],
            )


def _short(hashes: np.ndarray, n: int) -> np.ndarray:
    out = hashes[: len(hashes) - n + 1].copy()
    for j in range(1, n):
        out = mix(out * np.uint64(31) + hashes[j : j + len(out)])
    return mix(out + np.uint64(n))


def _doc_rows(batches: Iterator[pa.RecordBatch], bits: np.ndarray, lengths: list[int], window: int, k: int) -> Iterator[pa.RecordBatch]:
    """Per document: number of words and the windows that may be the benchmark's."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("size", pa.int32()), ("key", pa.string())]))
    for batch in batches:
        for chunk in text_chunks(batch.column("text")):
            words = Words(chunk, ALNUM)
            hashes, counts = words.hashes(), words.counts()
            grams, chosen = fingerprints(words, hashes, window, k)
            left = np.repeat(words.first[1:], counts) - np.arange(len(words))
            found = np.flatnonzero(chosen)
            found = found[in_bit_set(bits, grams[found])]
            starts = (found[:, None] - np.arange(window - k + 1)).ravel()
            starts = np.unique(starts[starts >= 0])
            pairs = [(starts[left[starts] >= window], window)]
            for n in lengths:
                at = np.flatnonzero(in_bit_set(bits, _short(hashes, n))) if len(hashes) >= n else np.empty(0, np.int64)
                pairs.append((at[left[at] >= n], n))
            at = np.concatenate([p for p, _ in pairs])
            size = np.concatenate([np.full(len(p), n) for p, n in pairs])
            order = np.argsort(at, kind="stable")
            at, size = at[order], size[order]
            owner = np.searchsorted(words.first, at, "right") - 1
            rows: list[list[dict]] = [[] for _ in range(chunk.docs)]
            for i, n, d in zip(at.tolist(), size.tolist(), owner.tolist()):
                rows[d].append({"start": i - int(words.first[d]), "size": n, "key": words.span(i, n).decode("utf-8", "replace")})
            ids = batch.column("doc_id").slice(chunk.first, chunk.docs)
            yield pa.RecordBatch.from_arrays([ids, pa.array(counts, pa.int64()), pa.array(rows, kind)], names=["doc_id", "n_words", "windows"])


def contaminated_words(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, items (sorted ids as strings), contaminated.

    Null and empty texts have no words; a benchmark item without an id or without words is left out; repeated rows and
    equal ids are separate documents; an empty benchmark hits nothing. Other columns are not read.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    item_kind = benchmark.schema["item_id"].dataType.simpleString()
    items = written(
        benchmark.select("item_id", "text").where("item_id is not null").mapInArrow(
            lambda b: _item_rows(b, window, k), f"item_id {item_kind}, key string, size int, marks array<bigint>"
        ),
        "benchmark-windows",
    )
    table = bit_set(items.select(F.explode("marks").alias("mark")), "mark", BITS)
    packed = documents.sparkSession.sparkContext.broadcast(table)
    lengths = sorted(r.size for r in items.where(F.col("size") < window).select("size").distinct().collect())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _doc_rows(batches, packed.value, lengths, window, k)

    rows = written(
        documents.select("doc_id", "text")
        .mapInArrow(scan, f"doc_id {kind}, n_words bigint, windows array<struct<start:int,size:int,key:string>>")
        .withColumn("row", F.monotonically_increasing_id()),
        "document-windows",
    )
    wanted = items.select("key", F.col("item_id").cast("string").alias("item")).distinct()
    hits = (
        rows.where(F.size("windows") > 0).select("row", F.explode("windows").alias("w")).select("row", "w.*")
        .join(wanted, "key")
        .groupBy("row")
        .agg(F.sort_array(F.collect_set(F.struct("start", "size"))).alias("spans"), F.sort_array(F.collect_set("item")).alias("items"))
    )
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end"))

    def cover(acc, s):
        end = s["start"] + s["size"]
        return F.struct(
            (acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], s["start"]))).cast("bigint").alias("n"),
            F.greatest(acc["end"], end).alias("end"),
        )

    hits = hits.select("row", "items", F.aggregate("spans", start, cover)["n"].alias("n_hit"))
    return (
        rows.drop("windows").join(hits, "row", "left")
        .select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
        .withColumn("contaminated", F.col("n_hit") > 0)
    )
