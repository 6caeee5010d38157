"""Quality rules: repetition inside a document, and lines that many documents of a host share.

A normalised line is the line lower-cased (A-Z) with white space collapsed to single spaces. For each host the number of
distinct documents that hold a line is counted over all documents, copies of a whole text counting once. A line is above
the limit if at least MIN_DOCS such documents hold it, and more than the square root of the host's number of them: the limit of a
host of a hundred million documents is ten thousand, not millions. Lines above the limit are removed; a document that keeps
less than KEEP of its words is depleted and rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wearlens.session import written

from .textscan import SPACED, Words, text_chunks

MIN_DOCS = 20
#: A line that very many documents hold is joined over this many parts of them; adaptive execution splits what is still large.
SALTS = 16
KEEP = 0.5
MIN_WORDS = 50

SYMBOLS = re.compile(rb"[#*$%&|<>]")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_CONTINUED = np.array([(b & 0xC0) == 0x80 for b in range(256)])


def _repeats(keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Whether each (owner, key) occurs more than once."""
    order = np.lexsort((keys, owner))
    same = (keys[order][1:] == keys[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document: the counts of the base rules and, per line with a word, its hash and number of words."""
    for batch in batches:
        for chunk in text_chunks(batch.column("text")):
            words = Words(chunk, SPACED)
            counts, owner = words.counts(), words.doc()
            joined = np.concatenate([[0], np.cumsum(~_CONTINUED[chunk.buf])])
            chars = np.bincount(owner, joined[words.ends] - joined[words.starts], chunk.docs).astype(np.int64)
            # words keep their case here: the three-word windows are told apart as they stand
            exact = _case_hashes(words)
            grams, whole = _triples(words, exact)
            places = np.flatnonzero(whole)
            twice = places[_repeats(grams[places], owner[places])]
            covered = np.zeros(len(words), bool)
            for j in range(3):
                covered[twice + j] = True
            repeated = np.bincount(owner[covered], minlength=chunk.docs)
            symbols, doubled, line_keys, line_words, copies = [], [], [], [], []
            for d in range(chunk.docs):
                text = chunk.text(d)
                symbols.append(len(SYMBOLS.findall(text)))
                seen: set[bytes] = set()
                lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\x0b\x0c\r")]
                doubled.append(sum(x in seen or seen.add(x) is not None for x in lines))
                parts = [x.translate(_LOWER).split() for x in lines]
                line_keys.append([xxhash.xxh3_64_intdigest(b" ".join(p)) - (1 << 63) for p in parts])
                line_words.append([len(p) for p in parts])
                copies.append(xxhash.xxh3_64_intdigest(text) - (1 << 63))
            rows = slice(chunk.first, chunk.first + chunk.docs)
            ids = [batch.column(c)[rows] for c in ("doc_id", "host")]
            yield pa.RecordBatch.from_arrays(
                [*ids, pa.array(counts, pa.int64()), pa.array(chars), pa.array(symbols, pa.int64()), pa.array(doubled, pa.int64()),
                 pa.array(repeated, pa.int64()), pa.array(copies, pa.int64()), pa.array(line_keys, pa.list_(pa.int64())), pa.array(line_words, pa.list_(pa.int32()))],
                names=["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "copy", "lines", "sizes"],
            )


def _case_hashes(words: Words) -> np.ndarray:
    """Word hashes that tell upper from lower case: the lower-case hash and the pattern of the capitals."""
    buf = words.chunk.buf
    capital = ((buf >= 65) & (buf <= 90)).astype(np.uint64)
    if not capital.any():
        return words.hashes()
    place = np.zeros(len(buf), np.uint64)
    lengths = words.ends - words.starts
    inside = np.repeat(words.starts, lengths)
    at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    weights = (at.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    weights ^= weights >> np.uint64(29)
    weights *= np.uint64(0xBF58476D1CE4E5B9)
    place[inside + at] = weights
    total = np.concatenate([[np.uint64(0)], np.cumsum(place * capital)])
    return words.hashes() + (total[words.ends] - total[words.starts])


def _triples(words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return words.ngrams(hashes, 3)


def judged(documents: DataFrame, host: str = "source", min_docs: int = MIN_DOCS, keep: float = KEEP) -> DataFrame:
    """Per document row: doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, common_words (words in
    lines above the limit), depleted, base_failed, kept.

    Null texts have no words (and fail the base rules); a null host is a host of its own; repeated rows are documents of
    their own, but copies of a text count once in a line's frequency. Other columns are not read.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = written(
        documents.select("doc_id", F.col(host).cast("string").alias("host"), "text").mapInArrow(
            _measure,
            f"doc_id {kind}, host string, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
            "copy bigint, lines array<bigint>, sizes array<int>",
        ).withColumn("row", F.monotonically_increasing_id()),
        "line-hashes",
    )
    texts = rows.select("host", "copy").distinct().groupBy("host").agg(F.count("*").alias("docs"))
    common = (
        rows.select("host", "copy", F.explode(F.array_distinct("lines")).alias("line")).distinct()
        .groupBy("host", "line").agg(F.count("*").alias("held"))
        .where(F.col("held") >= min_docs)
    )
    above = common.join(texts, common["host"].eqNullSafe(texts["host"])).where(F.col("held") * F.col("held") > F.col("docs"))
    # the lines above the limit grow with the input, like its root in a host: a shuffled join, in which a frequent line has many parts
    parts = above.select(common["host"].alias("h"), F.col("line").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part"))
    exploded = rows.select("row", "host", F.explode(F.arrays_zip("lines", "sizes")).alias("l")).select(
        "row", "host", F.col("l.lines").alias("line"), "l.sizes", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int").alias("salt")
    )
    same = F.col("host").eqNullSafe(F.col("h")) & (F.col("line") == F.col("k")) & (F.col("salt") == F.col("part"))
    lost = exploded.join(parts, same).groupBy("row").agg(F.sum("sizes").cast("bigint").alias("common_words"))
    words = F.col("n_words")
    return (
        rows.drop("lines", "sizes", "copy").join(lost, "row", "left")
        .withColumn("common_words", F.coalesce("common_words", F.lit(0).cast("bigint")))
        .withColumn("depleted", (words > 0) & (words - F.col("common_words") < keep * words))
        .withColumn("base_failed", (words < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * words))
        .withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))
        .drop("row")
    )
