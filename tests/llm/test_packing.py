import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from wearlens.llm import packing
from wearlens.llm.catalog import QUERIES

from . import helpers


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    t.encode_special_tokens = True
    return t


def check(rows, texts):
    """Every id of every text in exactly one piece; gapless sequences of at most 2048; little padding."""
    t = tokenizer()
    ids = [np.array([*x.ids, 1], "<u4") for x in t.encode_batch([x or "" for _, x in texts], add_special_tokens=False)]
    wanted = defaultdict(list)
    for (doc, _), i in zip(texts, ids, strict=True):
        wanted[doc].append(i)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(wanted)
    for doc, own in pieces.items():
        if len(wanted[doc]) > 1:
            assert sum(r.length for r in own) == sum(map(len, wanted[doc]))
            continue
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(wanted[doc][0])) and zlib.crc32(wanted[doc][0][at : at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(wanted[doc][0])
    padding = total = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= packing.WINDOW
        total += packing.WINDOW
        padding += packing.WINDOW - at
    return padding / total


def test_odd_texts(spark):
    rows = [(1, None), (2, ""), (3, " "), (4, "a"), (5, "a  b\n c   d\te"), (6, "<|endoftext|> it's 12,5 <|endoftext|>"), (7, "x" * 30000), (8, "word " * 9000), (9, "é ü　ñ"), (9, "again"), (None, "none")]
    docs = helpers.texts(spark, rows).withColumn("key", F.lit("x")).withColumn("blocks", F.lit(1))
    check(packing.sequences(docs).collect(), rows)
    assert packing.sequences(helpers.texts(spark, [])).count() == 0


def test_pieces_of_words_encode_as_the_text():
    import random

    r, t, e = random.Random(9), tokenizer(), packing.Encoder(packing.TOKENIZER)
    texts = ["".join(r.choice("ab '\n\t.,é1 s  !") for _ in range(r.randint(0, 60))) for _ in range(400)]
    ids, bounds = e.encode(texts)
    for i, x in enumerate(t.encode_batch(texts, add_special_tokens=False)):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == [*x.ids, 1]


def test_neighbours_come_first():
    a, b = np.array([1, 2, 3], np.uint32), np.array([7, 8, 9], np.uint32)
    ones = np.ones(3, np.uint32)
    found = packing.packed_shard([600, 600, 600, 600], packing.Index([a, b, a, b], [ones] * 4))
    assert [p[0] for p in found[0]][:2] == [0, 2]


def test_query(spark):
    texts = [tuple(x) for x in spark.read.parquet(f"{helpers.SF}/documents.parquet").select("doc_id", "text").collect()]
    assert check(QUERIES["op3_packing"](spark, helpers.SF).collect(), texts) < 0.02


def test_encoder_keeps_words_met_again(monkeypatch):
    """Also when it forgets: frequent words are encoded once, and ids stay those of the whole text."""
    monkeypatch.setattr(packing, "CACHE", 40)
    t, e = tokenizer(), packing.Encoder(packing.TOKENIZER)
    asked, ids_of = [], e._ids
    monkeypatch.setattr(e, "_ids", lambda text: (asked.append(text), ids_of(text))[1])
    for n in range(30):
        texts = ["the often met " + " ".join(f"rare{n}x{i}" for i in range(9)) + " often\n", "", "often  the é\tmet"]
        ids, bounds = e.encode(texts)
        for i, x in enumerate(t.encode_batch(texts, add_special_tokens=False)):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == [*x.ids, 1]
        assert len(e.known) <= packing.CACHE + 20
    assert sum("often met" in text for text in asked) == 1


def test_best_first_keeps_the_order_of_equal_scores():
    r = np.random.default_rng(4)
    for n in (0, 1, 5, 32, 33, 200):
        scores = r.integers(0, 9, n).astype(float)
        assert list(packing.best_first(scores, 32)) == np.argsort(-scores, kind="stable").tolist()


def test_parts_begin_at_single_spaces_and_at_punctuation_behind_letters():
    import random
    import re

    r = random.Random(5)
    texts = ["".join(r.choice(["a", "é", "1", ".", "'", "\n", "\t", "\x1c", "\x85", "\xa0", "\u2003", "\u3000", "\u0905", "\U0001f600", "か", *"     "]) for _ in range(r.randint(0, 30))) for _ in range(800)]
    raw = [t.encode() for t in texts]
    buf, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    for marks, cut in ((False, r"(?<=\S)(?= \S)"), (True, r"(?<=\S)(?= \S)|(?<=[a-z])(?=[.'])")):
        starts = packing.piece_starts(buf, offsets, marks).tolist()
        found = [b.decode() for b in np.split(buf, starts[1:]) for b in [b.tobytes()]]
        assert found == [p for t in texts if t for p in re.split(cut, t)]


def test_words_are_known_with_and_without_punctuation(monkeypatch):
    t, e = tokenizer(), packing.Encoder(packing.TOKENIZER)
    asked, ids_of = [], e._ids
    monkeypatch.setattr(e, "_ids", lambda text: (asked.append(text), ids_of(text))[1])
    texts = ["x uncommonword stands", "x uncommonword, stands! (uncommonword)", "(uncommonword's x.y_z it's'll\u00e9.é's .uncommonword a.!\n", ".uncommonword", "'s", "a'", "!!\n"]
    for text in texts:
        ids, _ = e.encode([text])
        assert ids.tolist() == [*t.encode(text, add_special_tokens=False).ids, 1]
    assert sum("uncommonword stands" in x or "uncommonword," in x for x in asked) == 1


def test_checksums_of_pieces_from_blocks():
    r = np.random.default_rng(6)
    ids = r.integers(0, 50_000, 5000).astype("<u4")
    blocks = np.array([zlib.crc32(ids[i : i + packing.BLOCK].tobytes()) for i in range(0, len(ids), packing.BLOCK)], np.uint32)
    tokens = np.array([32, 64, 2048, 96, 32, 4992, 5000, 8, 40])
    first = np.array([3, 0, 7, 5, 0, 0, 0, len(blocks) - 1, len(blocks) - 2])
    wanted = [zlib.crc32(ids[32 * a : 32 * a + n].tobytes()) for a, n in zip(first.tolist(), tokens.tolist(), strict=True)]
    assert packing.joined_checksums(blocks, first, tokens).tolist() == wanted
    assert packing.joined_checksums(blocks, first[:0], tokens[:0]).tolist() == []


def test_encoders_go_when_texts_are_tokenized():
    """The step behind tokenizing lets go of what the worker process has kept for it."""
    first = packing.encoder_of(packing.TOKENIZER)
    assert packing.encoder_of(packing.TOKENIZER) is first
    list(packing._pack(iter(())))
    assert packing.encoder_of(packing.TOKENIZER) is not first
    packing.forget_encoders()
