import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from wearlens.llm import textscan
from wearlens.llm.textscan import ALNUM, SPACED, Words, text_chunks

from . import helpers

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbZ é\n\t .,0'\x00  ", max_size=30)), max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_and_hashes_agree_with_the_patterns(values):
    for mapping, find in ((SPACED, helpers.spaced), (ALNUM, helpers.alnum)):
        seen = {}
        for chunk in text_chunks(pa.array(values, pa.string()), 16):
            words = Words(chunk, mapping)
            hashes = words.hashes()
            for d in range(chunk.docs):
                expected = [w.encode() for w in find(values[chunk.first + d])]
                found = range(words.first[d], words.first[d + 1])
                assert [words.span(i, 1) for i in found] == expected
                for i, w in zip(found, expected, strict=True):
                    assert seen.setdefault(w, hashes[i]) == hashes[i]
        assert len(set(seen.values())) == len(seen)


def test_hashes_do_not_depend_on_segments(monkeypatch):
    text = " ".join(f"word{i % 97}" for i in range(500))
    chunk = next(text_chunks(pa.array([text])))
    whole = Words(chunk).hashes()
    monkeypatch.setattr(textscan, "SEGMENT", 40)
    assert np.array_equal(Words(chunk).hashes(), whole)


def test_no_rows_and_slices():
    assert list(text_chunks(pa.array([], pa.string()))) == []
    parts = [c.text(d) for c in text_chunks(pa.array(["a", None, "b", "c"])[1:]) for d in range(c.docs)]
    assert parts == [b"", b"b", b"c"]
