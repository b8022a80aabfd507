import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from taskloom.llm.substrings import MARGIN, anchors
from taskloom.llm.words import split, windows

from .conftest import words

TEXT = st.text(alphabet="ab \t\n\r\x0bZé\U0001f600", max_size=40)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=6))
def test_words_and_hashes(texts):
    w = split(pa.array(texts, pa.string()), lower=True)
    expected = [words(t, lower=True) for t in texts]
    raw = w.data.tobytes()
    got = [[raw[w.start[i]:w.end[i]].decode() for i in range(a, b)] for a, b in zip(w.first[:-1], w.first[1:])]
    assert got == expected
    by_word = {}
    for h, word in zip(w.hash.tolist(), (x for ws in expected for x in ws)):
        assert by_word.setdefault(word, h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(1)
    passage = rng.integers(0, 2**63, 40).astype(np.uint64)
    size, found = 20, []
    for _ in range(20):
        around = [rng.integers(0, 2**63, rng.integers(0, 30)).astype(np.uint64) for _ in range(2)]
        h = np.concatenate([around[0], passage, around[1]])
        place = anchors(h, size)[len(around[0]):len(around[0]) + 21] - len(around[0])
        found.append(place.tolist())
        assert ((place >= np.arange(21) + MARGIN) & (place < np.arange(21) + size - MARGIN)).all()
    assert all(f == found[0] for f in found)
    run = anchors(np.full(60, 7, np.uint64), size)
    assert len(set(np.diff(run))) == 1 and len(set(windows(np.full(60, 7, np.uint64), 7))) == 1
