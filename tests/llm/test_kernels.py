import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scoreloom.llm import kernels as K

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB9 \n\té日\x00😀", max_size=30)), min_size=1, max_size=8)


def blocks(texts, most):
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["i", "t"])
    for part, data, offsets in K.slices(batch, 1, most):
        yield part.column(0).to_pylist(), data, offsets


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(1, 60))
def test_words_lines_and_hashes(texts, most):
    seen, hashes = [], {}
    for ids, data, offsets in blocks(texts, most):
        starts, ends, first = K.spans(data, offsets, K.NOT_SPACE)
        words = K.hashes(data, starts, ends)
        a, b, line = K.lines(data, offsets)
        points = K.code_points(data)
        for k, i in enumerate(ids):
            seen.append(i)
            text = texts[i] or ""
            want = re.findall("[^\x20\x09-\x0d]+", text)
            own = slice(first[k], first[k + 1])
            assert [bytes(data[x:y]).decode() for x, y in zip(starts[own], ends[own])] == want
            assert [int(points[y] - points[x]) for x, y in zip(starts[own], ends[own])] == list(map(len, want))
            for w, h in zip(want, words[own].tolist()):
                assert hashes.setdefault(w, h) == h
            own = slice(line[k], line[k + 1])
            assert [bytes(data[x:y]).decode() for x, y in zip(a[own], b[own])] == text.split("\n")
    assert seen == list(range(len(texts)))
    assert len(set(hashes.values())) == len(hashes)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=12), min_size=1, max_size=5), st.integers(1, 4))
def test_ngrams(texts, n):
    flat = np.array([x for t in texts for x in t], K.U)
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    grams, inside = K.ngrams(K.mix(flat + K.U(1)), n), K.whole(first, n)
    got = [(int(g), tuple(flat[k : k + n].tolist())) for k, (g, ok) in enumerate(zip(grams, inside)) if ok]
    assert [w for _, w in got] == [tuple(t[k : k + n]) for t in texts for k in range(len(t) - n + 1)]
    assert len({g for g, _ in got}) == len({w for _, w in got})


def thue_morse(n):
    return "".join("ab"[k.bit_count() % 2] for k in range(n))


@pytest.mark.parametrize("n", [1024, 2048, 4096, 200_000])
def test_no_collision_of_thue_morse_words(n):
    a = thue_morse(n)
    b = a.translate({97: "b", 98: "a"})
    data = np.frombuffer((a + " " + b + " " + a).encode(), np.uint8)
    starts, ends, _ = K.spans(data, np.array([0, len(data)]), K.NOT_SPACE)
    x, y, z = K.hashes(data, starts, ends).tolist()
    assert x == z != y


def test_hashes_do_not_depend_on_what_stands_beside():
    def of(text):
        data = np.frombuffer(text.encode(), np.uint8)
        starts, ends, _ = K.spans(data, np.array([0, len(data)]), K.NOT_SPACE)
        return K.hashes(data, starts, ends).tolist()

    long, longer = "x" * 65_537, "y" * 3_000_000
    alone = {w: of(w)[0] for w in ("a", "bc", long, longer, "x" * 65_536)}
    for words in (["a", long, "bc"], [longer, "a", long], ["bc", "x" * 65_536, "a", longer]):
        assert of(" ".join(words)) == [alone[w] for w in words]
    assert len(set(alone.values())) == len(alone)
