import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmark.llm import recompress

words = st.lists(st.sampled_from("abc"), min_size=0, max_size=60) | st.lists(st.integers(0, 400), max_size=60)


@settings(max_examples=150, deadline=None)
@given(words, st.lists(st.sampled_from("abc"), min_size=3, max_size=30), words, words, words, st.integers(2, 12), st.integers(1, 5))
def test_equal_windows_have_equal_anchors_at_equal_places(before, shared, after, before_too, after_too, width, times):
    """Whatever stands around a window, and in whichever text, its anchor is the same one."""
    texts = [[*map(str, x)] for x in ([*before, *shared * times, *after], [*before_too, *shared * times, *after_too])]
    tokens, _, sizes = recompress.word_tokens([" ".join(t).encode() for t in texts])
    assert sizes.tolist() == [len(t) for t in texts]
    part = np.repeat([0, 1], sizes)
    starts = np.array([i + o for o, t in zip((0, len(texts[0])), texts) for i in range(len(t) - width + 1)], int)
    if not len(starts):
        return
    name, at = recompress.anchors(tokens, part, starts, width)
    assert ((at >= starts) & (at < starts + width)).all()
    flat = [w for t in texts for w in t]
    seen = {}
    for s, n, a in zip(starts.tolist(), name.tolist(), at.tolist()):
        window = tuple(flat[s : s + width])
        assert seen.setdefault(window, (n, a - s)) == (n, a - s)
    assert len(set(seen.values())) > 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.sampled_from("aé \t\n\x0b\x0c\r\x1c 🙂"), max_size=30), max_size=6), st.integers(1, 40))
def test_words_are_those_of_split(texts, held):
    """Equal words, and only those, have equal tokens; texts longer than what is held are cut between words."""
    raw = [t.encode() for t in texts]
    before, recompress.BYTES_HELD = recompress.BYTES_HELD, held
    try:
        tokens, others, sizes = recompress.word_tokens(raw)
    finally:
        recompress.BYTES_HELD = before
    split = [t.split() for t in raw]
    assert sizes.tolist() == [len(s) for s in split]
    of = {}
    for w, t in zip((w for s in split for w in s), zip(tokens.tolist(), others.tolist(), strict=True), strict=True):
        assert of.setdefault(w, t) == t
    assert all(len({t[k] for t in of.values()}) == len(of) for k in (0, 1))


def test_spans():
    tokens = recompress.mix(np.arange(50, dtype=np.uint64) % np.uint64(7))
    starts = np.arange(40)
    for h in (recompress.Sums(tokens), recompress.PrimeSums(tokens)):
        got = h(starts, starts + 10)
        for i in range(40):
            for j in range(40):
                assert (got[i] == got[j]) == (i % 7 == j % 7)
