import numpy as np
import pyarrow as pa

from tidemark.llm import _crf, pii


def test_two_word_phone_at_every_offset():
    field = pii.train()
    words = "the letter of the man who was in the house and had seen it".split()
    for phone in ("(415) 555-0123", "415 555 0123"):
        texts, begins = [], []
        for k in range(55, 140):
            head = " ".join(words[i % len(words)] for i in range(k)) + " "
            texts.append(head + phone + " " + " ".join(words))
            begins.append(len(head))
        found = pii.spans(pa.array(texts), field)
        one = pii.spans(pa.array([" ".join(words) + " " + phone + " " + " ".join(words)]), field)[0]
        at = len(" ".join(words)) + 1
        shape = [(k, a - at, b - at) for k, a, b, _ in one]
        assert shape and [[(k, a - at, b - at) for k, a, b, _ in x] for x, at in zip(found, begins)] == [shape] * len(texts)


def test_cut_at_sure_positions_is_exact():
    rng = np.random.Generator(np.random.PCG64(7))
    for _ in range(50):
        size = rng.integers(1, 40, 12)
        first = np.cumsum(size) - size
        emit = rng.normal(0, 2, (int(size.sum()), 4))
        emit[rng.random(len(emit)) < 0.4, 0] += 12
        step, begin = rng.normal(0, 1.5, (4, 4)), rng.normal(0, 1, 4)
        assert (_crf.viterbi_apart(emit, first, size, step, begin) == _crf.viterbi(emit, first, size, step, begin)).all()
