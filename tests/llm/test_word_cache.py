"""The words a task remembers stay few, and forgetting them changes no hash."""

import numpy as np

from ledgerloom.llm import shared


def test_known_words_stay_few():
    text = b" ".join(b"word%d" % i for i in range(50000))
    first = shared.word_hashes(text)
    assert len(shared._words) <= 1 << 15
    assert np.array_equal(first, shared.word_hashes(text)) and len(np.unique(first)) == 50000
