import numpy as np
import pytest

from polyloci.llm import decontaminate as D


def prose(rng, chars):
    return " ".join("".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(chars))[:chars]


def edited(rng, text, edits):
    out = list(text)
    for at in sorted(rng.choice(len(out) - 2, edits, replace=False) + 1, reverse=True):
        out[at : at + 1] = [[], ["z"], ["z", out[at]]][rng.integers(0, 3)]
    return "".join(out)


@pytest.mark.parametrize("chars", [600, 1000, 1500, 2500])
def test_items_as_long_as_windows(chars, monkeypatch):
    """An item near or above the window's size is found at every offset, as in one window."""
    rng = np.random.default_rng(chars)
    item, short = prose(rng, chars), prose(rng, 120)
    ix = D.indexes([(7, item), (8, short)], D.EDIT_RATE)
    texts = []
    for offset in (0, 1, 300, 511, 512, 700, 1023, 1024, 1900, 3333):
        before, after = prose(rng, offset + 1)[:offset], prose(rng, 3000)
        texts.append(f"{before} {edited(rng, item, chars // 12)} {after} {short}")
    whole = list(D.find_items(texts, ix))
    assert [(d, i) for d, i, *_ in whole] == [(d, i) for d in range(len(texts)) for i in (7, 8)]
    monkeypatch.setattr(D, "WINDOW", 1024)
    monkeypatch.setattr(D, "CELLS", 4096)
    assert list(D.find_items(texts, ix)) == whole
