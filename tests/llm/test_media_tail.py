"""The last samples of a payload count in its fingerprint, whatever its length."""

import numpy as np
import pytest

from tidemark.llm.media import fingerprint


@pytest.mark.parametrize("size", [192, 256, 320, 384, 448, 1344])
def test_tail_changes_the_fingerprint(size):
    rng = np.random.default_rng(3)
    a = rng.integers(32, 127, size).astype(np.uint8)
    b = a.copy()
    b[-64:] = rng.integers(32, 127, 64)
    x, y = (fingerprint(v.tobytes()) for v in (a, b))
    assert any(not np.array_equal(p, q) for p, q in zip(x, y, strict=True))
