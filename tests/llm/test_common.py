"""Packing of numbers is lossless."""

import numpy as np
import pytest

from atril.llm.common import pack_ints, unpack_ints


@pytest.mark.parametrize("top", [1, 2, 3, 255, 256, 65_536, 2**31, 2**32 - 1, 2**32, 2**52, 2**62])
def test_packing(top):
    rng = np.random.default_rng(top % 97)
    for n in (0, 1, 7, 64, 5000):
        x = rng.integers(0, top, n) if n < 64 else (top ** rng.random(n)).astype(np.int64) - 1
        assert np.array_equal(unpack_ints(pack_ints(x)), x) and unpack_ints(pack_ints(x)).dtype == np.int64
