"""Token files: ids in fewer bits than their order-0 entropy, and odd shares."""

import io

import numpy as np
import pytest

from tomelake.llm import range_coder, token_files


def stream(n: int) -> np.ndarray:
    """Ids of a skewed distribution, of which phrases come again."""
    rng = np.random.default_rng(3)
    phrases = [np.minimum(rng.zipf(1.3, 8), 40_000) for _ in range(60)]
    return np.concatenate([phrases[k] if k < 60 else np.minimum(rng.zipf(1.3, 8), 40_000) for k in rng.integers(0, 120, n // 8)]).astype("<u4")


def test_files_are_smaller_than_the_order_0_entropy():
    ids, out = stream(200_000), io.BytesIO()
    writer = token_files.FileWriter(out)
    for i, part in enumerate(np.array_split(ids, 100)):
        writer.add(i, part.tobytes())
    writer.finish()
    share = np.unique(ids, return_counts=True)[1] / len(ids)
    assert 8 * len(out.getvalue()) < -(share * np.log2(share)).sum() * len(ids)
    assert b"".join(b for _, b in token_files.read_documents(io.BytesIO(out.getvalue()))) == ids.tobytes()


@pytest.mark.parametrize("ids", [np.zeros(5000, int), np.arange(1 << 16), np.array([65535]), np.repeat([7, 65535, 7], [3000, 1, 3000])])
def test_odd_shares(ids):
    table = range_coder.shares(ids)
    assert table[1].sum() == range_coder.SHARES and table[1].min() >= 1
    blocks = [ids, ids[: len(ids) // 2], ids[:0]]
    for a, b in zip(blocks, range_coder.decode_blocks(range_coder.encode_blocks(blocks, table), [len(x) for x in blocks], table), strict=True):
        assert (a == b).all()


def test_larger_ids_are_refused():
    writer = token_files.FileWriter(io.BytesIO())
    writer.add(1, np.array([5, 1 << 16], "<u4").tobytes())
    with pytest.raises(ValueError, match="below 65536"):
        writer.finish()
