"""Memory of Python workers between tasks."""

import numpy as np
import pyarrow as pa

from gravitas.llm import text as tx


def hashes(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    return tx.span_hashes(raw, np.array([0, 5]), np.array([5, len(raw)]))


def test_tables_of_a_very_long_text_do_not_stay():
    short, long = b"hello world", b"hello" + b"x" * (3 * tx.PIECE_BYTES)
    before = hashes(short)
    hashes(long)
    assert len(tx._powers[0]) > tx.PIECE_BYTES + 1
    batch = pa.RecordBatch.from_pydict({"text": ["a", None, "", "b" * 10]})
    assert sum(p.num_rows for p in tx.pieces(batch, "text")) == 4
    assert not tx._powers
    assert (hashes(short) == before).all()
    tx.release()
    assert len(tx._powers[0]) == tx.PIECE_BYTES + 1
