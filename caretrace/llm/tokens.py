"""Words of many texts at once: byte classes cut one buffer into words and gaps, Arrow numbers the distinct words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; one longer text is a chunk of its own.
CHUNK_BYTES = 8 << 20


def byte_class(gap: bytes) -> np.ndarray:
    """256 flags: true for the bytes that stand between words."""
    out = np.zeros(256, bool)
    out[np.frombuffer(gap, np.uint8)] = True
    return out


#: The six ASCII white-space characters.
BLANK = byte_class(b" \t\n\x0b\x0c\r")


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def chunks(batches: Iterator[pa.RecordBatch], text_at: int, size: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with about ``size`` bytes of text each, and their texts."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = text_bytes(batch.column(text_at))
        start, held = 0, 0
        for k, t in enumerate(texts):
            if held and held + len(t) > size:
                yield batch.slice(start, k - start), texts[start:k]
                start, held = k, 0
            held += len(t)
        yield batch.slice(start), texts[start:]


def words_and_gaps(data: bytes, gaps: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, pa.Array, np.ndarray]:
    """Every word of ``data`` by number.

    ``data`` starts and ends with a gap byte. Returns the words' numbers, the distinct words, the numbers of the gaps (gap
    i stands before word i, one more at the end), the distinct gaps and the words' start offsets.
    """
    flags = gaps[np.frombuffer(data, np.uint8)]
    cuts = np.flatnonzero(flags[1:] != flags[:-1])
    wide = len(data) > 2**31 - 2
    offsets = np.empty(len(cuts) + 2, np.int64 if wide else np.int32)
    offsets[0], offsets[1:-1], offsets[-1] = 0, cuts + 1, len(data)
    del flags, cuts
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(data)]
    parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, buffers) if wide else pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, buffers)
    numbered = parts.dictionary_encode()
    codes = numbered.indices.to_numpy(zero_copy_only=False)
    distinct = numbered.dictionary
    is_gap = np.zeros(len(distinct), bool)
    is_gap[codes[0::2]] = True
    gap_number = np.cumsum(is_gap, dtype=np.int32) - 1
    word_number = np.cumsum(~is_gap, dtype=np.int32) - 1
    return word_number[codes[1::2]], distinct.filter(pa.array(~is_gap)), gap_number[codes[0::2]], distinct.filter(pa.array(is_gap)), offsets[1:-1:2]
