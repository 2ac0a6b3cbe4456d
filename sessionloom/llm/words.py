"""Words of whole batches of texts, told apart once per batch."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def row_slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with about ``most`` bytes of text, one row at least, copied.

    Some Arrow kernels read a slice's texts at wrong places once they are cast.
    """
    lengths = pc.fill_null(pc.binary_length(batch.column(column).cast(pa.large_string())), 0).to_numpy(zero_copy_only=False)
    sums, at = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64))), 0
    while at < len(batch):
        upto = max(int(np.searchsorted(sums, sums[at] + most, side="right")) - 1, at + 1)
        yield batch.take(pa.array(np.arange(at, upto)))
        at = upto


class BatchWords:
    """Words between ASCII white space of a column of texts (nulls: none).

    ``known`` holds the distinct words, ``codes`` the number of each word in order, and text
    i has the words from ``starts[i]`` to before ``starts[i + 1]``.
    """

    def __init__(self, texts: pa.Array | pa.ChunkedArray):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        parts = pc.ascii_split_whitespace(texts)
        offsets, flat = parts.offsets.to_numpy(), parts.flatten()
        real = pc.not_equal(pc.binary_length(flat), 0)  # a text that begins or ends with white space has empty parts
        real_before = np.concatenate(([0], np.cumsum(real.to_numpy(zero_copy_only=False)))) if len(flat) else np.zeros(1, np.int64)
        if len(flat) and not pc.all(real).as_py():
            flat = flat.filter(real)
        self.starts = real_before[offsets - offsets[0]].astype(np.int64)
        table = flat.dictionary_encode()
        self.codes, self.known = table.indices.to_numpy(zero_copy_only=False), table.dictionary

    def joined(self, keep: np.ndarray) -> pa.Array:
        """Each text's words where ``keep`` is true, joined by one space."""
        before = np.concatenate(([0], np.cumsum(keep)))
        words = self.known.take(pa.array(self.codes[keep]))
        lists = pa.ListArray.from_arrays(pa.array(before[self.starts], pa.int32()), words)
        return pc.binary_join(lists, pa.scalar(" ", words.type))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values, by doubling."""
    if len(values) < width:
        return values[:0]
    have, least = 1, values
    while 2 * have <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[: len(values) - width + 1], least[width - have :])
    return least
