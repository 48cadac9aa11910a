"""Cutting texts where byte-level BPE can never join: the pieces repeat, so each is encoded once per batch.

The pre-splitting pattern of the byte-level tokenizers attaches at most one blank to a following word and cuts a run
of white space before its last character when something else follows. A cut before a blank or line feed whose next
character is not white space is therefore a cut of the pattern itself, whatever stands before it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .arrays import text_bytes

#: Bytes that surely begin a character other than white space. Lead bytes of white space beyond ASCII are left out.
SOLID = np.zeros(256, bool)
SOLID[0x21:0x7F] = SOLID[0xC3:0xE0] = SOLID[0xE4:0xF5] = True


def chunks(column: pa.Array, special: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct pieces, the piece number of each piece in text order, and the n + 1 offsets of the rows.

    A row that contains a special string is one piece, because a special string ends the text before it.
    """
    data, offsets = text_bytes(column)
    cut = np.zeros(len(data) + 1, bool)
    if len(data):
        cut[: len(data) - 1] = ((data[:-1] == 32) | (data[:-1] == 10)) & SOLID[data[1:]]
        ends = offsets[1:][np.diff(offsets) > 0]
        cut[ends - 1] = False  # the next byte is another row's
        for word in special:
            for row in np.flatnonzero(pc.match_substring(column, word).fill_null(False).to_numpy(zero_copy_only=False)):
                cut[offsets[row] : offsets[row + 1]] = False
    cut[offsets] = True
    cut[len(data)] = False
    starts = np.flatnonzero(cut)
    pieces = pa.Array.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(data)).astype(np.int64)), pa.py_buffer(data)]
    ).dictionary_encode()
    return pieces.dictionary.to_pylist(), pieces.indices.to_numpy(), np.searchsorted(starts, offsets)


class Memo(dict):
    """Results by piece, emptied when full; long pieces are not kept."""

    def __init__(self, most: int = 300_000, longest: int = 64):
        super().__init__()
        self.most, self.longest = most, longest

    def keep(self, pieces: list[bytes], results: list) -> None:
        if len(self) + len(pieces) > self.most:
            self.clear()
        self.update((p, r) for p, r in zip(pieces[: self.most], results, strict=False) if len(p) <= self.longest)
