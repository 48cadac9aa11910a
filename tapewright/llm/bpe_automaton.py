"""BPE by an automaton over tokens: merges compiled one gadget after the other, words encoded by its transitions.

The automaton accepts a token sequence exactly when BPE gives that sequence for the bytes it spells. It starts with
one state and an arc for every byte. The merge (u, v) -> w is a gadget that

* adds an arc w wherever there is an arc u, to a copy of the state that v leads to,
* removes the arc v from the state that u leads to.

All arcs with one label lead to one state, so a state is named by the token before it, and a gadget is three entries
of a table: the state of w is a copy of the state of ``right[w]``; the arc w enters where ``left[w]`` entered; the
arc (u, v) ends at that step. Spelled out, the arcs would be a table of tokens by tokens; ``arc`` reads one of them
from the gadgets, and what it has read is kept in the transition table.

Every string of bytes has one accepted path, so a word is encoded by following arcs from its start, longest label
first, and going back where no arc goes on. Decoding emits the labels of the arcs.

Texts are cut at places where the pre-splitting pattern always cuts, equal pieces of a batch are encoded once, and
the results are put together with array operations. Rows are independent: no shuffle, no state beyond a bounded
memo, and a lost executor repeats its tasks.

Defined cases: null or empty text has no tokens. Special strings become their own token, as the tokenizer's default
has it. Bytes that are not valid UTF-8 are read as U+FFFD. Repeated rows stay.
"""

from __future__ import annotations

import functools
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import pieces, ranges
from .chunks import Memo, chunks

#: Contractions, then a word, number or other run with at most one blank before it, then white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, then from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class MergeAutomaton:
    """Compiled merges of a byte-level tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        letters, vocab = byte_letters(), data["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in data["added_tokens"]}
        spelled = {token: bytes(letters[c] for c in token) for token in vocab if token not in self.special}
        self.ids = {label: vocab[token] for token, label in spelled.items()}
        n = 1 + max([*vocab.values(), *self.special.values()])
        self.labels = [b""] * n
        for label, i in self.ids.items():
            self.labels[i] = label
        for content, i in self.special.items():
            self.labels[i] = content.encode()
        self.born = [-1] * n  # the step of the gadget that made the token; bytes were there before
        self.left, self.right = list(range(n)), list(range(n))
        self.ends: dict[tuple[int, int], int] = {}  # the step at which the arc v leaves the state of u
        for step, pair in enumerate(data["model"]["merges"]):
            u, v = pair if isinstance(pair, list) else pair.split(" ")
            self._gadget(step, vocab[u], vocab[v], vocab[u + v])
        # only labels that a gadget or the alphabet made are arcs
        self.ids = {label: i for label, i in self.ids.items() if self.born[i] >= 0 or len(label) == 1}
        self.reach: dict[bytes, int] = {}  # longest label by its first three bytes
        for label in self.ids:
            if len(label) > 2:
                self.reach[label[:3]] = max(self.reach.get(label[:3], 0), len(label))
        self.table: dict[int, bool] = {}
        self.words = regex.compile(PATTERN)
        self.found_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        ends = np.cumsum([0, *map(len, self.labels)])
        self.label_starts, self.label_sizes = ends[:-1], np.diff(ends)
        self.label_bytes = np.frombuffer(b"".join(self.labels), np.uint8)

    def _gadget(self, step: int, u: int, v: int, w: int) -> None:
        if self.born[w] >= 0 or (u, v) in self.ends:
            raise ValueError("two merges make the same token")
        self.born[w], self.left[w], self.right[w], self.ends[u, v] = step, u, v, step

    def arc(self, state: int, token: int) -> bool:
        """Whether ``token`` may follow ``state``: follows both back through the gadgets that made them."""
        key = state << 32 | token
        known = self.table.get(key)
        if known is None:
            if len(self.table) > 300_000:
                self.table.clear()
            known = self.table[key] = self._arc(state, token)
        return known

    def _arc(self, state: int, token: int) -> bool:
        now = 1 << 60  # arcs that ended before this step are gone
        while True:
            if self.ends.get((state, token), now) < now:
                return False
            a, b = self.born[state], self.born[token]
            if a > b:  # the state was copied when the arc was already there or not
                state, now = self.right[state], a
            elif b >= 0:  # the arc was added where its left part entered, after that step's removal
                token, now = self.left[token], b + 1
            else:
                return True

    def encode_word(self, word: bytes) -> list[int]:
        """The accepted path: longest tokens first, and back where no arc goes on.

        A place that was once left for good is never entered again, because the path to it is always the same.
        """
        ids, reach, table, n = self.ids, self.reach, self.table, len(word)
        path: list[int] = []
        at, dead = 0, set()
        size = min(reach.get(word[:3], 2), n)
        while at < n:
            while size:
                token = ids.get(word[at : at + size])
                if token is not None and at + size not in dead:
                    if not path:
                        break
                    known = table.get(path[-1] << 32 | token)
                    if self.arc(path[-1], token) if known is None else known:
                        break
                size -= 1
            if size:
                path.append(token)
                at += size
                size = min(reach.get(word[at : at + 3], 2), n - at)
            elif path:
                dead.add(at)
                last = len(self.labels[path.pop()])
                at -= last
                size = last - 1
            else:
                raise ValueError("the vocabulary lacks a byte")
        return path

    def encode_text(self, text: str, memo: dict[bytes, bytes]) -> bytes:
        """32-bit ids of any text. ``memo`` may know some of its words."""
        parts = self.found_special.split(text) if self.special and self.found_special.search(text) else [text]
        out = []
        for part in parts:
            if part in self.special:
                out.append(array("i", [self.special[part]]).tobytes())
            else:
                for word in map(str.encode, self.words.findall(part)):
                    out.append(memo.get(word) or array("i", self.encode_word(word)).tobytes())
        return b"".join(out)

    def encode_piece(self, piece: bytes, memo: dict[bytes, bytes]) -> bytes:
        """32-bit ids of a piece; a blank and letters are one word, anything else is split."""
        text = piece.decode("utf-8", "replace")
        if (text[1:] if text[0] == " " else text).isalpha():
            return array("i", self.encode_word(piece)).tobytes()
        return self.encode_text(text, memo)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of all labels one after the other."""
        return self.label_bytes[ranges(self.label_starts[ids], self.label_sizes[ids])]


@functools.lru_cache(maxsize=2)
def automaton(path: str) -> tuple[MergeAutomaton, Memo]:
    return MergeAutomaton(path), Memo(200_000)


def encode_batch(texts: pa.Array, path: str) -> pa.Array:
    machine, memo = automaton(path)
    distinct, index, rows = chunks(texts, list(machine.special))
    new = [x for x in distinct if x not in memo]
    results = [machine.encode_piece(x, memo) for x in new]
    if len(new) == len(distinct):
        found = results
    else:
        fresh = dict(zip(new, results, strict=True))
        found = [fresh[x] if x in fresh else memo[x] for x in distinct]
    memo.keep(new, results)
    sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
    starts = np.cumsum(sizes) - sizes
    flat = np.frombuffer(b"".join(found), np.int32)
    ids = flat[ranges(starts[index], sizes[index])] if len(index) else flat[:0]
    ends = np.concatenate([[0], np.cumsum(sizes[index])]) if len(index) else np.zeros(1, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends[rows].astype(np.int32)), pa.array(ids))


def decode_batch(ids: pa.Array, path: str) -> pa.Array:
    machine, _ = automaton(path)
    ids = ids.fill_null([]) if ids.null_count else ids
    flat, offsets = ids.flatten().to_numpy(zero_copy_only=False), ids.offsets.to_numpy() - ids.offsets[0].as_py()
    data = machine.decode(flat).tobytes()
    ends = np.concatenate([[0], np.cumsum(machine.label_sizes[flat])])[offsets]
    return pa.array([data[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.large_string())


def encode_documents(docs: DataFrame, path: str, id_name: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids): the token ids of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 2_000_000):
            yield pa.record_batch([batch.column(0), encode_batch(batch.column(1), path)], ["doc_id", "ids"])

    given = docs.select(F.col(id_name).alias("doc_id"), F.col(text).alias("text"))
    return given.mapInArrow(run, f"doc_id {given.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded): the text that the arc labels of the ids spell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                decoded = decode_batch(part.column(1), path)
                yield pa.record_batch([part.column(0), part.column(1), decoded.cast(pa.string())], ["doc_id", "ids", "decoded"])

    given = encoded.select("doc_id", "ids")
    return given.mapInArrow(run, f"doc_id {given.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")


def code_documents(docs: DataFrame, path: str, id_name: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): both steps in one Python worker, which holds one automaton instead of two workers with one each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 1_000_000):
            ids = encode_batch(batch.column(1), path)
            yield pa.record_batch([batch.column(0), ids, decode_batch(ids, path).cast(pa.string())], ["doc_id", "ids", "decoded"])

    given = docs.select(F.col(id_name).alias("doc_id"), F.col(text).alias("text"))
    return given.mapInArrow(run, f"doc_id {given.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")
