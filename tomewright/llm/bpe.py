"""Byte-level BPE by a tree of joins.

The encodings of byte strings form a monoid: two of them join by encoding anew a
window around the seam. A sequence of tokens is the encoding of its bytes just
when each two neighbours are the encoding of their own bytes. So once the pairs
at both edges of the window pass that test, all tokens outside it are final; as
long as a pair fails, the window grows on that side.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tomewright.llm.common import id_and_text

#: Fixed value: the pattern whose matches the short cut of ``Codec.encode`` foresees.
BY_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Lines of base64 token and rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


class Codec:
    """Encode and decode by ranks. Memos hold at most ``memo`` entries each; of a
    full one the later half goes (frequent words come early), so memory stays
    bounded whatever the words are. Strings of at most LEAF bytes are merged
    directly, longer ones by halves; RUN ids are decoded at once."""

    LEAF, RUN = 3, 256

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo: int = 800_000):
        self.ranks, self.memo = ranks, memo
        self.words, self.by_words = regex.compile(pattern), pattern == BY_WORDS
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.short: dict[bytes, tuple[int, ...]] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.words_of: dict[str, bytes] = {}

    def _room(self, memo: dict) -> dict:
        if len(memo) >= self.memo:
            for key in list(islice(reversed(memo), self.memo // 2)):
                del memo[key]
        return memo

    def flat(self, s: bytes) -> tuple[int, ...]:
        """Merge the pair of lowest rank, leftmost first, until none is left."""
        ranks, parts = self.ranks, [s[i : i + 1] for i in range(len(s))]
        joins = [ranks.get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
        while True:
            best = min((r for r in joins if r is not None), default=None)
            if best is None:
                return tuple(ranks[p] for p in parts)
            i = joins.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del joins[i]
            if i < len(joins):
                joins[i] = ranks.get(parts[i] + parts[i + 1])
            if i:
                joins[i - 1] = ranks.get(parts[i - 1] + parts[i])

    def window(self, s: bytes) -> tuple[int, ...]:
        out = self.short.get(s)
        if out is None:
            out = self.flat(s)
            if len(s) <= 8:
                self._room(self.short)[s] = out
        return out

    def neighbours(self, a: int, b: int) -> bool:
        """Whether the tokens a, b are the encoding of their bytes."""
        out = self.fits.get((a, b))
        if out is None:
            out = self.flat(self.bytes_of[a] + self.bytes_of[b]) == (a, b)
            self._room(self.fits)[a, b] = out
        return out

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        if not left or not right:
            return left or right
        i, j, wider = len(left) - 1, 1, 1
        while True:
            middle = self.window(b"".join(map(self.bytes_of.__getitem__, left[i:] + right[:j])))
            at_left = i == 0 or self.neighbours(left[i - 1], middle[0])
            at_right = j == len(right) or self.neighbours(middle[-1], right[j])
            if at_left and at_right:
                return left[:i] + middle + right[j:]
            i, j = (i if at_left else max(0, i - wider)), (j if at_right else min(len(right), j + wider))
            wider *= 2

    def tree(self, s: bytes) -> tuple[int, ...]:
        out = self.short.get(s)
        if out is None:
            if len(s) <= self.LEAF:
                return self.window(s)
            half = len(s) // 2
            out = self.join(self.tree(s[:half]), self.tree(s[half:]))
            if len(s) <= 8:
                self._room(self.short)[s] = out
        return out

    def piece(self, s: bytes) -> tuple[int, ...]:
        """One match of the pattern; a whole token stays one, however it arose."""
        rank = self.ranks.get(s)
        return self.tree(s) if rank is None else (rank,)

    def matched(self, text: str) -> bytes:
        ids = array("I")
        for m in self.words.finditer(text):
            ids.extend(self.piece(m[0].encode()))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers.

        A match of BY_WORDS never runs over a lone space or newline between two
        other characters: the space opens the next match, the newline is one by
        itself. So words are looked up one by one. Texts with other white space,
        or more of it in a row, are matched as a whole, and so are all texts
        under any other pattern.
        """
        if not self.by_words:
            return self.matched(text)
        words = text.split()
        if len(words) < 2 or len(words) - 1 != text.count(" ") + text.count("\n") or len("".join(words)) + len(words) - 1 != len(text):
            return self.matched(text)
        first, *rest = text.replace("\n", " \n").split(" ") if "\n" in text else words
        out = list(map(self.words_of.get, rest))
        if None in out:
            for i, ids in enumerate(out):
                if ids is None:
                    out[i] = self._learn(rest[i])
        return self.matched(first) + b"".join(out)

    def _learn(self, word: str) -> bytes:
        ids = self.words_of.get(word)
        if ids is None:
            ids = self.matched(word if word[0] == "\n" else f" {word}")
            if len(word) <= 40:
                self._room(self.words_of)[word] = ids
        return ids

    def decode(self, ids: bytes) -> bytes:
        """Each id's bytes, concatenated up the tree: the monoid's other direction.
        Leaves are runs of RUN ids; neighbours are joined until one is left."""
        tokens = list(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        level = [b"".join(tokens[k : k + self.RUN]) for k in range(0, len(tokens), self.RUN)]
        while len(level) > 1:
            level = [b"".join(level[k : k + 2]) for k in range(0, len(level), 2)]
        return level[0] if level else b""


_codecs: dict[tuple, Codec] = {}


def codec(raw: bytes, pattern: str) -> Codec:
    """One for each Python worker and vocabulary."""
    key = (hashlib.sha256(raw).digest(), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(read_ranks(raw), pattern)
    return _codecs[key]


def encode_decode(docs: DataFrame, vocabulary: str, pattern: str, keep_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) for every row.

    ``vocabulary``: path of a file of base64 tokens and ranks, read on the driver
    and broadcast (its size is the vocabulary's, not the data's). A null or empty
    text has no tokens, a null id stays null. Rows are independent: no shuffle, any
    number of copies, and no ties. A text of any length is encoded whole, match by
    match; its ids must fit a task. An empty table gives no rows.
    ``ids``: little-endian unsigned 32-bit integers.
    """
    with open(vocabulary, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(sent.value, pattern)
        for b in batches:
            rows: list[list] = [[], [], [], []]
            for x in b.column(1):
                ids = c.encode(x.as_py() or "")
                rows[0].append(len(ids) // 4)
                rows[1].append(hashlib.sha256(ids).hexdigest())
                rows[2].append(hashlib.sha256(c.decode(ids)).hexdigest())
                if keep_ids:
                    rows[3].append(ids)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.binary()][: 3 + keep_ids]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v, k) for v, k in zip(rows, kinds, strict=False))], names=names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: 4 + keep_ids]
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids
    return id_and_text(docs, id_col, text_col).mapInArrow(run, schema)
