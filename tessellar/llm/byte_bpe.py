"""Byte-level BPE by the ``tiktoken`` library and a local rank file: texts to token ids, and ids to raw bytes.

Ids are those of ``tiktoken`` for the whole text, without special tokens: each match of the pattern by itself.
Long texts go to the library in parts, cut only where the pattern has a boundary whatever stands on either
side, so no worker holds more than a part's matches.  Decoding joins bytes and never passes through
characters, so ids that begin or end inside a character come back as they are.

Edge cases: a null text is an empty one and has no ids; null ids decode to no bytes; an id that the ranks
lack, or a null one, raises.  Both functions are of a column, so other columns, repeated rows, ties and empty
tables are as Spark has them.  A run of white space that the library's pattern gives up on is told apart
here by the pattern's own rule.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of a part, at least, and of a run of white space that is a part of its own.
PART, BLANKS = 1 << 16, 1 << 12
# White space as the pattern's ``\s`` has it (Unicode's White_Space).
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# No match of the pattern goes on from a character into white space after it.
_BOUNDARY = re.compile(rf"[^\s{_SPACE}](?=[{_SPACE}])")
_RUN = re.compile(rf"[{_SPACE}]{{{BLANKS},}}")


class ByteBpe:
    """Encode and decode with one file of ranks; ``part`` bounds what the library gets at once."""

    def __init__(self, path: str, pattern: str, part: int = PART):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.part = part

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        if len(text) < BLANKS:
            return self._plain(text)
        found, at = [], 0
        for run in _RUN.finditer(text):
            # A run before a character leaves its last blank to what follows.
            stop = run.end() - (run.end() < len(text))
            found += [*self._parts(text[at : run.start()]), self._piece(text[run.start() : stop])]
            at = stop
        return np.concatenate([*found, *self._parts(text[at:])])

    def _parts(self, text: str):
        at = 0
        while len(text) - at > self.part and (cut := _BOUNDARY.search(text, at + self.part)):
            yield self._plain(text[at : cut.end()])
            at = cut.end()
        yield self._plain(text[at:])

    def _plain(self, text: str) -> np.ndarray:
        return np.array(self.encoding.encode_ordinary(text), np.int32)

    def _piece(self, text: str) -> np.ndarray:
        return np.array(self.encoding._encode_single_piece(text), np.int32)

    def decode(self, ids: list[int] | None) -> bytes:
        return self.encoding.decode_bytes(ids) if ids else b""


_CODERS: dict[tuple[str, str], ByteBpe] = {}


def coder(path: str, pattern: str) -> ByteBpe:
    """One per worker process, file and pattern."""
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = ByteBpe(path, pattern)
    return _CODERS[path, pattern]


def token_ids(text: Column, path: str, pattern: str) -> Column:
    """The ids of a text, as an array of int; ``path`` names a file of ranks that every executor has."""

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        own = coder(path, pattern)
        ids = [own.encode(t.as_py()) for t in texts]
        offsets = np.zeros(len(ids) + 1, np.int32)
        np.cumsum([len(x) for x in ids], out=offsets[1:])
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*ids, np.empty(0, np.int32)])))

    return encode(text)


def decoded(ids: Column, path: str, pattern: str) -> Column:
    """The bytes that ids stand for."""

    @F.arrow_udf("binary")
    def decode(rows: pa.Array) -> pa.Array:
        own = coder(path, pattern)
        return pa.array([own.decode(r.as_py()) for r in rows], pa.binary())

    return decode(ids)
