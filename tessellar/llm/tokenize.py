"""Token ids from public tokenizer files, at a rate a corpus scan can afford.

``FastEncoder`` gives the ids that ``Tokenizer.encode(text,
add_special_tokens=False)`` of the ``tokenizers`` library gives.

* A file with normalised words: a text of plain Latin characters is split by
  the file's own pre-tokenizer rule, written for Python's ``re``, and each piece
  not seen before goes to the library's BPE model; the ids of seen pieces are
  remembered.  Any other text takes the library's whole ``encode``.
* A byte-level file without a normalizer: the file's vocabulary, which lists the
  merges in order, is handed to ``tiktoken`` as ranks; its ids are the same
  (tested) and come several times faster.  A text that ``tiktoken`` refuses, such as
  a million blanks in a row, goes to the library.

A special token's string in a text gets that token's id, as the library gives it, unless
``special_as_text``; such texts go to the library too.

The memory is bounded: it is emptied when full, so a worker does not grow with
the input.
"""

from __future__ import annotations

import json
import re
import struct

#: Pieces and blank-separated chunks whose ids a worker remembers.
MAX_PIECES = 600_000
MAX_CHUNKS = 600_000

# Latin text without the few characters on which ``re`` and the files' patterns
# class differently: superscript digits and fractions, no-break space, dotted capital I.
_PLAIN = re.compile("[\t\n\r\\x20-\\x7e\\xa1-\\xb1\\xb4-\\xb8\\xba\\xbb\\xbf-įı-ɏ]*").fullmatch
# The word rule, letters first: its alternatives differ in the first character.
_SPLIT = re.compile(r"[^\W\d_]+|'(?:[stmd]|re|ve|ll)|\d|(?:[^\w\s]|_)+").findall
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_BYTES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class _ByteMap(dict):
    """Character to the printable stand-ins of its UTF-8 bytes, as byte-level BPE files write them."""

    def __init__(self):
        super().__init__()
        keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in set(keep)]
        self.byte = {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def __missing__(self, code: int) -> str:
        out = self[code] = "".join(self.byte[b] for b in chr(code).encode())
        return out


class _Pieces(dict):
    def __init__(self, model):
        super().__init__()
        self.tokenize, self.map = model.tokenize, _ByteMap()

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= MAX_PIECES:
            self.clear()
        ids = [t.id for t in self.tokenize(piece.translate(self.map))]
        out = self[piece] = struct.pack(f"<{len(ids)}I", *ids)
        return out


class _Chunks(dict):
    def __init__(self, pieces: _Pieces):
        super().__init__()
        self.pieces = pieces

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= MAX_CHUNKS:
            self.clear()
        out = self[chunk] = b"".join(map(self.pieces.__getitem__, _SPLIT(chunk)))
        return out


class FastEncoder:
    """Encode texts with one tokenizer file; ``encode`` returns ids as little-endian uint32 bytes."""

    def __init__(self, path: str, special_as_text: bool = False):
        from tokenizers import Tokenizer

        self.path, self.special_as_text = path, special_as_text
        self.tok = Tokenizer.from_file(path)
        spec = json.loads(self.tok.to_str())
        added = spec.get("added_tokens", [])
        # Added tokens that are found in normalised text only leave no short way.
        plain = special_as_text or not any(x.get("normalized") for x in added)
        self.special = re.compile("|".join(re.escape(x["content"]) for x in added)).search if added and not special_as_text else lambda text: None
        self.ranked = _ranked(spec) if plain else None
        self.words = plain and _is_words(spec)
        self.chunks = _Chunks(_Pieces(self.tok.model))
        if self.ranked is not None:
            # Neither is used but for a few texts; a worker's memory is short.
            self.tok = self.chunks = None

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.special(text):
            return self._by_library(text)
        if self.ranked is not None:
            try:
                return self.ranked.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
            except ValueError:
                return self._by_library(text)
        if self.words and _PLAIN(text):
            # White space only separates tokens, so every blank and newline is a free cut.
            return b"".join(map(self.chunks.__getitem__, text.lower().replace("\n", " ").split(" ")))
        return self._by_library(text)

    def _by_library(self, text: str) -> bytes:
        if self.tok is None:
            from tokenizers import Tokenizer

            self.tok = Tokenizer.from_file(self.path)
        self.tok.encode_special_tokens = self.special_as_text
        ids = self.tok.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)


def _is_words(spec: dict) -> bool:
    parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
    return (
        len(parts) == 2
        and bool(parts[0].get("invert"))
        and parts[0].get("pattern") == {"Regex": _WORDS}
        and parts[1].get("type") == "ByteLevel"
        and not parts[1].get("use_regex", True)
        and [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
    )


def _ranked(spec: dict):
    """A ``tiktoken`` encoding of a byte-level file whose ids follow its merges; None for other files."""
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    if pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") or spec.get("normalizer"):
        return None
    if model.get("type") != "BPE" or model.get("end_of_word_suffix") or model.get("continuing_subword_prefix") or model.get("dropout"):
        return None
    import tiktoken

    back = {c: b for b, c in _ByteMap().byte.items()}
    special = {x["content"] for x in spec.get("added_tokens", [])}
    vocab = {k: v for k, v in model["vocab"].items() if k not in special}
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    if [vocab.get(m) for m in merged] != list(range(256, 256 + len(merged))) or len(vocab) != 256 + len(merged):
        return None
    ranks = {bytes(back[c] for c in k): v for k, v in vocab.items()}
    return tiktoken.Encoding("file", pat_str=_BYTES, mergeable_ranks=ranks, special_tokens={})


_ENCODERS: dict[str, FastEncoder] = {}


def encoder(path: str) -> FastEncoder:
    """One encoder per worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = FastEncoder(path)
    return _ENCODERS[path]
