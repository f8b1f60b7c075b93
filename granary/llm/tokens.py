"""Token ids as the tokenizers library gives them, from public tokenizer files.

A text's ids are those of its pre-tokens one after another, and the library's model merges each by itself. So texts are
cut at single spaces between words, over which no pre-token reaches; the different stretches of a slice of texts are cut
into pre-tokens, and a pre-token that hasn't been met before is given to the library's model. Pre-tokens are known for
two kinds of files:

- byte-level BPE without a normalizer, where a space belongs to the word after it;
- lower-casing BPE with word ends, where white space is dropped.

Texts outside the plain Latin range, texts with a special token's string, and other files go to the library whole.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters on which Python's re and the tokenizers' patterns agree about letters, digits and white space, which
#: normal form C leaves alone, and whose lower case is one character.
PLAIN = re.compile("[\t\n\r\x20-\x7eÀ-įı-ɏ‐-‧]*")
#: The pre-tokenizing patterns of the files, written for those characters.
BYTE_PIECE = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+")
WORD_PIECE = re.compile(r"'(?:[stmd]|re|ve|ll)|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
#: The parts of a file that say which pattern holds.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
WORD_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
BETWEEN_WORDS = re.compile(r"(?<=\S) (?=\S)")
UNEVEN = ("  ", " \n", "\n ", " \t", "\t ", " \r", "\r ")
START = "\0"  # marks the first stretch of a text, which has no space before it
CACHE_PIECES = 450_000

_LOADED: dict[str, "FastTokenizer"] = {}


def byte_letters() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, others for code points from 256 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class _Pieces(dict):
    """The ids of each pre-token, by the library's model."""

    def __init__(self, model):
        self.tokenize, self.shown = model.tokenize, {byte: letter for letter, byte in byte_letters().items()}

    def __missing__(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():  # all but the space stand for themselves
            letters = piece.replace(" ", self.shown[32])
        else:
            letters = piece.encode().decode("latin-1").translate(self.shown)
        ids = self[piece] = b"".join([t.id.to_bytes(4, "little") for t in self.tokenize(letters)])
        return ids


class FastTokenizer:
    """The library's tokenizer of one file, with the ids of the pre-tokens it has met."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the only parallelism
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        spec = json.loads(self.library.to_str())
        self.special = [t["content"] for t in spec["added_tokens"]]
        pre, norm = spec["pre_tokenizer"] or {}, (spec["normalizer"] or {}).get("normalizers", [])
        self.fast = None
        if spec["normalizer"] is None and {k: pre.get(k) for k in BYTE_LEVEL} == BYTE_LEVEL:
            self.fast, self.pieces_of = self._at_spaces, lambda x: BYTE_PIECE.findall(x[1:] if x[:1] == START else " " + x)
        elif spec["model"].get("end_of_word_suffix") == "</w>" and [x["type"] for x in norm] == WORD_NORMALIZERS:
            self.fast, self.pieces_of = self._at_white_space, lambda x: WORD_PIECE.findall(x.lower())
        self.pieces = _Pieces(self.library.model)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _at_spaces(self, texts: list[str]) -> pa.ListArray:
        marked = [START + t for t in texts]
        if any(t[1:2] == " " or t[-1] == " " or any(u in t for u in UNEVEN) for t in marked):
            return pa.array([BETWEEN_WORDS.split(t) for t in marked], pa.list_(pa.string()))
        return pc.split_pattern(pa.array(marked, pa.string()), " ")

    def _at_white_space(self, texts: list[str]) -> pa.ListArray:
        return pc.ascii_split_whitespace(pa.array(texts, pa.string()))

    def _of_stretches(self, cut: pa.ListArray) -> list[np.ndarray]:
        """The ids of texts that are given as their stretches."""
        flat = cut.flatten().dictionary_encode()
        if len(self.pieces) > CACHE_PIECES:
            self.pieces.clear()
        of, pieces_of = self.pieces.__getitem__, self.pieces_of
        found = [b"".join(map(of, pieces_of(x))) for x in flat.dictionary.to_pylist()]
        size = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) >> 2
        known, first = np.frombuffer(b"".join(found), dtype="<u4"), np.cumsum(size) - size
        index = flat.indices.to_numpy()
        size, first = size[index], first[index]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = known[np.repeat(first - ends[:-1], size) + np.arange(int(ends[-1]))]
        offsets = cut.offsets.to_numpy()
        edges = ends[offsets - offsets[0]]
        return [ids[a:z] for a, z in zip(edges[:-1], edges[1:], strict=True)]

    def arrays(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text (null: empty) without added tokens."""
        texts = [t or "" for t in texts]
        fits = [self.fast is not None and PLAIN.fullmatch(t) is not None and not any(s in t for s in self.special) for t in texts]
        known = iter(self._of_stretches(self.fast([t for t, ok in zip(texts, fits, strict=True) if ok]))) if any(fits) else iter(())
        whole = (np.frombuffer(x, dtype="<u4") for x in self.whole([t for t, ok in zip(texts, fits, strict=True) if not ok]))
        return [next(known if ok else whole) for ok in fits]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The same as little-endian unsigned 32-bit integers."""
        return [x.tobytes() for x in self.arrays(texts)]


def tokenizer(path: str) -> FastTokenizer:
    """One tokenizer for each file and worker process."""
    if path not in _LOADED:
        _LOADED[path] = FastTokenizer(path)
    return _LOADED[path]


def encode(path: str, texts: list[str | None]) -> list[np.ndarray]:
    return tokenizer(path).arrays(texts)
