"""Exact token counts at every prefix of a text, by dynamic programming over byte-level BPE.

Inside one pre-token, the last token of each prefix is unique: a vocabulary entry ending there whose neighbour pair
with the last token before it survives the merges. So count[i] = count[i - len(last[i])] + 1, and one pass gives the
count of every prefix. Prefixes of a whole text add the pre-tokens before the cut; where cutting changes the
pre-tokens themselves (inside white space, contractions and special strings) those are counted anew.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from granary.llm.common import slices
from granary.llm.tokens import byte_letters

#: Fixed value: the byte-level pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same on characters on which Python's faster re agrees with it about letters, digits and white space.
PLAIN = re.compile("[\t\n\r\x20-\x7eÀ-ɏ‐-‧]*")
PLAIN_PATTERN = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+")
CACHE_ENTRIES, LONG = 600_000, 48

_LOADED: dict[str, "PrefixCounter"] = {}


class _Totals(dict):
    """Token count of each whole pre-token."""

    def __init__(self, counter: "PrefixCounter"):
        self.counter = counter

    def __missing__(self, piece: str) -> int:
        n = self[piece] = self.counter.byte_counts(piece.encode())[-1]
        return n


class PrefixCounter:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"] or {}, spec["model"]
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec["normalizer"] or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("prefix counts need a plain byte-level BPE tokenizer")
        letters = byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.special_re = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.vocab = {as_bytes(t) for t in model["vocab"] if all(c in letters for c in t)}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.ranks = {(as_bytes(a), as_bytes(b)): k for k, (a, b) in enumerate(merges)}
        endings: dict[bytes, set[int]] = {}  # lengths of the entries that end in two given bytes
        for token in self.vocab:
            if len(token) > 1:
                endings.setdefault(token[-2:], set()).add(len(token))
        self.lengths = {end: (*sorted(found, reverse=True), 1) for end, found in endings.items()}
        self.longest = max(map(len, self.vocab))
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.totals = _Totals(self)
        self.regex = regex.compile(PATTERN)

    def merge(self, data: bytes) -> list[bytes]:
        """The tokens of a short byte string, by merging the lowest-ranked pair again and again."""
        parts = [data[k : k + 1] for k in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(pair, 1 << 60), k) for k, pair in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def adjacent(self, a: bytes, b: bytes) -> bool:
        """Whether a then b survive as two tokens (a empty: whether b is one token)."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > CACHE_ENTRIES:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merge(a + b) == ([a, b] if a else [b])
        return known

    def byte_counts(self, data: bytes) -> list[int]:
        """Token counts of every byte prefix of one pre-token: n + 1 numbers, from 0.

        In a short piece every start is tried; in a long one, only those of entries that end in the same two bytes.
        """
        vocab, pairs, lengths, longest = self.vocab, self.pairs, self.lengths, self.longest
        count, last, long = [0], [b""], len(data) > LONG
        for end in range(1, len(data) + 1):
            if long:
                starts = [end - n for n in lengths.get(data[max(end - 2, 0) : end], (1,)) if n <= end]
            else:
                starts = range(max(0, end - longest), end)
            for start in starts:
                token = data[start:end]
                if token in vocab:
                    ok = pairs.get((last[start], token))
                    if ok or (ok is None and self.adjacent(last[start], token)):
                        last.append(token)
                        count.append(count[start] + 1)
                        break
            else:
                raise ValueError("a byte is not in the vocabulary")
        return count

    def char_counts(self, piece: str) -> list[int]:
        """Token counts of every character prefix of one pre-token."""
        data = piece.encode()
        count = self.byte_counts(data)
        ends = [0, *(k for k in range(1, len(data)) if data[k] & 0xC0 != 0x80), len(data)] if data else [0]
        return [count[k] for k in ends]

    def split(self, text: str) -> list[str]:
        return PLAIN_PATTERN.findall(text) if PLAIN.fullmatch(text) else self.regex.findall(text)

    def parts(self, text: str) -> list[str]:
        """Ordinary stretches and special strings by turns; the even ones are ordinary."""
        return self.special_re.split(text) if self.special_re else [text]

    def total(self, text: str) -> int:
        if len(self.totals) > CACHE_ENTRIES:
            self.totals.clear()
        get, n = self.totals.__getitem__, 0
        for k, part in enumerate(self.parts(text)):
            n += 1 if k % 2 else sum(map(get, self.split(part)))
        return n

    def _piece_prefixes(self, pieces: list[str], at: int = 0, before: int = 0) -> Iterator[tuple[int, int, list[int]]]:
        """(start, tokens before, counts of the prefixes ending in the piece) for pieces of ordinary text.

        The first piece must not follow white space; at and before are its start and the tokens before it.
        """
        run_before = before
        run = ""  # the white space that ends where this piece starts
        for piece in pieces:
            counts = self.char_counts(piece)
            if piece.isspace() or piece[0].isspace():
                lead = len(piece) if piece.isspace() else 1
                if not run:
                    run_before = before
                joined = run + piece[:lead]
                if run:
                    whole = self.char_counts(joined)
                    counts = counts[:1] + [run_before - before + n for n in whole[len(run) + 1 :]] + counts[lead + 1 :]
                run = joined if piece.isspace() else ""
            else:
                run = ""
            if piece[0] == "'" and len(piece) == 3 and piece in ("'re", "'ve", "'ll"):
                counts = [0, self.totals["'"], self.totals["'"] + self.totals[piece[1]], counts[3]]
            yield at, before, counts
            at, before = at + len(piece), before + self.totals[piece]

    def prefixes(self, text: str) -> np.ndarray:
        """n + 1 numbers: the exact token count of text[:i] at each i."""
        out = np.zeros(len(text) + 1, dtype=np.int32)
        at = before = seg_at = seg_before = 0
        plain = ""
        for k, part in enumerate(self.parts(text)):
            if k % 2:  # a cut special string is ordinary text, joined to the stretch before it
                for i in range(1, len(part)):
                    out[at + i] = seg_before + self.total(plain + part[:i])
                before += 1
                at += len(part)
                out[at] = before
            else:
                plain, seg_at, seg_before = part, at, before
                for start, b, counts in self._piece_prefixes(self.split(part)):
                    out[seg_at + start + 1 : seg_at + start + len(counts)] = [seg_before + b + c for c in counts[1:]]
                before += self.total(part)
                at += len(part)
        return out

    def measure(self, text: str, budget: int) -> tuple[int, int]:
        """The token count of a text, and the characters of its longest prefix of at most `budget` tokens."""
        if any(x in text for x in self.special):
            counts = self.prefixes(text)
            return int(counts[-1]), int(np.flatnonzero(counts <= budget)[-1])
        if len(self.totals) > CACHE_ENTRIES:
            self.totals.clear()
        pieces = self.split(text)
        each = list(map(self.totals.__getitem__, pieces))
        total = sum(each)
        if total <= budget:
            return total, len(text)
        # no prefix past the piece after the last one that starts within the budget can be within it
        last = before = 0
        while before + each[last] <= budget:
            before += each[last]
            last += 1
        first = last
        while first and pieces[first - 1].isspace():
            first -= 1
        at = best = sum(map(len, pieces[:first]))
        for start, b, counts in self._piece_prefixes(pieces[first : last + 2], at, before - sum(each[first:last])):
            best = max([best, *(start + k for k, c in enumerate(counts) if k and b + c <= budget)])
        return total, best

    def longest_within(self, text: str, budget: int) -> int:
        return self.measure(text, budget)[1]


def counter(path: str) -> PrefixCounter:
    """One counter for each file and worker process."""
    if path not in _LOADED:
        _LOADED[path] = PrefixCounter(path)
    return _LOADED[path]


def _mapped(df: DataFrame, id_col: str, text_col: str, schema: T.StructType, columns) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "__text"):
            texts = [t or "" for t in part.column("__text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("__id"), *columns(texts)], names=schema.names)

    return df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).mapInArrow(run, schema)


def token_counts(df: DataFrame, tokenizer_path: str, budget: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of df: the id, n_bytes, n_tokens, over_limit (n_tokens > budget), and fit_chars, the
    characters of the longest prefix that stays within the budget.

    Null texts count as empty: 0 bytes, 0 tokens. Null ids and repeated rows give a row each; an empty table none;
    other columns are not read. Whole texts are counted, however long. No shuffle.
    """
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType()), T.StructField("fit_chars", T.LongType())])

    def columns(texts: list[str]) -> list[pa.Array]:
        n, fit = zip(*(counter(tokenizer_path).measure(t, budget) for t in texts), strict=True)
        return [pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([k > budget for k in n], pa.bool_()), pa.array(fit, pa.int64())]

    return _mapped(df, id_col, text_col, schema, columns)


def prefix_table(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and prefix_tokens: element i (from 0) is the token count of the text's first i characters.

    Truncation to a budget and the cost of any cut are look-ups in it. Null and empty texts give [0]. Null ids and
    repeated rows give a row each; an empty table none; other columns are not read.
    """
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("prefix_tokens", T.ArrayType(T.IntegerType()))])
    return _mapped(df, id_col, text_col, schema, lambda texts: [pa.array([counter(tokenizer_path).prefixes(t) for t in texts], pa.list_(pa.int32()))])
