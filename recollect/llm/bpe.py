"""Byte-level BPE with the tokenizers library: encoding, offsets, decoding.

A text is cut at single spaces between non-spaces, where the public pattern always cuts too (a pattern that fails a
trial of this gets whole texts); what lies between is remembered with its ids, so that the pattern and the library's
merges run once for each distinct stretch. The memory is bounded: two generations of at most MEMO entries of at most
LONGEST characters each. Whole columns are cut by arrays, some megabytes at a time, and each distinct stretch of these
is looked up once. Strings of the tokenizer's added tokens are ordinary text, as the vocabulary files' own description has it: no
document can bring in a token that ends one.
"""

from __future__ import annotations

import base64
import string
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer, models

MEMO = 400_000
LONGEST = 48
#: Bytes of text whose stretches are told apart at once.
SLICE = 4 << 20
#: White space as str.isspace has it: single bytes as a table, longer ones as numbers, their first byte highest.
WHITE = [chr(i).encode() for i in range(0x3001) if chr(i).isspace()]
WHITE_BYTES = np.isin(np.arange(256), [w[0] for w in WHITE if len(w) == 1])
WHITE_LONG = {n: np.array([int.from_bytes(w, "big") for w in WHITE if len(w) == n]) for n in (2, 3)}
#: Ends and beginnings of words with which a pattern is tried.
TRIAL = ["a", "Z", "\u00e9t\u00e9", "12", "\u00b2", "!?", "'s", "_", "-", "\u4e2d\u6587", "\U0001f600", "\u0301", "\x00"]

#: What ends a word of letters in most patterns: ASCII marks that begin no contraction, and the end of a line.
MARKS = "".join(c for c in string.punctuation if c not in "'_") + "\n"
IS_LETTER, IS_MARK = (np.isin(np.arange(256), list(c.encode("ascii"))) for c in (string.ascii_letters, MARKS))


def byte_table() -> list[str]:
    """The character that stands for each byte: itself where printable in Latin-1, else the next one from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def model_from_ranks(ranks: dict[bytes, int]) -> models.BPE:
    """A BPE model whose merges follow the ranks: a token's merge is the last one that its bytes take by lower ranks."""
    table = byte_table()
    name = lambda raw: "".join(table[b] for b in raw)
    merges = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) == 1:
            continue
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = min((ranks.get(parts[i] + parts[i + 1], rank), i) for i in range(len(parts) - 1))
            if best >= rank:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            merges.append((name(parts[0]), name(parts[1])))
    return models.BPE(vocab={name(t): r for t, r in ranks.items()}, merges=merges, ignore_merges=True)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Codec:
    """Ids as the little-endian unsigned 32-bit bytes that the contracts hash."""

    def __init__(self, model: models.BPE, vocabulary: dict[str, int], pattern: str):
        self.model, self.find = model, regex.compile(pattern).findall
        self.cuts = all(self.find(f"{a} {b}") == self.find(a) + self.find(f" {b}") for a in TRIAL for b in TRIAL)
        self.more_cuts = self.cuts and all(self.find(f"{w}{m}{b}") == self.find(w) + self.find(f"{m}{b}") for w in ("a", "Zq", "it") for m in MARKS for b in ["", " ", *TRIAL])
        self.more_cuts &= all(self.find(f"{a}\n{b}") == self.find(f"{a}\n") + self.find(b) for a in TRIAL for b in TRIAL)
        self.letters = self.find(" abcxyzABCXYZ") == [" abcxyzABCXYZ"]
        table = byte_table()
        self.to_chars = str.maketrans({chr(b): table[b] for b in range(256)})
        back = {ord(c): b for b, c in enumerate(table)}
        self.raw: list[bytes] = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for token, i in vocabulary.items():
            if all(ord(c) in back for c in token):
                self.raw[i] = bytes(back[ord(c)] for c in token)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @classmethod
    def from_json(cls, path: str, pattern: str) -> Codec:
        """The library's own file; the strings of added tokens are ordinary text (the library's encode_special_tokens)."""
        t = Tokenizer.from_file(path)
        return cls(t.model, t.get_vocab(with_added_tokens=False), pattern)

    @classmethod
    def from_ranks(cls, path: str, pattern: str) -> Codec:
        table, ranks = byte_table(), read_ranks(path)
        return cls(model_from_ranks(ranks), {"".join(table[b] for b in t): r for t, r in ranks.items()}, pattern)

    def _piece(self, piece: str) -> bytes:
        if piece[0] == " " and piece[1:].isalpha() and piece.isascii():  # letters stand for themselves
            chars = self.to_chars[0x20] + piece[1:]
        else:
            chars = piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.to_chars)
        ids = array("I", [t.id for t in self.model.tokenize(chars)])
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def _recall(self, key: str) -> bytes | None:
        found = self.old.get(key)
        if found is not None:
            self._remember(key, found)
        return found

    def _remember(self, key: str, ids: bytes) -> None:
        if len(key) > LONGEST:
            return
        if len(self.young) >= MEMO:
            self.old, self.young = self.young, {}
        self.young[key] = ids

    def forget(self) -> None:
        """Frees what is remembered: idle workers then hold the model only."""
        self.young, self.old = {}, {}

    def _stretch(self, key: str) -> bytes:
        out = self._recall(key)
        if out is None:
            # The public pattern takes a space and letters whole.
            pieces = () if self.letters and key[0] == " " and key[1:].isalpha() and key.isascii() else self.find(key)
            if len(pieces) < 2:
                out = self._piece(key)
            else:
                parts = []
                for p in pieces:
                    ids = self.young.get(p) or self._recall(p)
                    if ids is None:
                        ids = self._piece(p)
                        self._remember(p, ids)
                    parts.append(ids)
                out = b"".join(parts)
            self._remember(key, out)
        return out

    def _stretches(self, text: str) -> list[str]:
        if not self.cuts:
            return [text]
        parts = text.split(" ")
        out, held = [], parts[0]
        for part in parts[1:]:
            if part and held and not part[0].isspace() and not held[-1].isspace():
                out.append(held)
                held = " " + part
            else:  # a run of white space: the pattern decides where it ends
                held += " " + part
        out.append(held)
        return out

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        return b"".join([self.young.get(s) or self._stretch(s) for s in self._stretches(text)])

    def encode_each(self, texts: pa.Array) -> Iterator[bytes]:
        """encode() of each row of a string column."""
        if not self.cuts:
            yield from map(self.encode, texts_of(texts))
            return
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE, side="right")) - 1)
            first, ids = self._encode_slice(data[ends[at] : ends[to]], ends[at : to + 1] - ends[at])
            for a, b in zip(first[:-1], first[1:]):
                yield ids[a:b].tobytes()
            at = to

    def _encode_slice(self, data: np.ndarray, ends: np.ndarray) -> tuple[list[int], np.ndarray]:
        """Where each text's ids begin, and all ids, of texts that lie one after the other."""
        starts = stretch_starts(data, ends, self.more_cuts)
        rows = np.searchsorted(starts, ends)  # of stretches before each text
        offsets = np.append(starts, len(data)).astype(np.int32)
        each = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
        young, which = self.young, each.indices.to_numpy()
        found = [young.get(s) or self._stretch(s) for s in each.dictionary.to_numpy(zero_copy_only=False).tolist()]
        lens = np.fromiter(map(len, found), np.int64, len(found)) // 4
        n = lens[which]
        done = np.concatenate([[0], np.cumsum(n)])
        take = np.arange(done[-1]) + np.repeat((np.cumsum(lens) - lens)[which] - done[:-1], n)
        return done[rows].tolist(), np.frombuffer(b"".join(found), np.uint32)[take]

    def offsets(self, text: str | None) -> list[tuple[int, int]]:
        """First and end character of each token; tokens that split one character's bytes all span that character."""
        text = text or ""
        first = np.array([i for i, c in enumerate(text) for _ in c.encode("utf-8", "surrogatepass")] or [0])
        ends = np.cumsum([len(self.raw[i]) for i in np.frombuffer(self.encode(text), "<u4")] or [0])
        starts = np.concatenate([[0], ends[:-1]])
        return [(int(first[a]), int(first[b - 1]) + 1) for a, b in zip(starts, ends) if b > a]

    def decode(self, ids: bytes) -> bytes:
        """The bytes of the ids; a character whose bytes lie in several tokens is whole again once they are joined."""
        return b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def stretch_starts(data: np.ndarray, ends: np.ndarray, more: bool) -> np.ndarray:
    """First bytes of the stretches of texts in UTF-8: where a text begins, and single spaces between non-spaces.

    With more, also marks after an ASCII letter, and what follows a single end of a line.
    """
    white = np.append(WHITE_BYTES[data], False)
    for n, chars in WHITE_LONG.items():
        lead = np.flatnonzero(np.isin(data, chars >> (8 * (n - 1))))
        lead = lead[lead + n <= len(data)]
        own = lead[np.isin(sum(data[lead + i].astype(np.int64) << (8 * (n - 1 - i)) for i in range(n)), chars)]
        for i in range(n):
            white[own + i] = True
    begins = np.zeros(len(data) + 1, bool)
    begins[ends] = True
    space = np.flatnonzero(data == 0x20)
    begins[space[~(white[space - 1] | white[space + 1] | begins[space + 1])]] = True
    if more:
        own = begins.copy()
        own[1:-1] |= IS_LETTER[data[:-1]] & IS_MARK[data[1:]]
        line = np.flatnonzero(data == 0x0A)
        own[line[~(white[line - 1] | white[line + 1] | begins[line])] + 1] = True
        begins = own
    return np.flatnonzero(begins[:-1])


def texts_of(column) -> Iterator[str | None]:
    for value in column:
        yield value.as_py()
