"""BPE encoding and decoding with the files of public tokenizers.

Encoding backtracks over longest token matches. An Aho-Corasick automaton gives the longest token that
begins at each place of a word; a token may follow another only if the pair is compatible, that is, if
merging the two spellings anew leaves the border between them; where no token fits, the last one gives way
to its next shorter prefix. The result is exactly what merging by rank gives, in time linear in the word.
Words that were met before come from a table in memory; when it is full, a new one is begun beside it.

Decoding looks every id up in one byte buffer through an offset table.
"""

from __future__ import annotations

import hashlib
import json
import sys
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tractloom.llm.runtime import arrow_pass

#: The byte-to-character table of byte-level BPE keeps these printable bytes and moves the rest to 256 and up.
PRINTABLE = [(0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF)]
#: Fixed value: what the file's splitter takes as pieces of a word; none holds white space.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Control characters that Python takes for white space and the file's normaliser doesn't.
ODD_SPACES = "\x1c\x1d\x1e\x1f"
END = 0x1000  # added to the code of a word's last character, where the vocabulary spells </w>
CACHE_WORDS, CACHE_PAIRS = 100_000, 400_000


def byte_chars() -> list[str]:
    keep = {b for lo, hi in PRINTABLE for b in range(lo, hi + 1)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b) if b in keep else chr(spare))
        spare += b not in keep
    return out


class WordBpe:
    """An encoder for a tokenizers file of BPE with word ends, and its decoder."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS) -> None:
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.pieces = regex.compile(PIECES)
        self.char = byte_chars()
        self.unit: dict[str, int] = {}
        spelled = {}
        for token, i in model["vocab"].items():
            u = self._units(token, suffix)
            self.unit[u] = i
            spelled[i] = u
        self.text = spelled
        # Rank order is id order: every merge makes the next id.
        self.parts: dict[int, tuple[int, int]] = {}
        self.merge: dict[tuple[int, int], int] = {}
        for m in model["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            ids = model["vocab"][a], model["vocab"][b]
            whole = model["vocab"][a + b]
            self.merge[ids] = whole
            self.parts[whole] = ids
        if sorted(self.merge.values()) != list(self.merge.values()):
            raise ValueError("merges are not in the order of their ids")
        if array("I").itemsize != 4 or sys.byteorder != "little":
            raise ValueError("ids are kept as little-endian unsigned 32-bit integers")
        self.automaton = ahocorasick.Automaton()
        for u, i in self.unit.items():
            self.automaton.add_word(u, (len(u), i))
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}
        self.shorter: dict[int, int] = {}
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}
        self.cache_words = cache_words
        # The offset table: ids in order, each token's UTF-8 spelling in one buffer.
        spelling = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        each = [spelling.get(i, "").encode() for i in range(max(spelling) + 1)]
        self.buffer = np.frombuffer(b"".join(each), np.uint8)
        self.offset = np.cumsum([0, *map(len, each)])

    @staticmethod
    def _units(token: str, suffix: str) -> str:
        if token.endswith(suffix) and len(token) > len(suffix):
            t = token[: -len(suffix)]
            return t[:-1] + chr(ord(t[-1]) + END)
        return token

    def _fit(self, a: int, b: int) -> bool:
        """Whether the border between tokens a and b outlives the merges of their joined spelling.

        The history of the two tokens is undone from the latest merge on. At each stage the pieces that meet
        at the border must not merge before the merge just undone; on the right side an equal rank counts as
        before, since merging goes from the left.
        """
        known = self.fits.get(a << 20 | b)
        if known is not None:
            return known
        x, y, before = a, b, 1 << 60
        fits = True
        while True:
            joined = self.merge.get((x, y))
            if joined is not None and joined < before:
                fits = False
                break
            px, py = self.parts.get(x), self.parts.get(y)
            if px is None and py is None:
                break
            if py is None or (px is not None and x > y):
                before, x = x, px[1]
            else:
                before, y = y + 1, py[0]
        if len(self.fits) >= CACHE_PAIRS:
            self.fits.clear()
        self.fits[a << 20 | b] = fits
        return fits

    def _shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of this one; -1: none."""
        if (s := self.shorter.get(token)) is None:
            u, s = self.text[token], -1
            for k in range(len(u) - 1, 0, -1):
                if (s := self.unit.get(u[:k], -1)) >= 0:
                    break
            self.shorter[token] = s
        return s

    def encode_piece(self, piece: str) -> list[int]:
        if piece.isascii() and piece.isprintable():
            u = piece[:-1] + chr(ord(piece[-1]) + END)
        else:
            char = self.char
            u = "".join([char[x] for x in piece.encode()])
            u = u[:-1] + chr(ord(u[-1]) + END)
        if (whole := self.unit.get(u)) is not None:
            return [whole]
        n = len(u)
        longest = [-1] * n
        begin = n
        for end, (size, i) in self.automaton.iter(u):  # ends in order, and at each end the longest first
            begin = end - size + 1
            longest[begin] = i
        out: list[int] = []
        at, token, dead = 0, longest[0], set()
        text, fits = self.text, self.fits
        while at < n:
            while token >= 0:
                end = at + len(text[token])
                if end not in dead:
                    if not out:
                        break
                    fit = fits.get(out[-1] << 20 | token)
                    if self._fit(out[-1], token) if fit is None else fit:
                        break
                token = self._shorter(token)
            if token >= 0:
                out.append(token)
                at = end
                if at < n:
                    token = longest[at]
                continue
            dead.add(at)
            if not out:
                raise ValueError(f"no spelling for {piece!r}")
            last = out.pop()
            at -= len(text[last])
            token = self._shorter(last)
        return out

    def _lower(self, s: str) -> str:
        s = unicodedata.normalize("NFC", s)
        return s.replace("Σ", "σ").lower() if "Σ" in s else s.lower()

    def _word(self, word: str) -> bytes:
        if (got := self.older.get(word)) is None:
            if word.isalpha() and word.isascii():
                got = self._piece(word.lower())
            else:
                got = b"".join([self._piece(p) for p in self.pieces.findall(self._lower(word))])
        if len(word) <= 64:
            if len(self.cache) >= self.cache_words:
                self.older, self.cache = self.cache, {}
            self.cache[word] = got
        return got

    def _piece(self, piece: str) -> bytes:
        if (got := self.known.get(piece)) is None:
            got = array("I", self.encode_piece(piece)).tobytes()
            if len(piece) <= 64:
                if len(self.known) >= self.cache_words:
                    self.known.clear()
                self.known[piece] = got
        return got

    def _run(self, text: str) -> list[bytes]:
        if any(c in text for c in ODD_SPACES):
            import regex

            split = [w for w in regex.split(r"[\t-\r \x85\xa0  -     　]+", text) if w]
        else:
            split = text.split()
        out = []
        for w in split:
            got = self.cache.get(w)
            out.append(self._word(w) if got is None else got)
        return out

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers; null is encoded as the empty text."""
        if not text:
            return b""
        if self.special_split is None or "<|" not in text:
            return b"".join(self._run(text))
        out: list[bytes] = []
        for s in self.special_split.split(text):
            out += [np.array([self.special[s]], "<u4").tobytes()] if s in self.special else self._run(s)
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> bytes:
        """The spellings with one space between them, as the library joins tokens where a file names no decoder."""
        if not len(ids):
            return b""
        at, size = self.offset[ids], self.offset[ids.astype(np.int64) + 1] - self.offset[ids] + 1
        ends = np.cumsum(size)
        idx = np.arange(ends[-1]) + np.repeat(at - (ends - size), size)
        idx[ends - 1] = 0
        out = self.buffer[idx]
        out[ends - 1] = 0x20
        return out[:-1].tobytes()


OUT = T.StructType([
    T.StructField("n_tokens", T.LongType()),
    T.StructField("ids", T.BinaryType()),
    T.StructField("ids_sha256", T.StringType()),
    T.StructField("decoded_sha256", T.StringType()),
])


def encode_documents(docs: DataFrame, path: str, carry: list[str], with_ids: bool = False) -> DataFrame:
    """One narrow pass; per row n_tokens, ids (binary, where with_ids, else null), and digests of ids and decoded text.

    A null or empty text has no tokens and the digests of nothing. Texts are encoded whole, whatever their length;
    repeated rows give repeated results. path is a file that every machine has at the same place.
    """

    def make():
        bpe = WordBpe(path)

        def f(b: pa.RecordBatch) -> dict:
            n, ids_out, sha, back = [], [], [], []
            for t in b.column(0):
                ids = bpe.encode(t.as_py())
                n.append(len(ids) // 4)
                ids_out.append(ids if with_ids else None)
                sha.append(hashlib.sha256(ids).hexdigest())
                back.append(hashlib.sha256(bpe.decode(np.frombuffer(ids, "<u4"))).hexdigest())
            return {"n_tokens": n, "ids": ids_out, "ids_sha256": sha, "decoded_sha256": back}

        return f

    return arrow_pass(docs, {"text": F.col("text")}, carry, make, OUT)
