"""Encoding with the tokenizers library, at most once per distinct piece of text that a worker meets.

Both vocabularies cut a text into words before they merge bytes, so a text's ids are its words' ids one after another.
A worker keeps the ids of the words it has met; new ones go to the library together. A text that holds the string of a special token goes to the library whole.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: How the two public vocabularies cut a text before merging.
BYTE_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
#: One letter-only word; chunks that the library gets alone: those of the byte vocabulary with white space inside, those of the word
#: vocabulary with letters that neither normal form C nor lower-casing treats one by one.
BYTE_EASY, WORD_EASY = "^ ?[A-Za-z]+$", "^[A-Za-z]*$"
BLANKS = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
BYTE_ALONE, WORD_ALONE = rf"\x00|(?s:.)[{BLANKS}]|^[\n{BLANKS[2:]}\t\r\f]|^ $", r"[^\x21-\x7e\x{a1}-\x{12f}\x{131}-\x{17e}]"
#: White space that makes a text's words depend on more than one space or line end between them.
ODD = ("  ", " \n", "\n ", "\n\n", "\t", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f", "\0")
ODD_WIDE = tuple(map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: New chunks of one text for the library, whose time grows faster than the text.
JOINED = 200


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte: itself if printable, else the next from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Index(dict):
    """Numbers chunks in the order they come; ``new`` holds those without ids yet."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        self.new.append(chunk)
        at = self[chunk] = len(self)
        return at


class Encoder:
    """Ids of whole texts as the library gives them with add_special_tokens=False."""

    def __init__(self, path: str, most_chunks: int = 1_000_000) -> None:
        import regex
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.whole = Tokenizer.from_file(path)
        added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)", re.I)
        self.signs = {next((c for c in x if not c.isalnum()), "") for x in added}  # a text without any of these holds no special token
        self.words = self.whole.normalizer is not None  # the lower-case vocabulary with word ends
        self.bare = Tokenizer.from_file(path)
        self.bare.encode_special_tokens = True
        self.bare.normalizer = None
        self.bare.pre_tokenizer = WhitespaceSplit()
        if hasattr(self.bare.model, "_resize_cache"):
            model = self.bare.model
            model._resize_cache(0)
            self.bare.model = model
        self.pieces = regex.compile(WORD_PIECES + r"|\n" if self.words else BYTE_PIECES).findall
        letters = _byte_letters()
        # in what goes to the library, pieces are apart by a blank and chunks by a line end's letter, which no plain chunk holds
        self.table = letters | {0: " ", 10: f" {letters[10]} "}
        (self.mark_id,) = self.bare.encode(letters[10], add_special_tokens=False).ids
        self.most = most_chunks
        self._reset()

    def _reset(self) -> None:
        self.index = _Index()
        self.kept_whole: set[str] = set()
        self.flat = np.zeros(1 << 16, np.int32)
        self.start = np.zeros(1 << 16, np.int64)
        self.length = np.zeros(1 << 16, np.int64)
        self.filled = self.known = 0

    def _chunks(self, text: str) -> list[str]:
        if not text:
            return []
        if any(c in text for c in self.signs) and self.added.search(text):
            self.kept_whole.add(text)
            return [text]
        if self.words:
            return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        odd = text[0] in " \n" or text[-1] in " \n" or any(x in text for x in ODD) or (not text.isascii() and any(x in text for x in ODD_WIDE))
        if odd:
            return re.split(r"(?= \S)", text)  # a space before something else always begins a word
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")

    def _append(self, ids: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> None:
        """Keep the ids of chunks ``at``, one after another, ``sizes`` of each."""
        total = self.filled + len(ids)
        if total > len(self.flat):
            self.flat = np.resize(self.flat, max(total, 2 * len(self.flat)))
        self.flat[self.filled : total] = ids
        self.length[at] = sizes
        self.start[at] = self.filled + np.cumsum(sizes) - sizes
        self.filled = total

    def _learn(self) -> None:
        """Give the new chunks their ids."""
        new, self.index.new = self.index.new, []
        base, self.known = self.known, self.known + len(new)
        if self.known > len(self.start):
            grow = max(self.known, 2 * len(self.start))
            self.start, self.length = np.resize(self.start, grow), np.resize(self.length, grow)
        found = lambda pattern: pc.match_substring_regex(pa.array(new), pattern).to_numpy(zero_copy_only=False)
        easy, alone = found(WORD_EASY if self.words else BYTE_EASY), found(WORD_ALONE if self.words else BYTE_ALONE)
        if self.kept_whole:
            alone |= np.fromiter(map(self.kept_whole.__contains__, new), bool, len(new))
        odd = np.flatnonzero(alone).tolist()
        for some, cut in ((np.flatnonzero(easy & ~alone), False), (np.flatnonzero(~easy & ~alone), True)):
            for a in range(0, len(some), JOINED):
                at = some[a : a + JOINED]
                joined = "\n".join([new[i] for i in at.tolist()])
                if self.words:
                    joined = joined.lower()
                if cut:
                    joined = "\0".join(self.pieces(joined))
                ids = np.asarray(self.bare.encode_batch_fast([joined.encode().decode("latin-1").translate(self.table)], add_special_tokens=False)[0].ids, np.int32)
                mark = ids == self.mark_id
                ends = np.append(np.flatnonzero(mark), len(ids))
                self._append(ids[~mark], np.diff(ends, prepend=-1) - 1, base + at)
        for a in range(0, len(odd), 500):
            part = odd[a : a + 500]
            found = [e.ids for e in self.whole.encode_batch([new[i] for i in part], add_special_tokens=False)]
            self._append(np.array([x for f in found for x in f], np.int32), np.array([len(f) for f in found]), base + np.array(part))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each text)."""
        if len(self.index) > self.most:
            self._reset()
        rows = []
        for t in texts:
            c = self._chunks(t)
            rows.append(np.fromiter(map(self.index.__getitem__, c), np.int64, len(c)))
        if self.index.new:
            self._learn()
        idx = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        sizes = self.length[idx]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.repeat(self.start[idx] - (ends - sizes), sizes) + np.arange(total)]
        upto = np.append(0, ends)[np.cumsum([len(r) for r in rows], dtype=np.int64)]
        return ids, np.diff(upto, prepend=0).astype(np.int64)


_ENCODERS: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, most_chunks: int) -> Encoder:
    """This process's encoder for a vocabulary file. Its memory: about 100 MB and 170 MB for a million chunks kept."""
    if (path, most_chunks) not in _ENCODERS:
        _ENCODERS[path, most_chunks] = Encoder(path, most_chunks)
    return _ENCODERS[path, most_chunks]


def spans(texts: list[str | None], most_chars: int = 1_000_000):
    """(from, to) of runs of texts of about ``most_chars`` at most, or one longer text."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > at and size + n > most_chars:
            yield at, i
            at, size = i, 0
        size += n
    if at < len(texts):
        yield at, len(texts)
