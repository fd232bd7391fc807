"""Token ids of the pieces of a text, remembered by each Python worker.

A piece is a run of white space with the run of other characters behind it. Both byte-level patterns that the
public vocabularies use end a word before white space wherever other characters precede it, so the ids of a text
are those of its pieces, one behind the other. Most pieces come again and again; the library is asked once for
each. Pieces of Latin letters alone are one word to either pattern and go straight to the library's BPE model.
Where words stand one space or one line end apart, str.split finds the pieces.
"""

from __future__ import annotations

import json
import os
import re
from array import array

# Unicode's White_Space characters.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECE = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
BARE = re.compile(f"[^{SPACE}]+")
WORD = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: Marks that end a word of either pattern when they follow a letter or digit, and begin nothing that an apostrophe could join.
MARKS = ",.;:!?%$&*#|"
ENDS = frozenset(MARKS)
PLAIN_END = re.compile("[A-Za-z0-9À-ÖØ-öø-ÿ]")
REMEMBERED = 300_000
CONTROLS = "\x1c\x1d\x1e\x1f"
# Normalisation and word patterns of the two public byte-level vocabularies, and the word-end mark that goes with each.
PATTERNS = [
    (None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}, None),
    (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {"type": "Sequence", "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ]},
        "</w>",
    ),
]


def byte_letters() -> dict[int, str]:
    """Byte-level BPE writes each byte as one letter: printable ones as themselves, the rest from 256 on."""
    out, rest = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b:
            out[b] = chr(b)
        else:
            out[b] = chr(rest)
            rest += 1
    return out


class Odd(Exception):
    """A word with white space inside that only the slow way may take apart."""


class Memo(dict):
    """What `learn` gives for a key, remembered in two generations of `kept` entries each: hits cost a dict look-up, entries in use stay."""

    def __init__(self, learn, kept: int):
        super().__init__()
        self.learn, self.kept, self.old = learn, kept, {}

    def __missing__(self, key: str) -> bytes:
        got = self.old.get(key)
        if got is None:
            got = self.learn(key)
        if len(self) >= self.kept:
            self.old = dict(self)
            self.clear()
        self[key] = got
        return got


def by_pieces(path: str) -> bool:
    """Whether the tokenizer splits texts by one of the two patterns that pieces are right for, with byte letters and no other rule."""
    with open(path, encoding="utf-8") as file:
        made = json.load(file)
    model, tokens = made["model"], made.get("added_tokens") or []
    plain = model["type"] == "BPE" and not (model.get("dropout") or model.get("continuing_subword_prefix") or model.get("ignore_merges") or made.get("post_processor"))
    plain = plain and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or BARE.fullmatch(t["content"]) is None for t in tokens)
    return plain and any((made.get("normalizer"), made.get("pre_tokenizer"), model.get("end_of_word_suffix") or None) == known for known in PATTERNS)


class Pieces:
    """Encodes texts by the tokenizer at `path`; ids are little-endian 32-bit integers in bytes.

    Vocabularies with word ends drop white space, so their pieces come without it. Memos of `remembered` entries at most in each of two
    generations bound the memory. A tokenizer that by_pieces() doesn't know encodes each text whole."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        if hasattr(self.model, "_resize_cache"):
            self.model._resize_cache(0)  # the memos below do its work
        self.whole = not by_pieces(path)
        self.words_end = bool(getattr(self.tokenizer.model, "end_of_word_suffix", None))
        self.split = self._words if self.words_end else PIECE.findall
        self.letters = [byte_letters()[b] for b in range(256)]
        self.space = self.letters[32]
        self.known = Memo(self._learn, remembered if self.words_end else remembered // 4)
        self.spaced = Memo(self._learn_spaced, remembered)
        self.line_end = b"" if self.whole else self._core("\n")

    def library(self, texts: list[str]) -> list[bytes]:
        """Whole texts, as the library encodes them."""
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, text: str) -> list[str]:
        """Runs without white space. str.split also parts words at four control characters that are no white space to the patterns."""
        return BARE.findall(text) if any(c in text for c in CONTROLS) else text.split()

    def _core(self, piece: str) -> bytes:
        if WORD.fullmatch(piece):
            word = piece.lower() if self.words_end else piece
            return self._model("".join([self.letters[b] for b in word.encode()]))
        return self.library([piece])[0]

    def _model(self, letters: str) -> bytes:
        """The ids of one word, written in byte letters."""
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _learn(self, piece: str) -> bytes:
        """The ids of a piece that is not remembered yet; marks behind a plain word are words of their own."""
        core = piece.rstrip(MARKS)
        if core != piece and core and PLAIN_END.match(core[-1]):
            return self.known[core] + self.known[piece[len(core) :]]
        return self._core(piece)

    def _learn_spaced(self, word: str) -> bytes:
        """The ids of a word behind one space."""
        if word.isascii():
            if word.isalpha():
                return self._model(self.space + word)
            if word[-1:] in ENDS and word[:-1].isalpha():
                return self.spaced[word[:-1]] + self.known[word[-1]]
        core = word.rstrip(MARKS)
        if core != word and core and PLAIN_END.match(core[-1]):
            return self.spaced[core] + self.known[word[len(core) :]]
        if BARE.fullmatch(word) is None:
            raise Odd
        return self._core(" " + word)

    def encode(self, parts: list[str]) -> list[bytes]:
        return [*map(self.known.__getitem__, parts)]

    def _lines(self, text: str) -> bytes:
        """The ids of a text whose words stand one space or one line end apart."""
        spaced, out = self.spaced.__getitem__, []
        for line in text.split("\n"):
            words = line.split(" ")
            if BARE.fullmatch(words[0]) is None:
                raise Odd
            out.append(self.known[words[0]] + b"".join(map(spaced, words[1:])))
        return self.line_end.join(out)

    def ids(self, text: str) -> bytes:
        """The ids of a whole text, equal to the library's."""
        if self.whole:
            return self.library([text])[0]
        if self.words_end:
            return b"".join(map(self.known.__getitem__, self._words(text)))
        try:
            return self._lines(text) if text else b""
        except Odd:
            return b"".join(self.encode(self.split(text)))


_held: dict[str, Pieces] = {}


def pieces(path: str, remembered: int = REMEMBERED) -> Pieces:
    """The worker's encoder for this vocabulary: loaded once, kept over batches and tasks."""
    if path not in _held:
        _held[path] = Pieces(path, remembered)
    return _held[path]
