"""Byte-level BPE by the tokenizers library, with a bounded cache of pieces.

Texts are cut where no match of the pattern can cross, so that equal pieces are encoded
once; the library encodes each new piece. The cut stands before a blank that follows a
character that is no white space: every alternative of the pattern that takes such a blank
takes it as its first character, and looks only ahead.
"""

from __future__ import annotations

import base64
import ctypes
import gc
import json
import os
from array import array
from struct import pack

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer, models, pre_tokenizers

#: Pieces kept for each Python worker; at most about 200 MB.
CACHE_PIECES = 600_000
#: Longer pieces are encoded anew each time.
CACHE_CHARS = 48
LONG_WORD = 2000
_LOOSE = regex.compile(r"[\s\0] |\0")


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a file of base64 token and rank per line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def tokenizer_of_ranks(ranks: dict[bytes, int]) -> Tokenizer:
    """A tokenizers BPE that merges as ranks do.

    Every way to halve a token into two tokens becomes a merge; merges stand in the order
    of the rank of what they make. A piece that is a token itself is taken whole.
    """
    chars = byte_chars()
    shown = {token: "".join(chars[b] for b in token) for token in ranks}
    merges = []
    for token in sorted(ranks, key=ranks.__getitem__):
        halves = [(token[:at], token[at:]) for at in range(1, len(token))]
        halves = [(a, b) for a, b in halves if a in ranks and b in ranks]
        halves.sort(key=lambda pair: (ranks[pair[0]], ranks[pair[1]]))
        merges += [(shown[a], shown[b]) for a, b in halves]
    made = Tokenizer(models.BPE(vocab={shown[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    made.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return made


#: Tasks share the cores already.
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


class PieceEncoder:
    """Encodes texts to little-endian unsigned 32-bit ids.

    A piece is kept under its characters without the blank it begins with; the piece that
    begins a text has no blank and is kept under a NUL and its characters.
    specials: strings that the tokenizer takes as one token wherever they stand; a text that
    holds one goes to the library whole.
    """

    def __init__(self, tokenizer: Tokenizer, pattern: str, specials: tuple[str, ...] = ()):
        self.tokenizer, self.specials = tokenizer, specials
        self.tokenize, self.shown = tokenizer.model.tokenize, dict(enumerate(byte_chars()))
        self.matches = regex.compile(pattern).findall
        self.pieces: dict[str, bytes] = {"\0": b""}

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of words that are one match of the pattern each, by the tokenizer's model."""
        tokenize, shown = self.tokenize, self.shown
        collecting = gc.isenabled()
        gc.disable()  # many small objects, no cycles
        try:
            out = []
            for word in words:
                ids = [t.id for t in tokenize(word.encode().decode("latin-1").translate(shown))]
                out.append(pack("<%dI" % len(ids), *ids))
            return out
        finally:
            if collecting:
                gc.enable()

    def _learn(self, missing: list[str]) -> dict[str, bytes]:
        """The ids of pieces that aren't kept; keeps those there is room for."""
        whole, several = [], {}
        for piece in missing:
            if piece.isalpha():
                whole.append(piece)
            else:
                several[piece] = self.matches(piece[1:] if piece[:1] == "\0" else " " + piece)
        words = [" " + piece for piece in whole]
        parts = {w for own in several.values() for w in own}
        parts.difference_update(words)
        words += parts
        ids = dict(zip(words, self._encode_words(words), strict=True))
        learned = {piece: ids[" " + piece] for piece in whole}
        for piece, own in several.items():
            learned[piece] = b"".join([ids[w] for w in own])
        return learned

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; a null text has none."""
        pieces, out, later, missing = self.pieces, [], [], set()
        get = pieces.get
        for row, text in enumerate(texts):
            if not text:
                out.append(b"")
            elif any(s in text for s in self.specials):
                out.append(np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes())
            elif _LOOSE.search(text):
                words = self.matches(text)
                out.append(b"".join(self._encode_words(words)))
            else:
                own = text.split(" ")
                own[0] = "\0" + own[0]
                got = list(map(get, own))
                if None in got:
                    missing.update([p for p, ids in zip(own, got, strict=True) if ids is None])
                    later.append((row, own, got))
                    out.append(b"")
                else:
                    out.append(b"".join(got))
        if missing:
            learned = self._learn(list(missing))
            if len(pieces) + len(learned) > CACHE_PIECES and 4 * len(learned) > sum(len(own) for _, own, _ in later):
                pieces.clear()  # what is kept is of little use here
                pieces["\0"] = b""
            if len(pieces) + len(learned) <= CACHE_PIECES:
                pieces.update((p, ids) for p, ids in learned.items() if len(p) <= CACHE_CHARS)
            for row, own, got in later:
                out[row] = b"".join([learned[p] if ids is None else ids for p, ids in zip(own, got, strict=True)])
        return out


def merges_by_rank(tokenizer: Tokenizer, specials: tuple[str, ...]) -> bool:
    """Whether the ids of a byte-level BPE follow the order of its merges, as tiktoken takes them to.

    The bytes must come first; every other token must be made by one merge, and later merges must make
    larger ids. Then the pair that the library merges next is the one with the smallest id.
    """
    model = json.loads(tokenizer.to_str())["model"]
    vocabulary = {token: number for token, number in model["vocab"].items() if token not in specials}
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    made = [vocabulary.get(a + b) for a, b in pairs]
    singles = [number for token, number in vocabulary.items() if len(token) == 1]
    if len(singles) != 256 or None in made or len(made) + 256 != len(vocabulary):
        return False
    return all(a < b for a, b in zip([max(singles), *made[:-1]], made, strict=True))


class RankEncoder:
    """The ids that a tokenizers file of a byte-level BPE gives, by tiktoken's merges.

    The vocabulary goes over as ranks, which is right where merges_by_rank() holds. The tokenizers library itself takes texts that hold its special tokens, which it
    recognises, and those of very long words, on which tiktoken's time grows with the square.
    """

    def __init__(self, tokenizer: Tokenizer, pattern: str, specials: tuple[str, ...] = ()):
        byte_of = {c: b for b, c in enumerate(byte_chars())}
        vocabulary = tokenizer.get_vocab(with_added_tokens=False)
        ranks = {bytes(map(byte_of.__getitem__, token)): number for token, number in vocabulary.items() if token not in specials}
        self.tokenizer, self.specials = tokenizer, specials
        self.core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, little-endian unsigned 32-bit; a null text has none."""
        out = []
        for text in texts:
            if not text:
                out.append(b"")
                continue
            words = list(map(len, text.split()))
            gaps = len(text) - sum(words)
            if any(s in text for s in self.specials) or max(words, default=0) > LONG_WORD or gaps > 4 * len(words) + LONG_WORD:
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            else:
                ids = self.core.encode_ordinary(text)
            out.append(np.asarray(array("I", ids)).astype("<u4", copy=False).tobytes())
        return out


def _specials(tokenizer: Tokenizer) -> tuple[str, ...]:
    return tuple(t.content for t in tokenizer.get_added_tokens_decoder().values())


def load_json(path: str, pattern: str) -> PieceEncoder:
    """An encoder from a tokenizers file of a byte-level BPE without normaliser or prefix."""
    tokenizer = Tokenizer.from_file(path)
    return PieceEncoder(tokenizer, pattern, _specials(tokenizer))


def load_json_ranks(path: str, pattern: str) -> RankEncoder | PieceEncoder:
    """The same ids as load_json gives, for long runs over much text; by ranks only where these are the merges' order."""
    tokenizer = Tokenizer.from_file(path)
    specials = _specials(tokenizer)
    kind = RankEncoder if merges_by_rank(tokenizer, specials) else PieceEncoder
    _trim()
    return kind(tokenizer, pattern, specials)


def _trim() -> None:
    """Gives memory that is free again back to the system, where the C library can: workers live long."""
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def load_ranks(path: str, pattern: str) -> tuple[PieceEncoder, dict[bytes, int]]:
    ranks = read_ranks(path)
    return PieceEncoder(tokenizer_of_ranks(ranks), pattern), ranks
