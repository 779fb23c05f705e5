"""Exact and fast encoding through the installed tokenizer libraries.

A text may be cut at a stable boundary: before a single space between two characters that are not white space.
For byte-level BPE with the usual splitting pattern no match crosses such a place, and none looks back over it, so
that the ids left and right of it do not depend on each other. For a sentencepiece .model it holds where the model is BPE,
doesn't normalise, and has no piece with a space sign behind another character: merges then never cross the place, and those
on one side don't depend on the other's. All of this is checked when a vocabulary is opened; for one that fails, no place
is known to be stable. Pieces between stable boundaries repeat a great deal; each worker keeps the ids of those
seen, in bounded memory, and asks the library for the others.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import chain, islice

import numpy as np

#: Pieces whose ids a worker keeps, and the code points of the longest; others are encoded each time that they come.
KEPT_PIECES, KEPT_LENGTH = 500_000, 64
STABLE = re.compile(r"(?<=\S) (?=\S)")
#: Fixed value: sentencepiece's sign for a space, which means the same in a text.
SPACE_SIGN = "\u2581"
STABLE_MODEL = re.compile(rf"(?<=[^\s{SPACE_SIGN}]) (?=[^\s{SPACE_SIGN}])")
#: White space other than space and line feed; a text that holds any is cut by STABLE.
RARE_SPACE = [chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n"]
RARE_ASCII = [c for c in RARE_SPACE if c.isascii()]


def _fields(raw: bytes) -> dict[int, list]:
    """The fields of a protocol buffer's message by number: integers, and bytes where they have a length."""

    def number(at: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            out, shift, at = out | (raw[at] & 127) << shift, shift + 7, at + 1
            if raw[at - 1] < 128:
                return out, at

    found: dict[int, list] = {}
    at = 0
    while at < len(raw):
        key, at = number(at)
        if key & 7 == 0:
            value, at = number(at)
        else:
            size, at = number(at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = raw[at : at + size], at + size
        found.setdefault(key >> 3, []).append(value)
    return found


def _model_is_stable(piece) -> bool:
    """Whether STABLE_MODEL holds for a sentencepiece model; see above."""
    # Numbers of the fields of a model's settings.
    spec = _fields(piece.serialized_model_proto())
    trainer, normaliser = (_fields(spec.get(k, [b""])[-1]) for k in (2, 3))
    plain = trainer.get(3) == [2] and not trainer.get(24, [0])[-1] and not any(normaliser.get(2, [])) and normaliser.get(5, [1])[-1]
    return bool(plain) and not any(SPACE_SIGN in piece.id_to_piece(i).lstrip(SPACE_SIGN) for i in range(piece.vocab_size()))


class Vocabulary:
    """ids(texts): per text the bytes of its ids as little-endian integers of `width` bytes; counts(texts): how many."""

    def __init__(self, path: str, kept: int = KEPT_PIECES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.path, self.kept, self.memo = path, kept, {}
        if path.endswith(".model"):
            import sentencepiece

            self.piece = sentencepiece.SentencePieceProcessor(model_file=path)
            self.size, self.starts, self.cuttable = self.piece.vocab_size(), None, False
            self.stable = STABLE_MODEL if _model_is_stable(self.piece) else None
        else:
            from tokenizers import Tokenizer

            self.piece, self.library = None, Tokenizer.from_file(path)
            vocabulary = self.library.get_vocab(with_added_tokens=True)
            self.size = max(vocabulary.values()) + 1
            self.starts = np.zeros(self.size, bool)
            self.starts[[i for t, i in vocabulary.items() if t.startswith("Ġ")]] = True
            # Only what is known to cut as described above: byte-level splitting and no normaliser.
            import json

            spec = json.loads(self.library.to_str())
            before = spec.get("pre_tokenizer") or {}
            self.cuttable = spec.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex", False) and not before.get("add_prefix_space", True)
            self.stable = STABLE if self.cuttable else None
        self.width = 2 if self.size <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")

    def plain(self, texts: list[str]) -> list[list[int]]:
        """Straight from the library."""
        if self.piece is not None:
            return self.piece.encode(texts, num_threads=1)
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def offsets(self, text: str) -> np.ndarray:
        """Start offsets of the tokens of a text, in code points."""
        if self.piece is not None:
            return np.array([a for a, _ in self.piece.encode(text, return_type="offset_mapping")["offsets"]], dtype=np.int64)
        return np.array([a for a, _ in self.library.encode(text, add_special_tokens=False).offsets], dtype=np.int64)

    def ids(self, texts: list[str]) -> list[bytes]:
        if not self.cuttable:
            return [np.array(x, self.kind).tobytes() for x in self.plain(texts)]
        cut = [self._pieces(t) for t in texts]
        memo = self.memo
        unknown = set(chain.from_iterable(cut)).difference(memo)
        fresh = self._encode(list(unknown)) if unknown else {}
        memo.update(fresh)
        get = memo.__getitem__
        out = [b"".join(map(get, pieces)) for pieces in cut]
        for piece in [p for p in fresh if len(p if p.__class__ is str else p[0]) > KEPT_LENGTH]:
            del memo[piece], fresh[piece]
        for piece in islice(fresh, max(0, len(memo) - self.kept)):
            del memo[piece]
        return out

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x) // self.width for x in self.ids(texts)]

    @staticmethod
    def _pieces(text: str) -> list:
        """The text cut at every stable space: the first piece in a tuple, the others as strings without the space before them."""
        if not text:
            return []
        odd = "  " in text or " \n" in text or "\n " in text or text[0] == " " or text[-1] == " "
        rare = RARE_ASCII if text.isascii() else RARE_SPACE
        found = STABLE.split(text) if odd or any(c in text for c in rare) else text.split(" ")
        found[0] = (found[0],)
        return found

    def _encode(self, pieces: list) -> dict:
        """Ids of pieces; those that hold no space are put to the library in long runs and told apart by the space before each."""
        easy, rest = [], []
        for p in pieces:
            (easy if p.__class__ is str and " " not in p and not p[-1].isspace() else rest).append(p)
        out = {}
        for at in range(0, len(easy), 4096):
            part = easy[at : at + 4096]
            ids = np.array(self.plain([" " + " ".join(part)])[0], self.kind)
            begins = np.flatnonzero(self.starts[ids])
            if len(begins) != len(part) or begins[0]:
                rest += part
                continue
            raw, ends = ids.tobytes(), [*(begins[1:] * self.width).tolist(), len(ids) * self.width]
            begin = 0
            for p, end in zip(part, ends, strict=True):
                out[p] = raw[begin:end]
                begin = end
        for at in range(0, len(rest), 4096):
            part = rest[at : at + 4096]
            for p, ids in zip(part, self.plain([p[0] if p.__class__ is tuple else " " + p for p in part]), strict=True):
                out[p] = np.array(ids, self.kind).tobytes()
        return out


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """One per worker process, with what it has seen."""
    return Vocabulary(path)


def known(name: str) -> str:
    """A tokenizer's path: a path as it is, a bare name among the public tokenizers installed on the machine."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
