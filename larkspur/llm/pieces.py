"""Cutting text where a byte-level BPE tokenizer cuts in any case, so that each distinct piece is encoded once.

No token of such a tokenizer runs from a non-space character into a following space, and the rule that takes a run of
white space apart looks only at that run and the character after it.  So a text may be cut before any single space
that stands between two non-space characters, and the ids of the text are those of the pieces end to end.
"""

from __future__ import annotations

import gc
import json
import os
import re
import sys
from functools import lru_cache

import numpy as np

#: A space next to other white space: there the cut must look closer.
_ADJACENT = re.compile(r" \s|\s ")
_CUT = re.compile(r"(?<=\S) (?=\S)")

#: Bytes of distinct pieces and their values that a worker remembers; beyond that it keeps those in use.
REMEMBERED = 400 << 20
#: Bytes of a slot of a dictionary, with its share of those left free.
SLOT = 104
#: Pieces that are handed to the library as one text.
JOINED = 1000


@lru_cache(maxsize=4)
def load(path: str):
    """The tokenizers library's tokenizer of a .json file, single-threaded, with its defaults for special strings."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def cuts_at_spaces(path: str) -> bool:
    """True if the file is a byte-level BPE with the usual pre-token rule and no normaliser, so that pieces are exact."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    before = whole.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    stripping = any(x.get("lstrip") or x.get("rstrip") or " " in x["content"] or x.get("single_word") for x in whole.get("added_tokens", []))
    return bool(plain and not stripping and not whole.get("normalizer") and whole["model"]["type"] == "BPE" and not whole.get("truncation"))


def split(text: str) -> list[str]:
    """Words between the cuts; all but the first stand for a piece that begins with the space before them."""
    return _CUT.split(text) if _ADJACENT.search(text) else text.split(" ")


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 as itself, the rest from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Library:
    """Ids of many pieces in few calls: pieces that begin with a space and then a word are encoded as one text.

    The tokens of a byte-level vocabulary are the bytes of the text, so the ids of a piece end where its bytes do.
    """

    def __init__(self, path: str):
        self.tokenizer = load(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        added = self.tokenizer.get_added_tokens_decoder()
        self.size = np.zeros(max([*vocabulary.values(), *added]) + 1, np.int64)
        for shown, i in vocabulary.items():
            self.size[i] = len(shown)
        for i, token in added.items():
            self.size[i] = len(token.content.encode("utf-8"))

    def _coded(self, found: list[str]):
        """Places of the pieces coded together, and the ids of each such group with their numbers by piece; places of the others, and
        their encodings."""
        joint, alone, together = [], [], []
        for k, piece in enumerate(found):
            inner = piece[1:]
            (joint if piece[:1] == " " and inner and not inner[0].isspace() and not inner[-1].isspace() else alone).append(k)
        groups = [[found[k] for k in joint[a : a + JOINED]] for a in range(0, len(joint), JOINED)]
        coded = self.tokenizer.encode_batch_fast(["".join(g) for g in groups] + [found[k] for k in alone], add_special_tokens=False)
        for g, e in zip(groups, coded):
            ids = np.array(e.ids, np.int64)
            ends = np.cumsum([len(piece.encode("utf-8")) for piece in g])
            stops = np.cumsum(self.size[ids])
            last = np.searchsorted(stops, ends)
            assert stops[-1] == ends[-1] and (stops[last] == ends).all()
            together.append((ids, np.diff(last, prepend=-1)))
        return joint, together, alone, coded[len(groups) :]

    def encode(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces end to end, in their order, and the offsets of each piece in them."""
        joint, together, alone, coded = self._coded(found)
        parts = [ids for ids, _ in together] + [np.array(e.ids, np.int64) for e in coded]
        flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        order = np.array(joint + alone, np.int64)
        counts = np.concatenate([*(n for _, n in together), np.array([len(e) for e in coded], np.int64)])
        begins = np.zeros(len(found), np.int64)
        begins[order] = np.cumsum(counts) - counts
        ends = np.zeros(len(found), np.int64)
        ends[order] = np.cumsum(counts)
        return flat, np.stack([begins, ends], 1)

    def counts(self, found: list[str]) -> list[int]:
        """How many ids each piece has."""
        joint, together, alone, coded = self._coded(found)
        counts = np.zeros(len(found), np.int64)
        if joint:
            counts[joint] = np.concatenate([n for _, n in together])
        counts[alone] = [len(e) for e in coded]
        return counts.tolist()


class Memo:
    """Values of pieces, computed for all unknown pieces of a batch at once and remembered up to a bound in bytes.

    ``compute`` takes a list of pieces and returns a value for each.  At the bound, what the batch at hand uses is kept.
    """

    def __init__(self, compute, bound: int = REMEMBERED):
        self.compute, self.bound = compute, bound
        self.first: dict[str, object] = {}
        self.later: dict[str, object] = {}
        self.first_bytes = self.later_bytes = 0

    @staticmethod
    def _bytes(words, values) -> int:
        size = sys.getsizeof
        return SLOT * len(words) + sum(map(size, words)) + sum(map(size, values))

    def learn(self, texts: list[list[str]]) -> list[list]:
        """The values of the words of cut texts, in order."""
        collecting = gc.isenabled()
        gc.disable()  # nothing here is cyclic, and the collector would walk all lists again and again
        try:
            return self._learn(texts)
        finally:
            if collecting:
                gc.enable()

    def _learn(self, texts: list[list[str]]) -> list[list]:
        if self.first_bytes > self.bound // 8:
            self.first, self.first_bytes = {}, 0
        if self.later_bytes > self.bound:
            used = set().union(*texts)
            self.later = {w: self.later[w] for w in used & self.later.keys()}
            self.later_bytes = self._bytes(self.later.keys(), self.later.values())
        known, again = self.later.get, []
        out = [list(map(known, words)) for words in texts]
        for words, values in zip(texts, out):
            values[0] = 0
            if None in values:
                again.append((words, values))
        unknown = {w for words, values in again for w, v in zip(words, values) if v is None}
        opening = {words[0] for words in texts} - self.first.keys()
        firsts, laters = list(opening), list(unknown)
        found = self.compute(firsts + [" " + w for w in laters])
        self.first.update(zip(firsts, found))
        self.later.update(zip(laters, found[len(firsts) :]))
        self.first_bytes += self._bytes(firsts, found[: len(firsts)])
        self.later_bytes += self._bytes(laters, found[len(firsts) :])
        for words, values in again:
            values[:] = [self.later[w] if v is None else v for w, v in zip(words, values)]
        for words, values in zip(texts, out):
            values[0] = self.first[words[0]]
        return out
