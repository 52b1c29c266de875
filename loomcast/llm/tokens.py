"""Whole texts through a public tokenizer inside Arrow jobs.

A byte-level or word-end BPE never merges across certain cuts, so a text's ids are
the ids of its pieces.  Pieces recur, the library's answer for each is kept in the
worker, in a table of bounded size.  Texts whose cuts are not certain, and texts that may
hold the string of an added token, go to the library whole.

Most texts hold blanks, line ends and Latin letters that normalization only lower-cases.  They are cut where the
vocabulary's own pre-tokenizer cuts them: stems recur more often than words with their capitals and punctuation, and go to
the library without the steps that would leave them as they are.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

_KEPT = 250_000  # answers of one generation; a table holds two

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"  # composed, and with one lower-case letter each
_EASY = re.compile(f"[ \n!-~{_LETTERS}]*")  # texts that normalization only lower-cases


class Recent(dict):
    """Answers by piece.  A full table becomes the old one; what is asked for again comes back from there."""

    def __init__(self, size: int):
        self.size, self.old = size, {}

    def missing(self, pieces: set[str]) -> list[str]:
        """Pieces without an answer; the others are in the table from here until the next call."""
        if len(self) > self.size:
            self.old = dict(self)
            self.clear()
        new = list(pieces.difference(self))
        if not self.old:
            return new
        found = [p for p in new if p in self.old]
        self.update(zip(found, map(self.old.__getitem__, found)))
        return [p for p in new if p not in self.old]


# fixed value: where the library's byte-level step cuts
_BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?[\p{L}]+| ?[\p{N}]+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def stem_cutter(path: str):
    """(Function of an easy text: its pieces; tokenizer of one piece), if the vocabulary's steps are of a known kind."""
    from tokenizers import Tokenizer, pre_tokenizers

    with open(path, encoding="utf-8") as f:
        steps = json.load(f)
    norm, pre = steps["normalizer"], steps["pre_tokenizer"] or {}
    parts = pre.get("pretokenizers", [pre])
    bytes_ = parts[-1]
    if bytes_.get("type") != "ByteLevel" or bytes_["add_prefix_space"] or bytes_["use_regex"] != (len(parts) == 1):
        return None
    lower = norm is not None
    if lower and [{k: v for k, v in x.items() if k != "content"} for x in norm.get("normalizers", [])] != [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}}, {"type": "Lowercase"}
    ]:
        return None
    pattern = _BYTE_LEVEL
    if len(parts) > 1:
        pattern = parts[0].get("pattern", {}).get("Regex")
        known = re.fullmatch(r"(?:'[a-z]+\||\[(?:\^\\s)?(?:\\p\{[LN]\})+\]\+?\|?)+", pattern or "")
        if len(parts) > 2 or not known or (parts[0]["behavior"], parts[0]["invert"]) != ("Removed", True):
            return None
    bare = Tokenizer.from_file(path)
    bare.normalizer = None
    bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    find = re.compile(pattern.replace(r"\p{L}", _LETTERS).replace(r"\p{N}", "0-9")).findall
    return (lambda text: find(text.lower())) if lower else find, bare


def regular(text: str) -> bool:
    """Blanks and line ends only, one at a time, none at either end."""
    words = text.split()
    gaps = len(words) - 1
    return sum(map(len, words)) + gaps == len(text) and text.count(" ") + text.count("\n") == gaps


class PieceEncoder:
    """Text to ids as little-endian unsigned 32-bit bytes.

    `spaced` vocabularies (byte-level) give a leading blank to the word behind it and
    have tokens for line ends; the others drop blanks.
    """

    def __init__(self, path: str, spaced: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        shared = os.path.commonprefix(added)
        self.marks = [shared] if shared else added  # no added token lies in a text without a mark
        self.spaced = spaced
        self.bare = Recent(_KEPT)  # words at the start of a line, and all words without spacing
        self.tail = Recent(_KEPT)  # words behind a blank
        self.stems = Recent(_KEPT)
        self.cutter = stem_cutter(path)
        self.line_end = self._encode(["\n"])[0] if spaced else b""

    def _encode(self, pieces: list[str], tokenizer=None) -> list[bytes]:
        found = (tokenizer or self.tokenizer).encode_batch_fast(pieces, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _learn(self, known: Recent, words: set[str], lead: str = "", tokenizer=None) -> None:
        new = known.missing(words)
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            known.update(zip(part, self._encode([lead + w for w in part] if lead else part, tokenizer)))

    def __call__(self, texts: list[str]) -> list[bytes]:
        easy = [self.cutter is not None and _EASY.fullmatch(t) is not None and not self._marked(t) for t in texts]
        others = [t for t, ok in zip(texts, easy) if not ok]
        rest = iter((self._spaced if self.spaced else self._plain)(others) if others else ())
        if len(others) == len(texts):
            return list(rest)
        cut, bare = self.cutter
        stems = [cut(t) for t, ok in zip(texts, easy) if ok]
        self._learn(self.stems, set().union(*stems), tokenizer=bare)
        known = iter([b"".join(map(self.stems.__getitem__, s)) for s in stems])
        return [next(known) if ok else next(rest) for ok in easy]

    def _marked(self, text: str) -> bool:
        return any(m in text for m in self.marks)

    def _plain(self, texts: list[str]) -> list[bytes]:
        # other white space stays inside its piece and is left to the library
        cut = lambda t: t.split() if regular(t) else [w for w in t.replace("\n", " ").split(" ") if w]
        words = [None if self._marked(t) else cut(t) for t in texts]
        self._learn(self.bare, set().union(*filter(None, words)))
        whole = iter(self._encode([t for t, ws in zip(texts, words) if ws is None]))
        return [next(whole) if ws is None else b"".join(map(self.bare.__getitem__, ws)) for ws in words]

    def _spaced(self, texts: list[str]) -> list[bytes]:
        lines = [[line.split(" ") for line in t.split("\n")] if t and regular(t) and not self._marked(t) else None for t in texts]
        self._learn(self.bare, {line[0] for ls in lines if ls for line in ls})
        self._learn(self.tail, set().union(*[line[1:] for ls in lines if ls for line in ls]), " ")
        whole = iter(self._encode([t for t, ls in zip(texts, lines) if ls is None]))
        bare, tail = self.bare, self.tail.__getitem__
        return [
            next(whole) if ls is None else self.line_end.join([bare[x[0]] + b"".join(map(tail, x[1:])) for x in ls])
            for ls in lines
        ]


@lru_cache(maxsize=4)
def encoder(path: str, spaced: bool) -> PieceEncoder:
    return PieceEncoder(path, spaced)
