"""What packing and token counts share: a word's pre-tokens, and what a worker
keeps of words.

The word-level BPE vocabulary splits at white space before anything else, and
its added tokens hold none, so the tokens of a text are those of its
white-space words in order and a word's result can be kept."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from itertools import chain

VOCABULARY = "word_bpe_49k.json"
CACHE_WORDS = 900_000  # words kept by a worker process; it starts anew when they are more


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level BPE:
    printable Latin-1 bytes stand for themselves, the others for the
    characters from 256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class PreTokens:
    """Splits a word as the tokenizer file says: added tokens, normalising,
    pre-tokens."""

    #: Printable ASCII and Latin-1 letters: their lower case is one character
    #: each, they are composed already, and the file's pattern reads as below.
    LATIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
    LOWER = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
    BYTES = dict(enumerate(byte_symbols()))

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            self.spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.normal = self.library.normalizer.normalize_str
        self.split = self.library.pre_tokenizer.pre_tokenize_str
        self.special = {t["content"]: t["id"] for t in self.spec["added_tokens"]}
        self.added = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")

    def __call__(self, word: str) -> list[str | int]:
        """Pre-tokens in byte-level characters; added tokens as their ids."""
        if "<|" in word:
            parts = [p for p in self.added.split(word) if p]
            return list(chain.from_iterable([self.special[p]] if p in self.special else self.plain(p) for p in parts))
        return self.plain(word)

    def plain(self, word: str) -> list[str]:
        if self.LATIN.fullmatch(word):
            word = word.lower()
            if word.isascii():
                return [word] if word.isalpha() else self.LOWER.findall(word)
            return [p if p.isascii() else p.encode().decode("latin-1").translate(self.BYTES) for p in self.LOWER.findall(word)]
        return [t for t, _ in self.split(self.normal(word))]


def words_of(text: bytes) -> list[bytes]:
    """White-space words. The file lowers case, so A-Z is lowered first (fewer
    distinct words) unless the text may hold an added token, whose case counts."""
    return (text if b"<|" in text else text.lower()).split()


class KeptWords(dict):
    """Word -> result, by a function of a list of words."""

    def __init__(self, results: Callable[[list[str]], list]):
        super().__init__()
        self.results = results

    def learn(self, words: set[bytes]) -> None:
        if len(self) + len(words) > CACHE_WORDS:
            self.clear()
        new = [w for w in words if w not in self]
        self.update(zip(new, self.results([w.decode() for w in new])))
