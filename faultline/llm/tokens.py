"""Encoding of whole texts with a public tokenizer file, by looking up pre-tokens in a bounded cache."""
from __future__ import annotations

import ctypes
import json
import os
import re
from array import array

WORDS, LONGEST = 250_000, 48                       # entries of each cache; characters of an entry
HELD, RESTING, ENTRY = 32 << 20, 4 << 20, 150      # bytes of each cache during a task and between tasks; bytes an entry costs besides its own
#: The pre-tokens of the word tokenizer's file, written out for characters up to U+00FF.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACE = "\t\n\x0b\x0c\r \x85\xa0"
LETTERS = "a-zªµºß-öø-ÿ"
NUMBERS = "0-9²³¹¼-¾"
PRE_TOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^{SPACE}{LETTERS}{NUMBERS}]+")
#: Byte-level alphabet: visible bytes stand for themselves, the others for characters from U+0100 on.
VISIBLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
ALPHABET = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in VISIBLE)}


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    For a tokenizer whose pre-tokens never span white space, a text's ids are those of its pre-tokens one after the other.
    Texts of characters up to U+00FF are cut into pre-tokens here and only new ones reach the model; other texts are cut
    at blanks and their new runs encoded as they stand. Strings of special tokens are ordinary text.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"               # Spark runs a task on each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            steps = (json.load(f).get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.plain = [x["type"] for x in steps] == ["Split", "ByteLevel"] and steps[0]["pattern"].get("Regex") == SPLIT
        self.model = self.tokenizer.model
        self.words: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}
        self.cost = {id(self.words): 0, id(self.runs): 0}

    def rest(self) -> None:
        """At the end of a task: most of what is cached goes, and the memory with it."""
        for cache in (self.words, self.runs):
            self._shrink(cache, RESTING, WORDS)
        give_back()

    def _shrink(self, cache: dict[str, bytes], most: int, entries: int) -> None:
        """The oldest entries go until the cache has at most ``entries`` and costs at most ``most`` bytes."""
        cost = self.cost[id(cache)]
        gone = []
        for k, v in cache.items():
            if cost <= most and len(cache) - len(gone) <= entries:
                break
            cost -= ENTRY + len(k) + len(v)
            gone.append(k)
        for k in gone:
            del cache[k]
        self.cost[id(cache)] = cost

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            if self.plain and narrow(text):
                out.append(self._looked_up(PRE_TOKEN.findall(text.lower()), self.words, self._word))
            else:
                out.append(self._looked_up(text.replace("\n", " ").replace("\t", " ").split(" "), self.runs, self._run))
        return out

    def _looked_up(self, parts: list[str], known: dict[str, bytes], learn) -> bytes:
        ids = list(map(known.get, parts))
        if None in ids:
            for i, x in enumerate(ids):
                if x is None:
                    part = parts[i]
                    x = ids[i] = known.get(part) or learn(part)
                    if len(part) <= LONGEST and part not in known:
                        known[part] = x
                        self.cost[id(known)] += ENTRY + len(part) + len(x)
            if self.cost[id(known)] > HELD or len(known) > WORDS:
                self._shrink(known, HELD // 2, WORDS // 2)
        return b"".join(ids)

    def _word(self, word: str) -> bytes:
        seen = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(ALPHABET)
        return array("I", [t.id for t in self.model.tokenize(seen)]).tobytes()

    def _run(self, run: str) -> bytes:
        return array("I", self.tokenizer.encode(run, add_special_tokens=False).ids).tobytes()


def narrow(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def give_back() -> None:
    """Free memory goes back to the system, so that a worker that waits for its next task is small."""
    if hasattr(ctypes.CDLL(None), "malloc_trim"):
        ctypes.CDLL(None).malloc_trim(0)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
