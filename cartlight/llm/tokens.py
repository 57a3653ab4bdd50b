"""Word caches over a public byte-pair tokenizer, for use inside tasks."""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache
from itertools import chain

import regex
import tiktoken
from tokenizers import Tokenizer

# Characters whose class (letter, number, space, other), case and normal form are the same in Python and in the
# tokenizer library: Latin-1 but for four control characters, more Latin and general punctuation. A piece of text with
# any other goes to the library whole. U+0130 lower-cases to two characters.
_CONTROLS = "\x1c\x1d\x1e\x1f"
_OTHER = re.compile("[^\x00-\x1b\x20-\u012f\u0131-\u024f\u2010-\u2027\u2030-\u205e\u20ac]")
# Longer pieces are cut up by an iterator instead of a list of all their words.
_LONG = 1 << 20
# Remembered words per worker beside the broadcast ones, remembered pre-tokens, and their greatest length.
_CACHE, _PARTS, _CACHED_CHARS = 1 << 18, 1 << 15, 64
# Characters of a pre-token from which the library's model encodes it, whatever the vocabulary.
_LONG_PART = 2048

# Both vocabularies part words at white space at least. One keeps white space: a single blank belongs to the word after
# it, longer white space stands alone but for its last character. The other drops it.
_WORDS = {"ByteLevel": re.compile(r" ?\S+|\s+(?!\S)|\s+"), "Split": re.compile(r"\S+")}

# How the two vocabularies cut a word into pre-tokens.
_PRETOKENS = {
    "ByteLevel": regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"),
    "Split": regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"),
}
# The character that stands for a byte in both vocabularies: printable Latin-1 for itself, the others from 256 on.
_PRINTED = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_STANDS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}
_BYTE = {chr(_STANDS.get(b, b)): b for b in range(256)}
# The byte that stands for the end of a word, where a vocabulary marks it; UTF-8 has no such byte.
_END = b"\xff"


# Usual characters that are no letters: numbers stand alone, others in runs. ASCII ones, with Latin-1, all.
_QUICK = [chr(c) for a, b in ((0, 28), (32, 256), (256, 592), (0x2010, 0x2028), (0x2030, 0x205F), (0x20AC, 0x20AD)) for c in range(a, b)]
_NUMBERS = [c for c in _QUICK if regex.match(r"\p{N}", c)]
_OTHERS = [c for c in _QUICK if regex.match(r"[^\s\p{L}\p{N}]", c)]
_ALONE = [([c for c in _NUMBERS if c < end], [c for c in _OTHERS if c < end]) for end in ("\x80", "\u0100", "\uffff")]
_CONTRACTION = re.compile(r"'(?<![^\w ]')(?<!_')(s|t|re|ve|m|ll|d)")


def _parted(words: list[str]) -> str:
    """The pre-tokens of lower-cased words of quick characters under the ``Split`` rule, a blank after each, maybe more.

    The same as that rule's pattern, but by a few replacements of the whole text. Control characters, which no quick
    text holds, stand for the ends of a character of a run and for an apostrophe that begins a contraction.
    """
    text = " ".join(words) + " "
    if "'" in text:
        text = _CONTRACTION.sub(" \x1c\\1 ", text)
    numbers, others = _ALONE[0 if text.isascii() else 1 if max(text) < "\u0100" else 2]
    for c in numbers:
        if c in text:
            text = text.replace(c, f" {c} ")
    for c in others:
        if c in text:
            text = text.replace(c, f"\x1d{c}\x1e")
    return text.replace("\x1e\x1d", "").replace("\x1d", " ").replace("\x1e", " ").replace("\x1c", "'")


def _usual(text: str) -> bool:
    if any(c in text for c in _CONTROLS):
        return False
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return not _OTHER.search(text)
    return True


def _ranks(model: dict, end: bytes) -> dict[bytes, int] | None:
    """Ids of the tokens' bytes, with ``end`` where a token ends a word and the vocabulary marks that.

    Merging the pair of lowest id is quicker than the library's model. That is the same where every merge makes a token
    of a higher id than the merges before it, all bytes are tokens and nothing else is set; elsewhere there is None.
    """
    vocabulary, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
    merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    if suffix:
        merges = [m.replace(suffix, "") + (suffix if m.endswith(suffix) else "") for m in merges]
    made = [vocabulary.get(m, -1) for m in merges]
    odd = any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
    if odd or any(a >= b for a, b in zip([2 * 256 - 1 if suffix else 255, *made], made)):
        return None
    ranks = {}
    for token, id_ in vocabulary.items():
        body = token.removesuffix(suffix) if suffix else token
        if body and all(c in _BYTE for c in body):
            ranks[bytes(_BYTE[c] for c in body) + (end if body != token else b"")] = id_
    tail = end if suffix else b""
    if any(bytes([b]) not in ranks or bytes([b]) + tail not in ranks for b in range(256)):
        return None
    return ranks


def _by_rank(model: dict) -> Callable[[bytes], list[int]] | None:
    """Ids of a pre-token's bytes, where the vocabulary has ranks."""
    ranks = _ranks(model, _END)
    if ranks is None:
        return None
    tail = _END if model.get("end_of_word_suffix") else b""
    piece = tiktoken.Encoding("ranks", pat_str=".+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
    return (lambda part: piece(part + tail)) if tail else piece


def _by_text(model: dict) -> Callable[[str], bytes] | None:
    """Ids, as ``as_bytes`` gives them, of pre-tokens with a blank after each, where the vocabulary marks ends of words.

    The blank stands for that mark. It is in no pre-token, so the tokens that hold a true one are left out.
    """
    ranks = _ranks(model, _END)
    if ranks is None or not model.get("end_of_word_suffix"):
        return None
    ranks = {token.replace(_END, b" "): id_ for token, id_ in ranks.items() if b" " not in token}
    encoding = tiktoken.Encoding("text", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})
    return lambda text: encoding.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


def as_bytes(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit numbers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoder(dict):
    """Maps a word to what ``value`` makes of its ids; words known beforehand stay, misses are remembered.

    Gives the ids that the library gives: text is cut at special strings, then into words at white space, and a word's
    ids depend on nothing else. A word is cut into pre-tokens, which the library's model encodes. Pieces with unusual
    characters are encoded by the library as a whole.
    """

    def __init__(self, spec: str, value: Callable[[list[int]], object], remembered: int = _CACHE):
        super().__init__()
        self._spec, told = spec, json.loads(spec)
        self._special_ids = {t["content"]: t["id"] for t in told["added_tokens"]}
        special = "|".join(map(re.escape, self._special_ids))
        self._special = re.compile(f"({special})") if special else None
        splitter = told["pre_tokenizer"]
        if splitter["type"] == "Sequence":
            splitter = splitter["pretokenizers"][0]
        self._words, self._pretokens = _WORDS[splitter["type"]], _PRETOKENS[splitter["type"]]
        self._plain = splitter["type"] == "Split"
        self._lower = any(n["type"] == "Lowercase" for n in (told["normalizer"] or {}).get("normalizers", []))
        self._ranked = _by_rank(told["model"])
        self._value, self._known, self._parts, self._remembered = value, {}, {}, remembered

    @cached_property
    def library(self) -> Tokenizer:
        """The library's tokenizer, made where a text first asks for it: most texts do not."""
        made = Tokenizer.from_str(self._spec)
        made.no_truncation()
        made.no_padding()
        return made

    def know(self, words: dict) -> None:
        """Take over words with their values; they stay when the remembered ones go."""
        self._known = words
        self.update(words)

    @cached_property
    def _text_bytes(self) -> Callable[[str], bytes] | None:
        return _by_text(json.loads(self._spec)["model"]) if self._plain else None

    def ids(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _part_ids(self, part: str) -> list[int]:
        if self._ranked and len(part) < _LONG_PART:
            return self._ranked(part.encode())
        if not (part.isascii() and part.isprintable() and " " not in part):
            part = part.encode().decode("latin-1").translate(_STANDS)
        return [token.id for token in self.library.model.tokenize(part)]

    def word_ids(self, word: str) -> list[int]:
        letters = word if self._plain or word[0] != " " else word[1:]
        if letters.isalpha() and letters.isascii():  # a pre-token as it is
            return self._part_ids(word)
        ids: list[int] = []
        for part in self._pretokens.findall(word):
            found = self._parts.get(part)
            if found is None:
                found = self._part_ids(part)
                if len(part) <= _CACHED_CHARS:
                    if len(self._parts) >= _PARTS:
                        self._parts.clear()
                    self._parts[part] = found
            ids += found
        return ids

    def __missing__(self, word: str):
        made = self._value(self.word_ids(word))
        if len(word) <= _CACHED_CHARS:
            if len(self) >= len(self._known) + self._remembered:
                self.clear()
                self.update(self._known)
            self[word] = made
        return made

    def segments(self, text: str) -> Iterator[tuple[str, object]]:
        """('words', iterable of words) or ('ids', ids) for the parts of a text, in order."""
        parts = self._special.split(text) if self._special else [text]
        for k, part in enumerate(parts):
            if k % 2:
                yield "ids", [self._special_ids[part]]
            elif not _usual(part):
                yield "ids", self.ids(part)
            elif part:
                part = part.lower() if self._lower else part
                if len(part) >= _LONG:
                    yield "words", (m.group() for m in self._words.finditer(part))
                else:
                    yield "words", part.split() if self._plain else self._words.findall(part)

    def values(self, text: str) -> Iterator:
        """What ``value`` makes of the text's ids, part by part."""
        of_word, value = self.__getitem__, self._value
        return chain.from_iterable(
            map(of_word, part) if kind == "words" else (value(part),) for kind, part in self.segments(text))

    def id_bytes(self, text: str) -> bytes:
        """The text's ids as ``as_bytes`` gives them, which ``value`` must be.

        Where the vocabulary allows it, all words are merged in one call, which is quicker than remembering them when
        many are rare; else they are looked up.
        """
        quick, found = self._text_bytes, []
        for kind, part in self.segments(text):
            if kind == "ids":
                found.append(self._value(part))
            elif quick and isinstance(part, list) and (len(text) < _LONG_PART or max(map(len, part), default=0) < _LONG_PART):
                found.append(quick(_parted(part)))
            else:
                found.extend(map(self.__getitem__, part))
        return b"".join(found)


@lru_cache(maxsize=4)
def worker_encoder(spec: str, value: Callable[[list[int]], object], remembered: int = _CACHE) -> Encoder:
    """The encoder of this worker process: what it has remembered serves all its tasks."""
    return Encoder(spec, value, remembered)
