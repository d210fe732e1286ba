"""Token ids of whole texts with a public tokenizer, each distinct word encoded once."""

from __future__ import annotations

import functools
import os
import struct
from collections.abc import Iterable, Iterator

VOCABULARY = "word_bpe_49k.json"
# Words a worker process remembers before it starts afresh.
REMEMBERED = 700_000
# ASCII marks that the tokenizer keeps together and apart from letters before them.
MARKS = b".,;:!?"
# Byte-level vocabularies write bytes that are no printed Latin-1 character as those from 256 on.
_HIDDEN = [b for b in range(256) if b <= 32 or 127 <= b <= 160 or b == 173]
_BYTE_LEVEL = {b: 256 + i for i, b in enumerate(_HIDDEN)}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class WordIds(dict):
    """Packed ids of words, found when first asked for.

    Words of Latin letters are one piece to the tokenizer and unchanged by its
    normaliser once lower-cased, so its model takes them directly; marks behind
    them are another piece. All else goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        # As loaded, for texts with special tokens written out; and for words without any.
        self.loaded = Tokenizer.from_file(path)
        self.special = [a.content.lower().encode() for a in self.loaded.get_added_tokens_decoder().values()]
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model

    def __missing__(self, word: bytes) -> bytes:
        stem = word.rstrip(MARKS)
        letters = _letters(stem)
        if letters and len(stem) < len(word):
            ids = self[stem] + self[word[len(stem) :]]
        elif letters:
            ids = _packed([t.id for t in self.model.tokenize(letters)])
        else:
            whole = self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False)
            ids = _packed(whole.ids)
        self[word] = ids
        return ids


def _letters(word: bytes) -> str | None:
    """A word of Latin letters alone as the model takes it."""
    if word.isalpha():
        return word.decode()
    try:
        text = word.decode().lower()
    except UnicodeDecodeError:
        return None
    if text.isalpha() and max(text) < "\u0250":
        return text.encode().decode("latin-1").translate(_BYTE_LEVEL)
    return None


class WordEncoder:
    """Packed little-endian unsigned 32-bit ids of texts.

    The tokenizer lower-cases, and drops white space before it splits, so the
    ids of a text are those of its words in turn; cutting at ASCII white space
    and lowering A-Z first changes nothing. A text in which a special token is
    written out goes whole through the tokenizer as it was loaded, which makes
    of it what it makes of it.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.known = WordIds(path)
        self.remembered = remembered

    def __call__(self, texts: Iterable[bytes]) -> list[bytes]:
        out = []
        for text in texts:
            if len(self.known) > self.remembered:
                self.known.clear()
            low = text.lower()
            if any(mark in low for mark in self.known.special):
                whole = self.known.loaded.encode(text.decode("utf-8", "replace"), add_special_tokens=False)
                out.append(_packed(whole.ids))
            else:
                out.append(b"".join(map(self.known.__getitem__, low.split())))
        return out


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One per worker process."""
    return WordEncoder(path)


def encode_all(texts: Iterable[bytes], path: str) -> Iterator[bytes]:
    """Packed ids of each text in turn."""
    encode = encoder(path)
    for text in texts:
        yield from encode((text,))
