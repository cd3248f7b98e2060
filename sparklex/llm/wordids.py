"""Ids of a public tokenizer, with the ids of words kept once made where it never joins words over white space.

That is so where its file has the normaliser and the splitter given here, and no added token with white space; the whole
texts go through any other tokenizer. Such a tokenizer's ids of a text are the ids of its words, one after the other, so each distinct word of a task is
encoded by the library once (or again, if it left the bounded store of words). Texts are first parted
at ASCII punctuation after an ASCII letter or digit, and ASCII is put in small letters, as the tokenizer does both, too: words that
differ in these only are one. Other words of Latin letters and then punctuation have the ids of the two. Such letters need neither
normalising nor parting: in small letters and as byte symbols they go to the library's model at once. All else goes through the whole tokenizer.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from codecs import charmap_decode
from collections.abc import Callable
from functools import lru_cache

import numpy as np

#: Bytes of texts that are encoded at a time.
ENCODED_BYTES = 2 << 20
#: Words and bytes of a worker's store before it becomes the old one; bytes of objects and of their place there, as measured, beside a word's own.
KEPT_WORDS, KEPT_BYTES, ENTRY_BYTES = 250_000, 40 << 20, 150

#: Precomposed Latin letters (but the one whose small letter is two characters), then ASCII punctuation but the apostrophe (which can begin a contraction).
PARTS = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([!-&(-/:-@\[-`{-~]*)")
#: The punctuation of PARTS.
PUNCTUATION = bytes(b for b in range(0x21, 0x7F) if not chr(b).isalnum() and b != 0x27)
IS_PUNCTUATION, IS_ALPHANUMERIC = (np.isin(np.arange(256), list(x)) for x in (PUNCTUATION, bytes(b for b in range(0x80) if chr(b).isalnum())))

#: Bytes that a byte-level vocabulary writes as the character of that number; the others follow from 256 on.
PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
OTHERS = {b: 256 + k for k, b in enumerate(sorted(set(range(256)).difference(PLAIN)))}
#: The character of each byte.
SYMBOLS = "".join(chr(OTHERS.get(b, b)) for b in range(256))


# The normaliser and the splitter of a tokenizer whose words can be taken one by one.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLITTERS = [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]


def by_words(tokenizer) -> bool:
    """Whether the tokenizer's ids of a text are those of its words, so that they can be made word by word."""
    d = json.loads(tokenizer.to_str())
    plain = (d.get("normalizer") or {}).get("normalizers") == NORMALIZERS and (d.get("pre_tokenizer") or {}).get("pretokenizers") == SPLITTERS
    return plain and d["model"]["type"] == "BPE" and not any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["normalized"] for t in d["added_tokens"])


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """The words' ids of this tokenizer, kept from task to task where Spark uses a worker again."""
    return WordIds(path)


class Known(dict):
    """Words and their ids, packed; ids are made where they are first asked for, or come back from the store before."""

    def __init__(self, make: Callable[[Known, bytes], bytes], old: dict[bytes, bytes]):
        self.make, self.old, self.bytes = make, old, 0

    def __missing__(self, word: bytes) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.make(self, word)
        self[word] = ids
        self.bytes += len(word) + len(ids) + ENTRY_BYTES
        return ids


class WordIds:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.by_words = by_words(self.tokenizer)
        self.added = [t.content.encode().lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        largest = max(self.tokenizer.get_vocab(with_added_tokens=True).values(), default=0)
        self.code = "H" if largest < 1 << 16 else "I"  # of the ids of words
        self.known = Known(self._make, {})

    def encode(self, texts: list[bytes], end_id: int) -> list[np.ndarray]:
        """For each text (UTF-8) its ids and end_id, as little-endian unsigned integers: of 16 bits where those hold all of the vocabulary, else 32."""
        kind = np.dtype("<u2" if self.code == "H" and end_id < 1 << 16 else "<u4")
        end = np.array([end_id], kind).tobytes()
        if not self.by_words:
            every = self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
            return [np.frombuffer(array("H" if kind.itemsize == 2 else "I", e.ids).tobytes() + end, kind) for e in every]
        if len(self.known) > KEPT_WORDS or self.known.bytes > KEPT_BYTES:
            self.known.old = {}
            self.known = Known(self._make, self.known)
        ids = self.known.__getitem__
        if self.code == "H" and kind.itemsize == 4:
            return [np.frombuffer(np.frombuffer(b"".join(map(ids, t.split())), "<u2").astype(kind).tobytes() + end, kind) for t in self._parted(texts)]
        return [np.frombuffer(b"".join(map(ids, t.split())) + end, kind) for t in self._parted(texts)]

    def _parted(self, texts: list[bytes]) -> list[bytes]:
        """The texts with ASCII in small letters and a space before punctuation that follows a letter or digit of ASCII: the ids stay.

        The tokenizer parts its words there, too, and white space has no ids. Left as they are: texts with what may be an
        added token, and letters' case in texts with a mark (U+0300 to U+037F: it may join with a small letter alone).
        """
        lower = [t.lower() for t in texts]
        plain = [not any(a in t for a in self.added) for t in lower]
        taken = [(s if b"\xcc" not in t and b"\xcd" not in t else t) if p else b"" for t, s, p in zip(texts, lower, plain, strict=True)]
        raw = np.frombuffer(b"".join(taken), np.uint8)
        cuts = np.flatnonzero(IS_PUNCTUATION[raw[1:]] & IS_ALPHANUMERIC[raw[:-1]]) + 1
        at = np.cumsum([0, *map(len, taken)])
        at += np.searchsorted(cuts, at)
        whole = np.insert(raw, cuts, 0x20).tobytes()
        return [whole[a:b] if p else t for a, b, p, t in zip(at[:-1].tolist(), at[1:].tolist(), plain, texts, strict=True)]

    def _make(self, known: Known, word: bytes) -> bytes:
        """The ids of a word that isn't known."""
        if word.isalpha():  # of ASCII, as all methods of bytes
            return array(self.code, [t.id for t in self.model.tokenize(word.lower().decode("ascii"))]).tobytes()
        if word.isascii():
            head = word.rstrip(PUNCTUATION)
            if head.isalpha():
                return known[head] + known[word[len(head) :]]
        elif m := PARTS.fullmatch(word.decode("utf-8", "replace")):
            if m[2]:
                return known[m[1].encode()] + known[m[2].encode()]
            return array(self.code, [t.id for t in self.model.tokenize(charmap_decode(m[1].lower().encode(), "strict", SYMBOLS)[0])]).tobytes()
        return array(self.code, self.tokenizer.encode_batch_fast([word.decode("utf-8", "replace")], add_special_tokens=False)[0].ids).tobytes()
