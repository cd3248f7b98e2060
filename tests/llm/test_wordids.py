"""Ids made word by word are those of the whole tokenizer."""

import random

from sparklex.llm import wordids
from sparklex.llm.queries import tokenizer_path


def test_odd_words_have_the_tokenizers_ids(monkeypatch):
    r = random.Random(1)
    ranges = [(0x20, 0x7F), (0x20, 0x250), (0xC0, 0x250), (0x250, 0x3000), (0x300, 0x310)]
    odd = ["".join(chr(r.randrange(*r.choice(ranges))) for _ in range(r.randrange(1, 8))) for _ in range(6000)]
    pairs = [chr(a) + b for a in range(0x21, 0x260) for b in "a.'é×́"]
    texts = [" ".join(x[i : i + 50]) for x in (odd, pairs) for i in range(0, len(x), 50)]
    texts += ["", " \n ", "don't it's L'été O'Neill's ÉTÉ's x×y ×! İstanbul STRASSE ẞ", "word! " * 5000]
    monkeypatch.setattr(wordids, "KEPT_WORDS", 500)  # the store is emptied on the way
    made = wordids.WordIds(tokenizer_path())
    whole = made.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    for k in range(0, len(texts), 20):
        for got, want in zip(made.encode([t.encode() for t in texts[k : k + 20]], 1), whole[k : k + 20]):
            assert got.tolist() == [*want.ids, 1]


def test_ascii_words_need_no_pattern(monkeypatch):
    """Letters and punctuation of ASCII are parted by the methods of bytes, as PARTS parts them."""
    r = random.Random(2)
    texts = ["".join(chr(r.randrange(0x20, 0x7F)) if r.random() < 0.3 else r.choice("abcXYZ ") for _ in range(200)) for _ in range(100)]
    seen = []
    parts = wordids.PARTS

    class Pattern:
        def fullmatch(self, s):
            seen.append(s)
            return parts.fullmatch(s)

    monkeypatch.setattr(wordids, "PARTS", Pattern())
    made = wordids.WordIds(tokenizer_path())
    whole = made.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    for got, want in zip(made.encode([t.encode() for t in texts], 1), whole):
        assert got.tolist() == [*want.ids, 1]
    assert not [s for s in seen if s.isascii()]


def test_case_and_punctuation_make_no_new_words():
    """The ids of a word of ASCII are made and kept once, whatever its letters' case and the punctuation after it."""
    made = wordids.WordIds(tokenizer_path())
    made.encode([b"Word word WORD word, Word. word?! WORD) x1, X1."], 1)
    assert sorted(made.known) == sorted([b"word", b"x1", b",", b".", b"?!", b")"])


def test_parted_texts_have_the_tokenizers_ids():
    """Marks that join with a small letter alone, contractions, runs of punctuation, what may be an added token; texts of a call are kept apart."""
    r = random.Random(3)
    pieces = ["A", "h", "H", "J", "T", "1", "̱", "̌", "̈", "̧", "̸", "é", "É", "×", "ǆ", "Σ", "İ", "K", "中", ",", ".", "?!", "'", "'S", "'ll", "<", "=", "|>", "-", " ", "\n", " ", " ", "\x00", "\x1c", "_"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randrange(0, 25))) for _ in range(4000)]
    texts += ["a<|endoftext|>b, C<|startoftext|>.", "A<|ENDOFTEXT|>b", "H̱<|endoftext|>", "<|endoftext|", ",", "a", "", ",a", "a", ",", "A,"]
    made = wordids.WordIds(tokenizer_path())
    whole = made.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    for end in (1, 70_000):
        for k in range(0, len(texts), 50):
            for text, got, want in zip(texts[k : k + 50], made.encode([t.encode() for t in texts[k : k + 50]], end), whole[k : k + 50]):
                assert got.tolist() == [*want.ids, end], text
