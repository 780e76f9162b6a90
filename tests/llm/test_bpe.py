import random

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import quillon.llm.bpe as bpe
from quillon.llm.op10_wavelet import WordIds

ODD = ["", " ", "  ", "a  b", " a", "a ", "foo\n bar", "x \n\n y", "it's  don't 'S", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "\ta\tb", "é à ñ Ω ΣΑΣ", "日本語 テスト", "a\x1cb\x1d c", "😀😀 👍🏽", "İstanbul ŁÓDŹ", "a" * 40, "=====----....", "1234567 12 3", "\r\n\r\n x", "ẹ́ x̣́", "x" * 3000]


def _samples():
    r = random.Random(7)
    plain, wide = "ab e'st re\n\t.1é ́Ωß日<|>", "ab'st re.,-19 \néÀßŒ%$"
    return ODD + ["".join(r.choice(a) for _ in range(r.randrange(40))) for a in (plain, wide) for _ in range(400)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encodes_like_the_library(name):
    library, own = Tokenizer.from_file(P.path(name)), bpe.Encoder(P.path(name), generation=50)
    texts = _samples()
    assert own.encode(texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert own.exact_words and own.guessed_words


SCRIPTS = ["Мама мыла раму", "今日は天気がいいですね", "안녕하세요 세계", "שלום עולם", "مرحبا بالعالم ١٢٣", "नमस्ते दुनिया", "ภาษาไทย", "Ελληνικά ΣΑΣ", "𝔘𝔫𝔦 𝟙𝟚", "e\u0301 \u2028 \u3000x", "ﬁ ½ Ⅷ ²", "\u200b a\u200d", "ꙮ ᏣᎳᎩ", "\U0001f469\u200d\U0001f469"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_other_scripts_are_merged_here(name):
    r = random.Random(11)
    alphabet = sorted(set("".join(SCRIPTS)) | set(" ab'st.,1<|>"))
    texts = SCRIPTS + ["".join(r.choice(alphabet) for _ in range(r.randrange(60))) for _ in range(1500)] + ["Ω<|endoftext|>Ж ж"]
    library, own = Tokenizer.from_file(P.path(name)), bpe.Encoder(P.path(name), generation=80, generation_chars=2000)
    assert own.encode(texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert not any(isinstance(x, Tokenizer) for x in vars(own).values())


def test_decodes_like_the_library():
    library, own = Tokenizer.from_file(P.path("byte_bpe_50k.json")), bpe.Encoder(P.path("byte_bpe_50k.json"))
    for text, ids in zip(_samples(), own.encode(_samples()), strict=True):
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False) == text


def test_a_long_text_in_blocks(monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 50)
    library, own = Tokenizer.from_file(P.path("byte_bpe_50k.json")), bpe.Encoder(P.path("byte_bpe_50k.json"))
    for text in _samples():
        assert own.encode([text * 3])[0] == library.encode(text * 3, add_special_tokens=False).ids


def test_marked_words_encode_like_the_library():
    library, own = Tokenizer.from_file(P.path("word_bpe_49k.json")), WordIds(P.path("word_bpe_49k.json"))
    for text in _samples():
        assert own(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_words_known_as_chunks_are_not_merged_again():
    path = P.path("byte_bpe_50k.json")
    library, enc = Tokenizer.from_file(path), bpe.Encoder(path)
    texts = ["an shthore orerre", "an shthore, orerre; (shthore)\n orerre'll <orerre shthore", "Shthore, shthoré, an  shthore."]
    enc.encode(texts[:1])
    seen = enc.exact_words + enc.guessed_words
    assert enc.encode(texts[1:2]) == [library.encode(texts[1], add_special_tokens=False).ids]
    # New: `,` `;` ` (` `shthore` `)` `\n` `'ll` ` <` `orerre`; the words after a space were known.
    assert enc.exact_words + enc.guessed_words - seen <= 9
    for generation in (1, 2, 300_000):
        small = bpe.Encoder(path, generation=generation)
        assert [small.encode([t])[0] for t in texts * 2] == [library.encode(t, add_special_tokens=False).ids for t in texts * 2]
