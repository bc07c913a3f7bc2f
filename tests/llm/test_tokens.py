"""Remembered units give the ids of the whole text."""

import pytest

from tomefold.llm import tokens

TRICKY = ["", " ", "\n", "a", " a", "a ", "a  b c", "a\tb  c \n\n d<|endoftext|> x", "It's we'll\n 'tis", "x\n\ny", "\rx y",
          "é é ́x ΑΣ ΣΑΣ. ́", "漢字 ½ x² ü ß\nNext line. And", "a <|endoftext|>", "one two one two\none two"]


@pytest.mark.parametrize("name,blanks", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
@pytest.mark.parametrize("memo", [5, 100_000])
def test_ids_equal_plain_encoding(documents, monkeypatch, name, blanks, memo):
    monkeypatch.setattr(tokens, "MEMO_UNITS", memo)
    enc = tokens.Encoder(tokens.default_path(name), blanks)
    texts = TRICKY + [r.text for r in documents.select("text").collect()]
    for _ in range(2):  # cold and warm
        assert enc.ids(texts) == [enc.plain(t) if t else b"" for t in texts]
    assert enc.ids([None]) == [b""]


FILES = pytest.mark.parametrize("name,blanks", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
TAILED = ["don't we'll, it's' o'ree x's.\nIt's", "a1b2 c33, 4d 5", "abc漢字, ab½ ab² abµ. ª, aº!", "İ. Iİ, İstanbul, iİ's", "é́, é́. ǰ, ß%%% œuvre, Œ.",
          "x<|endoftext|>y z<|endoftext|> <|endoftext|>,", "a,\nb.\nc a, b. c", "mail.a@b-c.de +1 (668) a/b a_b __a ~a a~", "ΑΣ, aΣ. ab.ΑΣ",
          "a\x85b a\u3000b", "a \rb, \r c", "a-\u0301 a.\u0301b"]


@FILES
def test_ids_of_tailed_units(name, blanks):
    enc = tokens.Encoder(tokens.default_path(name), blanks)
    for texts in (TAILED, TAILED[::-1], [" ".join(TAILED[:7])], ["".join(t.split(",")[0]) + "," for t in TAILED]):
        assert enc.ids(texts) == [enc.plain(t) for t in texts]


@FILES
def test_known_letters_and_tail_are_not_encoded_again(name, blanks):
    enc = tokens.Encoder(tokens.default_path(name), blanks)
    asked, real = [], enc.tokenizer

    class Asked:
        def encode(self, text, **kw):
            asked.append(text)
            return real.encode(text, **kw)

        def encode_batch_fast(self, texts, **kw):
            asked.extend(texts)
            return real.encode_batch_fast(texts, **kw)

    enc.tokenizer = Asked()
    enc.ids(["first alpha beta gamma alpha, beta. gamma%%%"])
    asked.clear()
    new = ["first beta, alpha. gamma, beta%%%"]
    got = enc.ids(new)
    assert asked == []
    assert got == [enc.plain(new[0])]


@FILES
def test_units_whose_bytes_do_not_tell_are_encoded_alone(name, blanks):
    enc = tokens.Encoder(tokens.default_path(name), blanks)
    if blanks:
        enc.n_bytes = enc.n_bytes + 1
    texts = ["one two,\nthree one", "two"]
    assert enc.ids(texts) == [enc.plain(t) for t in texts]
