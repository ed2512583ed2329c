"""Parts of words are given to the model alone; their ids must be those of the whole tokenizer."""

import public_tokenizers

from arborlake.llm import packing


def test_parts_as_the_tokenizer_gives_them():
    words = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    assert words.model is not None
    encode = words.tokenizer.encode
    texts = [f"{c}Ab {c}{c} x{c}9 x{c}" for c in map(chr, range(0x250))]
    texts += ["It's  WE'LL naïve Straße ÀÉÎ 12.5% $$$", "<|endoftext|> a<|b|>", "Привет, 世界 é ﬁ", ""]
    for text in texts:
        want = encode(text, add_special_tokens=False).ids
        assert words.ids(text) == packing.np.array(want, dtype="<u4").tobytes(), text


def test_no_new_part_goes_through_the_whole_tokenizer(monkeypatch):
    words = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    monkeypatch.setattr(words, "_encode", None)  # a call would fail
    assert len(words.ids("Zyxqw plain Über-Worte, 42!")) % 4 == 0


def test_ascii_words_take_the_short_way(monkeypatch):
    words = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"))
    monkeypatch.setattr(packing, "_PRETOKEN", None)  # a use would fail
    for text in ("It's WE'LL x_y 42nd http://A.b/c?d=E&f=1 a\x01b\x7f!? 'twas''s", *(f"a{a}{b}Z" for a in map(chr, range(33, 127)) for b in "a'7!")):
        want = words.tokenizer.encode(text, add_special_tokens=False).ids
        assert words.ids(text) == packing.np.array(want, dtype="<u4").tobytes(), text
