"""Each text is encoded whole by both tokenizers, and its ids are decoded."""

import public_tokenizers
import pytest

from quillrank.llm import piece_codec

TEXTS = ["", " ", "a b", "two  blanks", "  x", "x  ", "a▁b", "▁", "Ünïcode 漢字 😀\n\ttab", "a b", "́ b " * 40, "nul\0 <unk> <s>"]


@pytest.fixture
def codec():
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return piece_codec.Codec(f.read(), 1)


class Spied:
    """The original library, but for given texts another id at the end."""

    def __init__(self, original, other=()):
        self.original, self.other, self.seen = original, set(other), []

    def encode(self, texts, **options):
        self.seen += texts
        return [ids + [5] if t in self.other else ids for t, ids in zip(texts, self.original.encode(texts, **options))]


def test_every_text_is_encoded_whole_and_decoded(codec, monkeypatch):
    library = codec.original
    codec.original = spied = Spied(library)
    decode, shown = codec.decode, []
    monkeypatch.setattr(codec, "decode", lambda ids: shown.extend(ids) or decode(ids))
    for _ in range(2):
        ids, parity, back = codec.encode(TEXTS)
        assert ids == [library.encode(t) for t in TEXTS] and all(parity)
        assert back == [library.decode(i) == t for i, t in zip(ids, TEXTS)]
    # A second time too: nothing known of a text or its words takes the place of the work.
    assert spied.seen == TEXTS * 2 and shown == ids * 2


def test_texts_that_only_differ_as_a_whole_are_found(codec):
    library = codec.original
    codec.encode(TEXTS)
    other = ["a b", " ", "two  blanks"]
    codec.original = Spied(library, other)
    ids, parity, back = codec.encode(TEXTS)
    assert parity == [t not in other for t in TEXTS]
    assert ids == [library.encode(t) + [5] * (t in other) for t in TEXTS]
    assert back == [t not in other and "▁" not in t for t in TEXTS]


def test_decoding_equals_the_rebuilt_tokenizer(codec):
    rows = [codec.original.encode(t) for t in TEXTS] + [[], [0], [1, 2], [1, 300, 2]]
    rows += [[b, 400, b] for b in range(3, 259)] + [[3 + 0xE4, 3 + 0xBD, 2, 3 + 0xA0], [3 + 0xC3, 500]]
    assert codec.decode(rows) == [codec.fast.decode([i for i in row if i not in codec.controls]) for row in rows]
