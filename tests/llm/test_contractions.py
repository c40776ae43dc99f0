import numpy as np
import pytest
from tokenizers import Tokenizer

from gleaner.llm.bpe import encoder
from gleaner.llm.queries import RANKS, VOCABULARY

CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


@pytest.mark.parametrize("ranks", [None, RANKS])
def test_every_code_point_before_contractions(ranks):
    """Letters and numbers are those of the library's Unicode, which isn't the one of other packages here."""
    library, own = Tokenizer.from_file(VOCABULARY), encoder(VOCABULARY, ranks)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    # Every code point meets a contraction, those of younger Unicode versions all of them.
    texts = [chr(c) + CONTRACTIONS[c % 7] for c in points[::3 if ranks is None else 40]]
    young = (0x558, 0x58B, 0x88F, 0xC5C, 0xCDC, 0x208F, 0x209D, 0xA7CE, 0xA7F1, 0x10940, 0x11DE0, 0x16EA0, 0x18D80, 0x1E6C0, 0x323B0, 0x3D000)
    texts += [f"x {chr(c + i)}{tail} y" for c in young for i in range(3) for tail in CONTRACTIONS]
    got = [own.encode(text).tolist() for text in texts]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [t for t, a, b in zip(texts, got, want, strict=True) if a != b] == []


def test_random_odd_texts():
    library, own, rng = Tokenizer.from_file(VOCABULARY), encoder(VOCABULARY), np.random.default_rng(8)
    signs = [chr(c) for c in (*range(32, 127), 9, 10, 13, 0x558, 0xC5C, 0x209D, 0xA0, 0x3000, 0x2028, 0x4E2D, 0x1F600, 0xE9, 0x301, 0x200B, 0x11DE0)]
    texts = ["".join(rng.choice(signs, rng.integers(0, 25))) for _ in range(20_000)]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [t for t, b in zip(texts, want, strict=True) if own.encode(t).tolist() != b] == []
