"""An id costs one step of the coder, and blocks share what the row's table tells."""

import numpy as np
import pytest

from tallyproof.llm import token_codec as tc


def test_an_id_is_one_step(monkeypatch):
    steps, mix = [], tc._Model.mix
    monkeypatch.setattr(tc._Model, "mix", lambda self, *a: steps.append(1) or mix(self, *a))
    blocks = list(np.random.default_rng(5).integers(0, 49_000, (6, 50)))
    payloads = tc.encode_blocks(blocks)
    steps.clear()
    assert all(np.array_equal(a, b) for a, b in zip(blocks, tc.decode_blocks(payloads, [50] * 6)))
    assert len(steps) == 50
    assert np.array_equal(tc.decode_blocks([payloads[3], payloads[-1]], [50])[0], blocks[3])


def test_distinct_pieces_go_through_the_library_once(monkeypatch):
    pytest.importorskip("tokenizers")
    pytest.importorskip("public_tokenizers")
    from tallyproof.llm.token_file import IdEncoder
    from tallyproof.llm.tokens import vocabulary_path

    encoder, texts = IdEncoder(vocabulary_path("word_bpe_49k.json")), []
    odd = "Überzahl Überzahl, ÜBERZAHL. überzahl... it's 'sun' İst, a1b! ΟΔΟΣ. $$$ don't' 5."
    whole = encoder._encode([odd])[0]
    encode = encoder._encode
    monkeypatch.setattr(encoder, "_encode", lambda t: texts.extend(t) or encode(t))
    assert encoder.ids(odd) == whole
    assert " ".join(texts).lower().count("berzahl") == 1
