"""The coder's models and a row's ids stay small beside the other memory of an executor."""

import tracemalloc

import numpy as np

from tallyproof.llm.token_codec import decode_blocks, encode_blocks


def test_models_of_many_blocks_are_bounded():
    blocks = list(np.random.default_rng(3).zipf(1.3, (3072, 8)).clip(max=49_000).astype(np.uint32))
    tracemalloc.start()
    payloads = encode_blocks(blocks)
    back = decode_blocks(payloads, np.full(len(blocks), 8))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all(np.array_equal(a, b) for a, b in zip(blocks, back))
    assert peak < 100e6
