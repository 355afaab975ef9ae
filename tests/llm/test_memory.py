"""What a worker keeps between batches."""

import inspect

from stratalode.llm import tokens


def test_an_encoder_keeps_few_pieces():
    assert inspect.signature(tokens.Encoder).parameters["most"].default <= 200_000  # two generations of 400,000 took over 400 MB
    own = tokens.Encoder(tokens.vocabulary("byte_bpe_50k.json"), most=50)
    for turn in range(20):
        own.encode([f" w{turn}x{n}" for n in range(10)])
        assert len(own.known) <= 50 + 40 and len(own.older) <= 50 + 40
