"""Parts of pieces that are encoded once."""

import struct

from tidewell.llm import bpe
from tidewell.llm.queries import vocabulary


def test_words_at_line_ends_and_starts_are_encoded_once():
    from tokenizers import Tokenizer

    with open(vocabulary(), "rb") as f:
        encoder = bpe.Encoder(bpe.Vocabulary(f.read()))
    asked, merged = [], encoder.encode_word
    encoder.encode_word = lambda word: asked.append(word) or merged(word)
    ends, starts = [f"end{c}" for c in "abcdefgh"], [f"Start{c}" for c in "abcdefgh"]
    text = "".join(f" {a}{m}\n{b}$$$ {a}" for a in ends for b in starts for m in (".", "?!", ""))
    ids = Tokenizer.from_file(vocabulary()).encode(text, add_special_tokens=False).ids
    assert encoder.encode(text) == struct.pack(f"<{len(ids)}I", *ids)
    assert sorted(asked) == sorted({*(f" {a}" for a in ends), *starts, ".", "?!", "$$$"})
