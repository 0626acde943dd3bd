"""What the byte-level BPE encoder remembers: tokens for good, other pieces for two generations, the encoder from task to task."""

from __future__ import annotations

import base64

import pytest

from clickloom.llm import byte_bpe


@pytest.fixture
def vocabulary(tmp_path):
    tokens = [bytes([i]) for i in range(256)] + [b"ab", b"cd"]
    path = tmp_path / "ranks"
    path.write_text("".join(f"{base64.b64encode(t).decode()} {i}\n" for i, t in enumerate(tokens)))
    return byte_bpe.load(str(path), r"\S+")


def test_pieces_in_use_are_not_merged_again(vocabulary):
    encoder, merged = byte_bpe.Encoder(vocabulary, cached_pieces=8), []
    plain = encoder.merge
    encoder.pieces.merge = lambda piece: (merged.append(piece), plain(piece))[1]
    for i in range(40):
        encoder.encode(f"abcd ab cd x{i:02}")
    assert merged.count(b"abcd") == 1 and b"ab" not in merged and len(merged) == 41
    assert len(encoder.pieces) - len(encoder.pieces.whole) <= 4 and len(encoder.pieces.older) <= 4
    assert encoder.encode("abcd \xe9") == encoder.encode("abcd") + encoder.encode("\xe9") and len(encoder.encode("\xe9")) == 8


def test_an_encoder_is_kept_from_task_to_task(vocabulary):
    first = byte_bpe._encoder("one", tuple(vocabulary))
    assert byte_bpe._encoder("one", tuple(vocabulary)) is first
    assert byte_bpe._encoder("two", tuple(vocabulary)) is not first
    assert len(byte_bpe._ready) == 1
