"""Byte-pair encoding and token files against the tokenizers library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidewire.llm import bpe, token_files

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts():
    r = random.Random(1)
    odd = ["", "  ", "Héllo <|endoftext|>World's aaa aaaaaaa", "\x1c a\x1fb \x85c d", "ΑΣ ΣΑΣ İstanbul é é ́x 日本語 123 ١٢ don't I'LL ’s", "a​b", "<|startoftext|><|endoftext|>", "x" * 5000, None]
    pick = lambda: chr(r.choice([r.randrange(32, 127), r.randrange(0, 0x300), r.randrange(0x300, 0xD7FF), r.randrange(0xE000, 0x1FFFF)]))
    return odd + ["".join(pick() for _ in range(60)) for _ in range(200)]


def test_ids_and_decoding(library):
    encoder = bpe.WordBpe(PATH)
    for text, entries in zip(texts(), encoder.encode_texts(texts()), strict=True):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(b"".join(e[1] for e in entries), "<u4").tolist() == ids
        assert b" ".join(e[3] for e in entries).decode() == library.decode(ids, skip_special_tokens=False)
        assert encoder.decode(ids).decode() == library.decode(ids, skip_special_tokens=False)


def test_forgotten_pieces_are_encoded_again(library, monkeypatch):
    from tidewire.llm import pieces

    monkeypatch.setattr(pieces, "GROUP_CHARS", 40)
    encoder = bpe.WordBpe(PATH)
    encoder.cache.generation = 3
    sample = ["one two three four five", "six seven eight nine one", "two three ten one six"] * 3
    got = [np.frombuffer(b"".join(e[1] for e in entries), "<u4").tolist() for entries in encoder.encode_texts(sample)]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in sample]


def test_encode_frame(spark, library, odd, empty):
    rows = bpe.encode(odd, PATH).collect()
    assert all(r.ids == library.encode(r.text or "", add_special_tokens=False).ids and r.n_tokens == len(r.ids) for r in rows)
    assert bpe.encode(empty, PATH).count() == 0


def test_elias_fano():
    r = np.random.default_rng(4)
    for n in (1, 2, 65, 1000):
        values = np.sort(r.integers(0, 50 * n, n))
        values[0] = 0
        coded = token_files.EliasFano.of(values)
        assert coded.values().tolist() == values.tolist()
        assert [coded.select(i) for i in range(n)] == values.tolist()
        assert len(coded.low) + len(coded.high) <= n * (3 + np.log2(values[-1] / n + 2)) / 8 + 2


@pytest.mark.parametrize("block", [1 << 20, 50])
def test_files_round_trip(spark, library, odd, tmp_path, block):
    folder = str(tmp_path / "files")
    token_files.write_token_files(odd, PATH, folder, block_ids=block)
    rows = sorted(odd.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
    ids = [[*library.encode(r.text or "", add_special_tokens=False).ids, 2] for r in rows]
    starts = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).tolist()
    want = sorted((str(r.doc_id), s, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for r, s, i in zip(rows, starts, ids))
    assert sorted((str(r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_boundaries(spark, folder).collect()) == want


def test_empty_files(spark, empty, tmp_path):
    token_files.write_token_files(empty, PATH, str(tmp_path / "f"))
    assert token_files.read_boundaries(spark, str(tmp_path / "f")).count() == 0
