import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.cases import ROWS, frame
from tickweave.llm.packing import differencing, full_windows, pack, powers, whole_windows

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_differencing_is_near_equal():
    sizes = np.random.default_rng(1).integers(1, 4000, 400)
    windows = differencing(sizes, 60)
    assert sorted(i for w in windows for i in w) == list(range(400))
    sums = [sizes[w].sum() for w in windows]
    assert max(sums) - min(sums) < 0.05 * np.mean(sums)


def test_window_count_rises_when_capacity_is_exceeded():
    sizes = np.array([3, 3, 3])
    assert len(whole_windows(sizes, 5)) == 3
    assert all(sum(n for _, _, n in w) <= 5 for w in whole_windows(sizes, 5))


def test_cut_windows_are_full():
    sizes = np.random.default_rng(2).integers(1, 4096, 300)
    made, over = full_windows(sizes, 4096)
    assert all(sum(n for _, _, n in w) == 4096 for w in made)
    assert sum(n for _, _, n in over) == sizes.sum() % 4096
    cells = np.concatenate([np.arange(s, s + n) + 10_000 * i for w in [*made, over] for i, s, n in w])
    assert len(np.unique(cells)) == len(cells) == sizes.sum()
    assert sorted(sum(n for _, _, n in w) for w in powers([(0, 0, 7), (1, 3, 6)])) == [1, 4, 8]


@pytest.mark.parametrize("cut", [True, False])
def test_every_id_lies_in_one_piece(spark, cut):
    got = pack(frame(spark), PATH, 2, window=256, block=5, cut=cut).collect()
    encode = Tokenizer.from_file(PATH)
    want = sorted((str(i), tuple([*encode.encode(t or "", add_special_tokens=False).ids, 2])) for i, t in ROWS)
    docs, seqs = {}, {}
    for r in got:
        ids = np.frombuffer(bytes(r.ids), "<u4")
        assert len(ids) == r.length and zlib.crc32(bytes(r.ids)) == r.ids_crc32
        docs.setdefault((str(r.doc_id), r.doc_tokens), []).append((r.start, ids))
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 256
        assert not cut or at & (at - 1) == 0
    # repeated ids can't be told apart here, so their ids are compared as a whole
    total = sum(r.length for r in got)
    assert total == sum(len(ids) for _, ids in want)
    for i, ids in want:
        if i not in ("2", "None"):
            parts = sorted(docs[i, len(ids)], key=lambda p: p[0])
            assert tuple(np.concatenate([p for _, p in parts]).tolist()) == ids


def test_special_strings_and_spaces(spark):
    texts = ["a <|endoftext|> b", "x<|ENDOFTEXT|>y, it's 12.5!    Z", "a　b\tc\n\nd", "é É."]
    got = pack(frame(spark, list(enumerate(texts))), PATH, 2, window=4096).collect()
    encode = Tokenizer.from_file(PATH)
    for i, text in enumerate(texts):
        parts = sorted((r.start, bytes(r.ids)) for r in got if r.doc_id == i)
        ids = np.frombuffer(b"".join(p for _, p in parts), "<u4").tolist()
        assert ids == [*encode.encode(text, add_special_tokens=False).ids, 2]


def test_empty_table(spark):
    assert pack(frame(spark, []), PATH, 2).count() == 0
