import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tests.llm.cases import ROWS, frame, thue_morse
from tickweave.llm import chunk_reuse
from tickweave.llm.chunk_reuse import cut_places, encode
from tickweave.llm.hashing import buffer

PATH = public_tokenizers.path("word_bpe_49k.json")
SPACELESS = "".join(chr(0x4E00 + (i * 7919) % 5000) + ("。" if i % 37 == 0 else "") for i in range(3000))
HARD = [
    "a" * 5000,
    " " * 3000,
    "aaaa " * 900,
    SPACELESS,
    SPACELESS + "x" + SPACELESS,
    "don't we're 'sat ''s 're" * 200,
    "<|endoftext|>" * 300 + "<|startoftext|> a <|ENDOFTEXT|>" * 50,
    "".join(f"ẹ́{i}" for i in range(900)),
    "e" + "́" * 2000 + " tail",
    "각한글".join(str(i) for i in range(800)),
    "!?" * 1500 + "\n" * 1500 + "12345" * 400,
    "ΣΑΣ İI  　x y" * 200,
    "😀👍🏽 é" * 500,
    "\x00﻿" * 600,
]


def plain(rows):
    t = Tokenizer.from_file(PATH)
    out = []
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        out.append((str(i), len(ids), np.array(ids, "<u4").tobytes(), t.decode(ids, skip_special_tokens=False)))
    return sorted(out)


def coded(spark, rows, **kw):
    got = encode(frame(spark, rows), PATH, **kw).collect()
    return sorted((str(r.doc_id), r.n_tokens, bytes(r.ids), r.decoded) for r in got)


@pytest.mark.parametrize(("least", "mean", "block"), [(256, 1024, 6 << 20), (1, 8, 2000), (16, 32, 20_000)])
def test_equal_to_the_library(spark, least, mean, block):
    rows = [*ROWS, *[(100 + i, t) for i, t in enumerate(HARD)]]
    assert coded(spark, rows, block_bytes=block, least=least, mean=mean) == plain(rows)


@pytest.mark.parametrize(("least", "mean"), [(1, 4), (8, 16), (64, 64)])
def test_joins_of_small_chunks(least, mean):
    """Without Spark, so that many cuts can be tried."""
    coder = chunk_reuse.Coder(PATH)
    rng = np.random.default_rng(least)
    signs = list("ab 'sterm<|>\n0é漢。!́") + ["<|endoftext|>", "  ", "'re", "word ", "Hello, "]
    texts = [t for t in HARD if len(t) < 6000]
    texts += ["".join(rng.choice(signs, rng.integers(1, 600))) for _ in range(150)]
    dictionary, first, _ = chunk_reuse._chunks(pa.array(texts), coder.specials, least, mean)
    names = dictionary.dictionary.to_pylist()
    own = chunk_reuse._answers_of(coder, chunk_reuse.WordIds(PATH), names)
    answers = chunk_reuse._answers(pa.RecordBatch.from_arrays(list(own.values()), list(own)))
    codes = dictionary.indices.to_pylist()
    documents = [codes[a:b] for a, b in zip(first[:-1], first[1:])]
    joiner = chunk_reuse.Joiner(coder, answers, documents)
    for text, code in zip(texts, documents):
        want = coder.tokenizer.encode(text, add_special_tokens=False).ids
        assert joiner.ids(code).tolist() == want, text[:80]


def test_shared_passages_are_cut_alike():
    passage = "".join(f"sentence {i} of a passage that two documents share. " for i in range(200))
    data, borders = buffer(pa.array(["first " + passage + " end", "another beginning here " + passage]))
    at = cut_places(data, borders, [])
    text = data.tobytes()
    parts = [text[a:b] for a, b in zip(at[:-1], at[1:])]
    assert len(set(parts)) <= len(parts) * 0.7


def test_empty_table(spark):
    assert encode(frame(spark, []), PATH).count() == 0


def test_chunks_that_a_polynomial_mixes_up(spark):
    rows = list(enumerate([*thue_morse(1024), *thue_morse(4096)]))
    assert coded(spark, rows) == plain(rows)
