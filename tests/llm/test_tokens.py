import public_tokenizers
import pytest
import sentencepiece

from tests.llm.cases import ROWS, frame
from tickweave.llm.tokens import token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")
HARD = ["a" * 5000, " " * 3000, "aaaa " * 900, "漢字😀▁ x" * 400, "\n" * 2000, "<s></s><unk>" * 50]


@pytest.mark.parametrize(("chunk", "overlap"), [(32_768, 256), (300, 20), (64, 4)])
def test_counts_are_those_of_the_library(spark, chunk, overlap):
    rows = [*ROWS, *[(100 + i, t) for i, t in enumerate(HARD)]]
    got = token_counts(frame(spark, rows), PATH, chunk=chunk, overlap=overlap).collect()
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    want = sorted((str(i), len((t or "").encode()), len(model.encode(t or ""))) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 4096) for r in got)


def test_empty_table(spark):
    assert token_counts(frame(spark, []), PATH).count() == 0
