import re
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tests.llm.cases import ROWS
from tickweave.llm.shared import give_back
from tickweave.llm.vocabulary import WordIds

PATH = public_tokenizers.path("word_bpe_49k.json")


def held():
    """Megabytes of this process that no file backs."""
    give_back()
    return int(re.search(r"\nAnonymous:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024


def made_up(n, seed):
    rng = np.random.default_rng(seed)
    parts = np.array(["on", "ing", "he", "re", "nt", "bl", "eau", "qu"])
    return [" ".join("".join(parts[w]) for w in rng.integers(0, 8, (64, 5))) for _ in range(n)]


@pytest.mark.parametrize("keep", [1, 50, 300_000])
def test_ids_are_the_tokenizers_whatever_is_kept(keep):
    texts = [*[t for _, t in ROWS], *made_up(5, 1), "", "a", "Z", "x  y", "12.5 o'clock's <|endoftext|>!"]
    encode, whole = WordIds(PATH, keep), Tokenizer.from_file(PATH)
    for part in (texts, texts[::-1], texts[:3], [None]):
        ids, ends = encode(pa.array(part, pa.string()))
        want = [whole.encode(t or "", add_special_tokens=False).ids for t in part]
        assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)] == want


def test_tasks_of_a_reused_worker_leave_no_memory():
    texts = pa.array(made_up(200, 2), pa.string())
    WordIds(PATH)(texts)
    before = held()
    for _ in range(8):
        WordIds(PATH)(texts)
    assert held() - before < 16
