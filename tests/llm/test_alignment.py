import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tests.llm.cases import ROWS, frame
from tickweave.llm.alignment import aligned_documents, links_of, slices_of

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
HARD = [
    "<|endoftext|> and <s></s> are plain text",
    "  two  spaces \t tab\n\nlines   ",
    "it's we're don't 'sat on 12 345 a1 b2",
    "▁ is not a space",
    "plain words then ▁ here and more words",
    "漢字かな交じり文。改行\r\nемоjи 😀😀 é é ﬁ",
    "a b c d e",
    " leading",
    "x",
    "\x00 nul and ﻿ bom",
]
FIELDS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups")


def plain(rows):
    """Every document on its own, by whole texts and all pairs of tokens."""
    a_model, b_model = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a_model.encode_special_tokens = True
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    byte = {chr(b): b for b in keep} | {chr(256 + n): b for n, b in enumerate(rest)}
    found, counts = [], Counter()
    for doc, text in rows:
        a = a_model.encode(" " + (text or ""), add_special_tokens=False)
        b = b_model.encode(text or "")
        a_bytes = [bytes(byte[c] for c in t) for t in a.tokens]
        b_names = [b_model.id_to_piece(i) for i in b]
        b_bytes = [
            bytes([int(p[3:5], 16)]) if b_model.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in zip(b, b_names)
        ]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(a_bytes) != whole or b"".join(b_bytes) != whole:
            found.append((doc, [], [], [], []))
            continue
        spans = []
        for parts in (a_bytes, b_bytes):
            at, own = 0, []
            for p in parts:
                own.append((at, at + len(p)))
                at += len(p)
            spans.append(own)
        links = [
            (x, y)
            for i, x in enumerate(a.ids)
            for j, y in enumerate(b)
            if spans[0][i][0] < spans[1][j][1] and spans[1][j][0] < spans[0][i][1]
        ]
        ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, start = [], 0
        for end in ends:
            inside = [
                ",".join(str(i) for i, (_, e) in zip(ids, own) if start < e <= end)
                for ids, own in ((a.ids, spans[0]), (b, spans[1]))
            ]
            groups.append("|".join(inside))
            start = end
        found.append((doc, a.ids, b, links, groups))
        counts.update(links)
    top = Counter()
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    out = []
    for doc, a, b, links, groups in found:
        text = ";".join(groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        best = sum(counts[k] == top[k[1]] for k in links)
        out.append((str(doc), len(a), len(b), len(groups), len(links), best, sum(counts[k] for k in links), digest, text))
    return sorted(out)


@pytest.mark.parametrize("block_bytes", [4 << 20, 100])
def test_equal_to_all_pairs_of_tokens(spark, block_bytes):
    rows = [(i, t if t is None or len(t) < 5000 else t[:3000]) for i, t in ROWS]
    rows += [(100 + i, t) for i, t in enumerate(HARD)]
    got = aligned_documents(frame(spark, rows), BYTES, PIECES, block_bytes=block_bytes).collect()
    assert sorted((str(r.doc_id), *[r[f] for f in FIELDS]) for r in got) == plain(rows)


def test_groups_and_links_of_a_slice():
    a, b = np.array([2, 5, 7, 8]), np.array([3, 5, 8])
    common, a_to, b_to = slices_of(a, b)
    assert (common.tolist(), a_to, b_to) == ([5, 8], [2, 4], [2, 3])
    _, i, j = links_of(a, b)
    assert list(zip(i, j)) == [(0, 0), (1, 0), (1, 1), (2, 2), (3, 2)]


def test_long_text_and_empty_table(spark):
    text = "word and more words 漢字 " * 20_000
    (row,) = aligned_documents(frame(spark, [(1, text)]), BYTES, PIECES, with_groups=False).collect()
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert row.n_b == len(model.encode(text)) and row.n_links == row.n_a + row.n_b - row.n_groups
    assert aligned_documents(frame(spark, []), BYTES, PIECES).count() == 0
