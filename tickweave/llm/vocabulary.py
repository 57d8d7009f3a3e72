"""Token ids by public tokenizers, word by word."""

from __future__ import annotations

import functools
import itertools
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tickweave.llm.hashing import buffer

#: Words of one call of a tokenizer.
CALL = 4096
#: A to Z to lower case
FOLD_CASE = np.arange(256, dtype=np.uint8)
FOLD_CASE[65:91] += 32


# letters, and the signs that never share a token with a letter before them; | belongs to <|...|>
_LETTER, _SIGN = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_SIGN[[b for b in b"!#$%&'()*+,-./:;=?@" + b'"']] = True


def apart(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fold A to Z and set a space between a letter and a sign after it: fewer distinct words, the same ids.

    A text with the opening of a special token keeps its case, as only the exact string is special.
    """
    if b"<|" not in data.tobytes():
        data = FOLD_CASE[data]
    at = np.flatnonzero(_LETTER[data[:-1]] & _SIGN[data[1:]]) + 1 if len(data) else np.zeros(0, np.int64)
    return np.insert(data, at, 32), borders + np.searchsorted(at, borders, "left")


@functools.cache
def loaded(path: str):
    """The tokenizer of a file, and which of its tokens end a word; loaded once in a worker.

    A tokenizer that has encoded and is dropped leaves about 4.4 MB that the worker never gets
    back, so one for each task would fill a reused worker without bound.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    names = tokenizer.get_vocab(with_added_tokens=True)
    ends = np.zeros(max(names.values()) + 1, bool)
    ends[[i for name, i in names.items() if name.endswith("</w>")]] = True
    return tokenizer, ends


class WordIds:
    """Ids by a tokenizer that drops white space and never joins text across it.

    Such a text's ids are its words' ids in a row, so each distinct word of a batch is
    encoded once and the ids of the texts are gathered. Words seen before are kept, up
    to ``keep`` of them; then the store starts anew. It holds them in a few arrays: a
    reused worker never returns the memory of hundreds of thousands of small objects.
    """

    def __init__(self, path: str, keep: int = 300_000):
        self.keep, (self.tokenizer, self.ends) = keep, loaded(path)
        self.forget()

    def forget(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.sizes, self.flat = np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def encoded(self, words: pa.Array, joined: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Sizes and ids of ``words``, of which ``joined`` are one text; a joined word ends with a word-end token."""
        sizes, flat = [], []
        for i in range(0, len(words), CALL):
            part = words.slice(i, CALL).to_pylist()
            texts = [" ".join(part[k : k + joined]) for k in range(0, len(part), joined)]
            own = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            ids = np.fromiter(itertools.chain.from_iterable(own), np.uint32)
            n = np.fromiter(map(len, own), np.int32, len(own))
            if joined > 1:
                n = np.diff(np.flatnonzero(self.ends[ids]) + 1, prepend=0).astype(np.int32)
            if len(n) != len(part) or n.sum() != len(ids):
                raise ValueError("a word of a to z doesn't end with a word-end token")
            sizes.append(n)
            flat.append(ids)
        return sizes, flat

    def learn(self, words: pa.Array) -> None:
        """Encode and keep words; those of a to z alone are joined, as each of them ends with a word-end token."""
        plain = pc.and_(pc.ascii_is_alpha(words), pc.ascii_is_lower(words))
        one, two = words.filter(plain), words.filter(pc.invert(plain))
        sizes, flat = zip(([self.sizes], [self.flat]), self.encoded(one, 64), self.encoded(two, 1), strict=True)
        self.sizes, self.flat = np.concatenate(sum(sizes, [])), np.concatenate(sum(flat, []))
        self.known = pa.concat_arrays([self.known, one, two])

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row and the borders of the texts; a null text is empty."""
        data, borders = apart(*buffer(texts))
        words = pc.split_pattern(
            pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(borders), pa.py_buffer(data)), " "
        )
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary
        new = distinct.filter(pc.invert(pc.is_in(distinct, value_set=self.known)))
        if len(self.known) + len(new) > self.keep:
            self.forget()
            new = distinct
        self.learn(new)
        place = pc.index_in(distinct, value_set=self.known).to_numpy()
        sizes = self.sizes[place].astype(np.int64)
        first = (np.cumsum(self.sizes, dtype=np.int64) - self.sizes)[place]
        code = coded.indices.to_numpy(zero_copy_only=False)
        counts = sizes[code]
        ends = np.cumsum(counts)
        ids = self.flat[np.repeat(first[code] - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)]
        word_ends = np.r_[0, ends][np.r_[0, np.cumsum(pc.list_value_length(words).to_numpy(zero_copy_only=False))]]
        return ids, word_ends
