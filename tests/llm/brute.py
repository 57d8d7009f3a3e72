"""Plain versions of what the operators compute."""

import re
from collections import defaultdict

from tests.llm.cases import fold

BLANK = re.compile("[\x20\x09-\x0d]+")


def words(text):
    return [w for w in BLANK.split(fold(text)) if w]


def shingles(text):
    w = words(text)
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def components(rows):
    """Smallest linked id of each row; rows are ``(id, text)`` with distinct ids."""
    sets, root = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) > 0:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def gone_lines(rows, least=5):
    """``(id, line)`` of lines that an earlier line resembles; rows are ``(id, text)``."""
    every = []
    for i, text in rows:
        for k, line in enumerate((text or "").split("\n")):
            w = words(line)
            if len(w) >= least:
                every.append(((i is not None, i or 0, k), set(w)))
    return {
        (a[1] if a[0] else None, a[2])
        for a, x in every
        for b, y in every
        if b < a and 5 * len(x & y) >= 4 * len(x | y)
    }


def repeated(texts, length):
    """For each text (bytes) the flags of bytes that a string of ``length`` covers which occurs elsewhere too."""
    count = defaultdict(int)
    for b in texts:
        for i in range(len(b) - length + 1):
            count[b[i : i + length]] += 1
    out = []
    for b in texts:
        flags = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                flags[i : i + length] = b"\1" * length
        out.append(flags)
    return out
