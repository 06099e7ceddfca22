"""Substring dedups against brute force, in blocks of several sizes and with the treatment of hot anchors forced."""
import hashlib
import random

import numpy as np
import pytest

from driftwatch.llm import fm_dedup, repeats, suffix_dedup
from driftwatch.llm.hashing import U64, mix
from tests.llm.conftest import words

LAST = 1 << 63


def brute(rows, units, window):
    items = sorted(((LAST if i is None else i, i, units(t)) for i, t in rows), key=lambda r: r[0])
    least = {}
    for order, _, u in items:
        for s in range(len(u) - window + 1):
            key = tuple(u[s:s + window])
            least[key] = min(order, least.get(key, order))
    out = []
    for order, i, u in items:
        gone = [False] * len(u)
        for s in range(len(u) - window + 1):
            if least[tuple(u[s:s + window])] < order:
                gone[s:s + window] = [True] * window
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(u), sum(gone), spans, [x for x, g in zip(u, gone) if not g]))
    return out


def key(r):
    return (r[0] is None, r[0] or 0, *r[1:4], bytes(r[4]))


@pytest.mark.parametrize("block_bytes,hot", [(1 << 20, 1 << 16), (9000, 1 << 16), (9000, 1)])
def test_bytes(docs, corpus, block_bytes, hot):
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["kept"]))
           for r in suffix_dedup.dedup(docs, block_bytes=block_bytes, hot=hot).collect()]
    want = [(*r[:4], bytes(r[4])) for r in brute(corpus, lambda t: list((t or "").encode()), 50)]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert any(r[2] for r in got)


@pytest.mark.parametrize("block_bytes,hot", [(1 << 20, 1 << 16), (9000, 1 << 16), (9000, 1)])
def test_words(docs, corpus, block_bytes, hot):
    got = [(r["doc_id"], r["n_words"], r["n_removed"], len(r["spans"]), bytes(r["kept"]))
           for r in fm_dedup.dedup(docs, block_bytes=block_bytes, hot=hot).collect()]
    want = [(*r[:4], " ".join(r[4]).encode()) for r in brute(corpus, words, 13)]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_empty(empty):
    assert suffix_dedup.dedup(empty).collect() == []
    assert fm_dedup.dedup(empty).collect() == []


@pytest.mark.parametrize("in_memory", [32 << 20, 0])
def test_collection_order(monkeypatch, in_memory):
    monkeypatch.setattr(suffix_dedup, "IN_MEMORY", in_memory)
    rng = random.Random(3)
    strings = [bytes(rng.choices(b"abc", k=rng.randint(1, 9))) for _ in range(60)] + [b"aaaa"] * 3 + [b"abcabcabc"] * 2
    size = np.array([len(s) for s in strings])
    string, length, common = suffix_dedup.collection_order(np.frombuffer(b"".join(strings), np.uint8), np.cumsum(size) - size, size, 50)
    want = sorted((s[len(s) - j:], i, j) for i, s in enumerate(strings) for j in range(len(s) + 1))
    assert list(zip(string.tolist(), length.tolist())) == [(i, j) for _, i, j in want]
    agree = lambda a, b: next((n for n in range(min(len(a), len(b))) if a[n] != b[n]), min(len(a), len(b)))
    assert common.tolist() == [0, *(agree(a[0], b[0]) for a, b in zip(want, want[1:]))]


def _text(keys, i):
    return hashlib.sha1(int(keys[i]).to_bytes(8, "little")).hexdigest() + f"{i:012d}"


def _replies(keys, index):
    """What the bucket of these anchor hashes says of fragments with 3 different windows each: (number, least id) per run."""
    n = len(keys)
    texts = [_text(keys, i).encode() for i in range(n)]
    block = {"bucket": [0], "block": [0], "number": [np.arange(n, dtype="<i4")], "size": [np.full(n, 52, "<i4")],
             "part": [(mix(keys) >> U64(32)).astype("<u4")], "windows": [np.full(n, 3, "<i2")], "least": [np.arange(n, dtype="<i8") + 100],
             "data": [np.frombuffer(b"".join(texts), np.uint8)]}
    table = repeats._table({f: [repeats._pack(x) if isinstance(x, np.ndarray) else x for x in v] for f, v in block.items()}, repeats.FRAGMENTS)
    out = repeats._answer(repeats.Kind(words=False, window=50, gram=20), index)((0,), table)
    return [(int(a), int(b)) for a, b in zip(repeats._join(out.column("number"), "<i4"), repeats._join(out.column("least"), "<i8"))]


def test_parts_are_even_and_hold_only_shared_anchors(monkeypatch):
    """Anchors are the least hashes of their windows, so they are small: parts must not follow their top bits. A fragment
    whose anchor no other fragment has needs no index."""
    monkeypatch.setattr(repeats, "PART", 100)
    pairs = np.repeat(np.arange(1, 1001, dtype="<u8") << U64(20), 2)  # 1,000 anchors of two fragments, all in the lowest 2^-26 of the hashes
    alone = np.arange(5001, 8001, dtype="<u8") << U64(20)
    sizes = []

    def index(data, start, size, windows, ids):
        sizes.append(len(ids))
        return suffix_dedup.smallest_ids(data, start, size, windows, ids)

    keys = np.concatenate([pairs, alone])
    got = _replies(keys, index)
    assert sum(sizes) == len(pairs)
    assert len(sizes) == 20 and max(sizes) < 200
    want = {}
    for i in range(len(keys)):  # by brute force: two fragments with one anchor agree in some of their windows
        for w in range(3):
            want.setdefault(_text(keys, i)[w:w + 50], i + 100)
    runs = []
    for i in range(len(keys)):
        ids = [want[_text(keys, i)[w:w + 50]] for w in range(3)]
        runs += [(i, x) for k, x in enumerate(ids) if k == 0 or x != ids[k - 1]]
    assert sorted(got) == sorted(runs)


def test_backward_search():
    rng = random.Random(5)
    text = np.array([*(rng.randint(1, 4) for _ in range(300)), 0])
    index = fm_dedup.FMIndex(text, 8)
    for _ in range(200):
        p = np.array([rng.randint(1, 4) for _ in range(rng.randint(1, 7))])
        low, high = index.first(p[-1:])
        for c in p[-2::-1]:
            low, high = index.extend(np.array([c]), low, high)
        assert int(high[0] - low[0]) == sum((text[i:i + len(p)] == p).all() for i in range(len(text) - len(p) + 1))
