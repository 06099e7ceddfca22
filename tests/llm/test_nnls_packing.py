import struct
import zlib
from collections import Counter, defaultdict
from itertools import combinations, product

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from driftwatch.llm import nnls_packing

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def check(out, want_ids, capacity):
    """``out`` holds every id of every document once, in gapless sequences without padding."""
    bins, parts = defaultdict(list), defaultdict(list)
    for r in out:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        parts[r["doc_id"]].append((r["start"], r["length"], r["ids"], r["doc_tokens"]))
        assert r["length"] >= 1 and len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at == capacity or at < capacity and at & (at - 1) == 0
    want = defaultdict(list)
    for key, ids in want_ids:
        want[key].append(ids)
    assert set(parts) == set(want)
    for key, docs in want.items():
        got = Counter((start, ids) for start, _, ids, _ in parts[key])
        if len(docs) == 1:
            whole = docs[0]
            at = 0
            for start, length, ids, n in sorted(parts[key]):
                assert start == at and n == len(whole)
                assert ids == struct.pack(f"<{length}I", *whole[start:start + length])
                at += length
            assert at == len(whole)
        else:  # rows that share an id
            assert sum(len(ids) for _, ids in got.elements()) == 4 * sum(map(len, docs))
            assert Counter(struct.unpack(f"<{sum(map(len, docs))}I", b"".join(ids for _, ids in got.elements()))) == Counter(x for d in docs for x in d)


@pytest.mark.parametrize("capacity, group_items", [(64, 40), (2048, 50_000), (100, 7)])
def test_every_id_once_and_no_padding(docs, corpus, capacity, group_items):
    out = nnls_packing.pack(docs, VOCABULARY, 1, capacity, with_ids=True, group_items=group_items).collect()
    tokenizer = Tokenizer.from_file(VOCABULARY)
    check(out, [(i, [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in corpus], capacity)


def test_empty_table(empty):
    assert nnls_packing.pack(empty, VOCABULARY).count() == 0


def test_third_of_rows_is_one_row(spark):
    rows = [(7, "same text again")] * 100 + [(i, "word " * (i % 50)) for i in range(200)]
    out = nnls_packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), VOCABULARY, capacity=32, group_items=30)
    of = {r["doc_id"]: r["c"] for r in out.groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "c").collect()}
    tokenizer = Tokenizer.from_file(VOCABULARY)
    assert of[7] == 100 * (len(tokenizer.encode("same text again", add_special_tokens=False).ids) + 1) + 8


def test_combinations_are_all_shallow_ones():
    a = nnls_packing.combinations(12)
    got = {tuple(c) for c in a.T.astype(int).tolist()}
    want = set()
    for n in range(1, 13):
        for bins in _partitions(12, n):
            count = Counter(bins)
            if any(sum(k for b, k in count.items()) - k <= 2 for _, k in count.items()):
                want.add(tuple(count.get(b, 0) for b in range(13)))
    assert got == want


def _partitions(total, parts, least=1):
    if parts == 1:
        return [(total,)] if total >= least else []
    return [(x, *rest) for x in range(least, total // parts + 1) for rest in _partitions(total - x, parts - 1, x)]


def test_nnls_equals_all_supports_tried():
    rng = np.random.default_rng(3)
    for _ in range(30):
        a, b = rng.integers(0, 4, (5, 6)).astype(float), rng.normal(size=5) * 5
        best = b @ b
        for size in range(1, 6):
            for at in combinations(range(6), size):
                x = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
                if (x >= -1e-12).all():
                    best = min(best, ((a[:, at] @ x - b) ** 2).sum())
        x = nnls_packing.nnls(a, b, rounds=200)
        assert (x >= 0).all() and ((a @ x - b) ** 2).sum() == pytest.approx(best, abs=1e-6)


def test_few_cuts():
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 2048, 8000)
    out = nnls_packing.pack_group(sizes, 2048)
    covered = [np.zeros(n, int) for n in sizes]
    for i, begin, n in (x for s in out for x in s):
        covered[i][begin:begin + n] += 1
    assert all((c == 1).all() for c in covered)
    assert sum(len(s) for s in out) <= 1.3 * len(sizes)
    assert all(sum(n for _, _, n in s) == 2048 for s in out[:-11])


def test_shapes_of_groups():
    for sizes in product((1, 3, 700, 2047), repeat=3):
        out = nnls_packing.pack_group(np.array(sizes), 2048)
        assert sum(n for s in out for _, _, n in s) == sum(sizes)
