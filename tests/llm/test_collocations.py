import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from driftwatch.llm import collocations
from driftwatch.llm.hashing import U64

UPPER = {c: c + 32 for c in range(65, 91)}


def brute(rows, threshold, top):
    """Contract of the operator in plain Python."""
    f, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in range(1, 5):
                f[lang].update(tuple(w[i:i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, count in f.items():
        found = {p: a for p, a in count.items() if len(p) > 1 and a >= threshold}
        hidden = set()
        for p, a in found.items():
            for n in range(2, len(p)):
                hidden.update(q for i in range(len(p) - n + 1) if (q := p[i:i + n]) in found and 100 * a >= 80 * found[q])
        scored = []
        for p, a in found.items():
            cuts = [(2000000 * a // (count[p[:k]] + count[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            if p not in hidden:
                scored.append((-score, -a, " ".join(p).encode(), a, count[p[:k]], count[p[k:]]))
        for rank, (s, _, p, a, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), a, left, right, total[lang], -s))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    vocab = ["The", "of", "Éa", "état", "x1", "日本", "a-b", "İ", *(f"w{i}" for i in range(25))]
    weight = [1 / (i + 1) for i in range(len(vocab))]
    sentence = lambda n: " ".join(rng.choices(vocab, weight, k=n))
    out = [(rng.choice(["en", "en", "en", "de", None, "und", ""]), ". ".join(sentence(rng.randint(1, 12)) for _ in range(rng.randint(1, 9)))) for _ in range(150)]
    out += [("en", "new york  city\tof the big apple")] * 40 + [("en", "big apple pie; new york")] * 15  # repeated rows
    out += [("en", None), ("de", ""), (None, None), ("fr", " .,;:!?\n\x0b\x0c\r\t "), ("it", "once"), ("en", "x y " * 4000),
            ("es", "a b " * 5000 + "," + "c d, " * 3000), ("en", "The\x85of The \x00 of \x00 of"), ("en", "a.b.c:d of.The, of")]
    return out


def frame(spark, rows):
    schema = "lang string, text string, phrase string, a long, n long, rank long, score string, words string"
    return spark.createDataFrame([(lang, text, "p", 1, 2, 3, "s", "w") for lang, text in rows], schema).repartition(4)


@pytest.mark.parametrize("threshold, top, block, masses", [(30, 2000, 8 << 20, None), (5, 40, 2000, (500, 4000)), (2, 7, 700, (100, 300))])
def test_equals_brute_force(spark, rows, threshold, top, block, masses, monkeypatch):
    if masses:
        monkeypatch.setattr(collocations, "SMALL_MASS", masses[0])
        monkeypatch.setattr(collocations, "LARGE_MASS", masses[1])
    out = collocations.mine(frame(spark, rows), threshold, top, block_bytes=block)
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(r) for r in out.collect()) == brute(rows, threshold, top)


def test_nothing_frequent(spark, rows):
    assert collocations.mine(frame(spark, [])).count() == 0
    assert collocations.mine(frame(spark, [(None, None), ("en", "once only")])).count() == 0


def test_no_frequent_key_is_lost():
    rng = np.random.default_rng(2)
    for capacity_of in (1, 4):
        keys = np.concatenate([np.repeat(np.arange(20, dtype=U64), 60), rng.integers(1000, 60_000, 40_000).astype(U64)])
        rng.shuffle(keys)
        threshold = 50
        summary = collocations.MisraGries(capacity_of * len(keys) // threshold + 1)
        for part in np.array_split(keys, 40):
            different, counts = np.unique(part, return_counts=True)
            summary.add(different, counts)
            summary.merge()
            assert len(summary.keys) <= summary.capacity
        good = summary.survivors(threshold)
        assert 0 < summary.lost < threshold / capacity_of
        different, counts = np.unique(keys, return_counts=True)
        assert set(different[counts >= threshold].tolist()) <= set(good.tolist())
        true = dict(zip(different.tolist(), counts.tolist()))
        for k, c in zip(summary.keys.tolist(), summary.counts.tolist()):
            assert c <= true[k] <= c + summary.lost


def test_summaries_merge():
    rng = np.random.default_rng(3)
    keys = rng.zipf(1.3, 30_000).astype(U64)
    halves = [collocations.MisraGries(400) for _ in range(2)]
    for summary, half in zip(halves, np.array_split(keys, 2)):
        for part in np.array_split(half, 10):
            summary.add(*np.unique(part, return_counts=True))
            summary.merge()
    both = collocations.MisraGries(400)
    for h in halves:
        both.add(h.keys, h.counts)
        both.lost += h.lost
    different, counts = np.unique(keys, return_counts=True)
    assert set(different[counts >= 100].tolist()) <= set(both.survivors(100).tolist()) and both.lost <= len(keys) / 400
