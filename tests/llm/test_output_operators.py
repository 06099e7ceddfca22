"""Token files, shards and packed sequences: exact round trips and the laws they keep."""
import io
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from driftwatch.llm import packing, records, shard_interleave, tokens

KINDS = [("word_bpe_49k.json", "drop", True), ("byte_bpe_50k.json", "lead", False)]


def encode(name, text):
    return Tokenizer.from_file(public_tokenizers.path(name)).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name,blanks,lower", KINDS)
def test_pieces_equal_whole_texts(corpus, name, blanks, lower, monkeypatch):
    monkeypatch.setattr(tokens, "KEPT", 50)  # the table of pieces starts anew all the time
    enc, whole = tokens.Encoder(public_tokenizers.path(name), blanks, lower), Tokenizer.from_file(public_tokenizers.path(name))
    rng = random.Random(2)
    odd = ["".join(rng.choices("ab é\n  \t'.,1İΣ́s\x1c <|日²Ⅷß\u00a0", k=rng.randint(0, 25))) for _ in range(3000)]
    odd += ["<|endoftext|> x<|endoftext|>y", "don't 's it's", "İstanbul", "ΣΑΣ ΟΔΟΣ", "e\u0301a", "word\r\nword", "ß ẞ ǅ ﬁ", "\x00a b"]
    for text in odd + [t or "" for _, t in corpus]:
        assert np.frombuffer(enc.ids(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_checksum_and_frames():
    assert records.Crc32c()(b"123456789") == 0xE3069283
    crc, rng = records.Crc32c(), random.Random(1)

    def slow(data):
        c = 0xFFFFFFFF
        for byte in data:
            c ^= byte
            for _ in range(8):
                c = (c >> 1) ^ (records.POLYNOMIAL if c & 1 else 0)
        return c ^ 0xFFFFFFFF
    for n in (0, 1, 31, 32, 33, 511, 512, 513, 1024, 3000):
        data = rng.randbytes(n)
        assert crc(data) == slow(data)
    framed = records.frame(b"abc") + records.frame(b"")
    f = io.BytesIO(framed)
    assert [records.read_frame(f) for _ in range(3)] == [b"abc", b"", None]
    for at in (0, 9, 12, 16):
        broken = bytearray(framed)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            records.read_frame(io.BytesIO(bytes(broken)))


def test_record_files(spark, docs, corpus, tmp_path):
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    manifest = records.write(docs, str(tmp_path), vocabulary, 2, file_bytes=20_000)
    out = records.read(manifest, str(tmp_path)).collect()
    assert manifest.count() > 2 and not list(tmp_path.glob(".part*"))
    got = Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in out)
    assert got == Counter((i, (*encode("word_bpe_49k.json", t), 2)) for i, t in corpus)
    out.sort(key=lambda r: r["start"])
    assert [r["start"] for r in out] == [0, *np.cumsum([r["n_tokens"] for r in out])[:-1].tolist()]
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in out]
    assert ids == sorted(ids)
    one = sorted(tmp_path.glob("*.rec"))[1]  # a reader that jumps by the index
    entries = np.frombuffer(one.with_suffix(".idx").read_bytes(), records.ENTRY)
    with one.open("rb") as f:
        for e in entries[::-1]:
            f.seek(int(e["offset"]))
            assert len(records.read_frame(f)) == 2 * e["n_tokens"]
    first = out[0]
    assert records.digests(records.read(manifest, str(tmp_path))).where("start = 0").first()["ids_crc32"] == zlib.crc32(first["ids"])


def test_empty(empty, tmp_path):
    assert records.read(records.write(empty, str(tmp_path), public_tokenizers.path("word_bpe_49k.json"), 2), str(tmp_path)).collect() == []
    assert shard_interleave.interleave(empty).collect() == []
    assert packing.pack(empty, public_tokenizers.path("byte_bpe_50k.json")).collect() == []


@pytest.mark.parametrize("cell_rows", [5000, 7])
def test_interleaving(docs, corpus, cell_rows):
    out = shard_interleave.interleave(docs, shards=4, cell_rows=cell_rows).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in corpus)
    shards = defaultdict(list)
    for r in out:
        shards[r["shard"]].append(r)
    assert sorted(shards) == [0, 1, 2, 3]
    assert max(map(len, shards.values())) - min(map(len, shards.values())) <= 1
    total = Counter(r["source"] for r in out)
    for rows in shards.values():
        assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
        for source, n in Counter(r["source"] for r in rows).items():
            assert abs(n - total[source] / 4) <= 2
    again = shard_interleave.interleave(docs.repartition(5), shards=4, cell_rows=cell_rows).collect()
    place = lambda rows: Counter((r["doc_id"], r["text_crc32"], r["shard"], r["slot"]) for r in rows)
    assert place(out) == place(again)


def test_ids_must_fit_and_files_are_read_apart(docs, spark, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    with pytest.raises(ValueError):
        records.write(docs, str(tmp_path / "a"), path, 2, width=1)
    with pytest.raises(ValueError):
        records.write(docs, str(tmp_path / "a"), path, 1 << 16, width=2)
    manifest = records.write(docs, str(tmp_path / "b"), path, 2, file_bytes=4000)
    assert records.read(manifest, str(tmp_path / "b")).rdd.getNumPartitions() > 10


def test_packing(docs, corpus):
    capacity = 64
    out = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 2, capacity, with_ids=True, group_items=40).collect()
    bins, want, got = defaultdict(list), Counter(), Counter()
    for r in out:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        got[r["doc_id"], r["piece"], r["start"], r["ids_crc32"]] += 1
    for i, t in corpus:
        ids = [*encode("byte_bpe_50k.json", t), 2]
        stop, begin, piece = len(ids) % capacity or capacity, 0, 0
        while begin < len(ids):
            want[i, piece, begin, zlib.crc32(struct.pack(f"<{stop - begin}I", *ids[begin:stop]))] += 1
            begin, stop, piece = stop, stop + capacity, piece + 1
    assert got == want
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= capacity


def test_sum_of_squares():
    capacity, rng = 12, random.Random(4)
    items = [(i, rng.randint(1, 12)) for i in range(300)]
    gaps, want = [], []  # brute force: try every open bin and a new one
    for _, size in items:
        def score(at):
            trial = [*gaps, capacity] if at == len(gaps) else list(gaps)
            trial[at] -= size
            return sum(n * n for g, n in Counter(trial).items() if 0 < g < capacity)
        options = [i for i, g in enumerate(gaps) if g >= size] + [len(gaps)]
        best = min(score(i) for i in options)
        want.append(best)
        at = min((i for i in options if score(i) == best), key=lambda i: (i == len(gaps), gaps[i] if i < len(gaps) else 0))
        if at == len(gaps):
            gaps.append(capacity)
        gaps[at] -= size
    bins = packing.sum_of_squares(items, capacity)
    assert len(bins) == len(gaps)
    sizes = np.array([rng.randint(1, 1024) for _ in range(4000)])
    packed = packing.pack_group(sizes, 1024)
    assert sorted(i for b in packed for i, _ in b) == list(range(4000)) and all(sum(s for _, s in b) <= 1024 for b in packed)
    assert len(packed) <= 1.06 * sizes.sum() / 1024
