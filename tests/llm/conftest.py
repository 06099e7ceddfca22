import random
import re

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k string, h string, text_crc32 string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text) with copies, near copies, shared passages, nulls, blanks, ties, repeated rows and one long text."""
    rng = random.Random(11)
    vocab = ["the", "of", "Éa", "and", *("".join(rng.choices(["th", "er", "on", "an", "ï", "in"], k=3)) for _ in range(300))]
    prose = lambda n: " ".join(rng.choices(vocab, k=n)) + "."
    base = [prose(rng.randint(20, 120)) for _ in range(25)]
    passage = prose(60)
    rows = list(enumerate(base))
    rows += [(100 + i, base[i % 5]) for i in range(12)]  # exact copies
    for i in range(10):  # near copies
        w = base[6].split(" ")
        w[rng.randrange(len(w))] = f"new{i}"
        rows.append((200 + i, " ".join(w)))
    rows += [(300 + i, prose(30) + "\n" + passage + "\n" + prose(20)) for i in range(6)]
    rows += [(400, None), (401, ""), (402, " \t\n "), (403, "one"), (404, "one two three"), (405, "ONE two\tthree"),
             (406, prose(9000)), (407, "a" * 3000), (408, "# $ % " * 40), (409, "x y " * 60), (410, "line here\n" * 30),
             (411, "<|endoftext|> two  blanks\t tab \u00a0 \x00 end "), (412, "日本語 " * 20), (413, "A!! B!! C!! " * 30)]
    rows += [rows[3], rows[3]]  # repeated rows
    rows += [(500, base[7]), (500, base[8]), (None, base[9]), (None, None)]  # one id twice, null ids
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    rows = [(i, t, "en" if (i or 0) % 3 else None, f"s{(i or 0) % 4}" if (i or 0) % 5 else None, len(t or ""), "x", "y", "z") for i, t in corpus]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
