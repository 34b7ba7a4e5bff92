import random

import pytest

#: Texts of every odd kind: null, empty, white space, very long, ties, repeated, signs, other scripts, special tokens.
ODD = [
    None, "", " \n\t ", "a", "Hello, World!", "the the the the", "x" * 3000, "it's we'll DON'T 12 345", "naïve Ünïcode ﬁ İstanbul ΣΑΣ 中文 😀", "<|endoftext|> in text <|startoftext|>", "line one\nline one\nline two\n\n",
    "nbsp\u00a0here\u2003em", "tab\tand\x0bvt\x0cff", "é e\u0301 combining", "a.,b ..., c", "under_score a_b", "\x00zero\x1fcontrol",
]


@pytest.fixture(scope="session")
def words():
    rng = random.Random(7)
    return ["".join(rng.choice(["th", "er", "on", "an", "re", "in", "é", "ou"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]


@pytest.fixture(scope="session")
def docs(spark, words):
    """A table with odd texts, a long one, exact and near copies, repeated rows, extra columns of clashing names."""
    rng = random.Random(11)
    texts = list(ODD)
    base = [rng.choice(words) for _ in range(300)]
    texts += [" ".join(base)] * 3
    for k in range(4):
        near = list(base)
        near[50 * k + 5] = "changed"
        texts.append(" ".join(near))
    for _ in range(30):
        texts.append(". ".join(" ".join(rng.choice(words) for _ in range(rng.randint(3, 30))) for _ in range(rng.randint(1, 12))) + ".")
    texts.append(" ".join(rng.choice(words) for _ in range(20_000)))
    rows = [(i, t, "en", "s", 0, "clash", 1) for i, t in enumerate(texts)]
    rows.append((None, "no id " * 10, None, None, None, None, None))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, verdict string, ids int")


@pytest.fixture()
def folder(spark, docs, tmp_path):
    """The table above as documents.parquet in a folder of its own."""
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


@pytest.fixture()
def nothing(spark, docs, tmp_path):
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


@pytest.fixture(scope="session")
def odd():
    return ODD
