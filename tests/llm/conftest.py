import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, _digest string, `key` string, place int"

WORDS = "the quick brown fox jumps over a lazy dog while seven wizards mix strange potions under pale moonlight near old stone bridges".split()


def sentence(seed: int, n: int) -> str:
    out, x = [], seed * 7919 + 13
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(WORDS[(x >> 8) % len(WORDS)] + (str((x >> 16) % 50) if x & 64 else ""))
    return " ".join(out)


def rows():
    """Edge cases: nulls in every column, empty, blank, one huge text, ties, repeated rows, equal and near texts."""
    base = sentence(1, 120)
    near = base + " one more"
    out = [
        (1, base), (2, base), (3, base.replace(" ", "\n")), (4, base + " "), (5, near), (5, near), (6, near.upper()),
        (7, ""), (8, None), (9, " \t\n"), (10, "one"), (11, "one two"), (12, "ONE two"), (None, base), (None, None), (13, sentence(2, 20000)),
        (14, "don't say İstanbul ΟΔΟΣ 日本 <|endoftext|> x<|startoftext|>"), (15, "é \x1c \x85 \xa0 0 ² ½"), (16, "a" * 30000),
        (17, "\n".join(["same line here"] * 30)), (18, "mail me@example.com or 10.0.0.1, +49 30 1234567 and 4111 1111 1111 1111"),
    ]
    out += [(100 + i, sentence(i + 50, 60)) for i in range(30)]
    extra = lambda i, t: (None if i == 10 else "en", None if i == 11 else "src0", None if t is None else len(t), "x", None, "k", i)
    return [(i, t, *extra(i, t)) for i, t in out]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def tokenizer():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
