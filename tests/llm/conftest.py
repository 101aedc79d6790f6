import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, taken int, shard string, id string"


@pytest.fixture(scope="session")
def texts():
    """Invented prose with copies, near copies, repeats, secrets, junk, and the odd cases."""
    rng = random.Random(7)
    words = ["".join(rng.choice(("an", "the", "ion", "re", "on", "ou", "is", "éa")) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) + rng.choice(("", "", ".", ",")) for _ in range(n))
    out = [prose(rng.randint(5, 160)) for _ in range(40)]
    base = prose(120)
    for k in range(12):  # near copies
        w = base.split()
        for _ in range(k):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append(" ".join(w))
    out += [out[0]] * 5 + [base.upper()] + [prose(30) + "\n" + "same line again\n" * 20]
    out += ['api_key: "abcdefgh12345678" password=secret token = \'Zx9/Qw+12_=.-\' AKIA' + "Q7" * 10 + " " + "0a" * 16 + " é " + "deadbeef" * 5]
    out += ["", None, " \n\t ", "one", "two words", "a" * 3000, "x y " * 4000, "日本語 　テキスト🙂🙂 naïve", "\x0b\x0c\r a b \x85c", "THE!! END!! " * 40, "wo*** rd### of&&& " * 40]
    return out


@pytest.fixture(scope="session")
def rows(texts):
    """Ids out of order with gaps, a repeated row, a null id, null sources, and clashing extra columns."""
    out = [(7 * i % 1000 - 50, t, "en", None if i % 11 == 0 else f"src{i % 4}", None if t is None else len(t), i, "x", "y") for i, t in enumerate(texts)]
    return out + [out[3], (None, "no id here but some words", None, "src1", 25, 1, "x", "y")]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
