import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id string, root string, place string"
EMPTY = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def awkward():
    """Rows with nulls, blanks, ties, copies, overlaps, long texts and columns whose names clash with the operators' own."""
    rng = random.Random(7)
    words = [rng.choice("abcdefgh") + rng.choice("aeiou") + rng.choice("xyzé") for _ in range(60)]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))

    base, passage = prose(120), prose(60)
    texts = [None, "", "   \n\t ", "one", "one two three", "One TWO three", base, base, base.upper(), base + " tail", base.replace(" ", "\n", 9)]
    for i in range(12):
        w = base.split()
        for _ in range(1 + i % 4):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(99)}"
        texts.append(" ".join(w))
    texts += [prose(30) + " " + passage + " " + prose(40) for _ in range(6)]
    texts += [prose(20) + "\n" + prose(5) + "\nsame line\nsame line\n" + prose(10) for _ in range(4)]
    texts += ["x" * 700, "y " * 500, "é" * 300, "中文 " * 120, prose(9000), "\x1c\x85 odd\xa0spaces here", "<|endoftext|> " + prose(15), "#$%&*|<>" * 30]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = [(3 * i + 1, t, rng.choice(["en", "fr", None]), rng.choice(["s", None]), None, "c", "r", "p") for i, t in zip(ids, texts)]
    return rows


@pytest.fixture(scope="session")
def awkward_docs(spark, awkward):
    return spark.createDataFrame(awkward, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], EMPTY)
