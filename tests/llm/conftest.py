import random

import pytest

SYLLABLES = "ba ce di fo gu ka le mi no pu ra se ti vo xa".split()


def sentence(rng, n):
    words = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n)]
    return " ".join(words).capitalize() + "."


def prose(rng, sentences=8):
    return " ".join(sentence(rng, rng.randint(6, 14)) for _ in range(sentences))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null ids, null and empty texts, equal rows, equal ids, a very long text, clashing columns."""
    rng = random.Random(4)
    base = prose(rng, 10)
    near = base.replace(base.split()[20], "changed", 1)
    long = " ".join(sentence(rng, 9) for _ in range(4000))
    rows = [
        (1, base), (2, near), (3, base), (3, base), (None, prose(rng)), (None, None), (4, None), (5, ""),
        (6, "  \n\t "), (7, "one two"), (8, "One  TWO"), (9, long), (10, prose(rng)), (10, prose(rng)),
        (11, "Ünï 漢字 \U0001f600 Licensed under CC BY-NC 4.0."), (12, "..."), (13, prose(rng)), (14, "x" * 5000),
    ]
    rows = [(i, t, "en" if k % 3 else None, "src0" if k % 2 else None, 0, "a", "b", k) for k, (i, t) in enumerate(rows)]
    # columns named as the operators' own
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, id string, first string, n long"
    )


@pytest.fixture(scope="session")
def no_docs(spark, odd_docs):
    return odd_docs.filter("false")


@pytest.fixture(scope="session")
def some_docs():
    """Prose with exact copies, near copies and shared passages."""
    rng = random.Random(7)
    texts = [prose(rng, rng.randint(3, 12)) for _ in range(60)]
    passage = " ".join(sentence(rng, 13) for _ in range(5))
    for k in range(40):
        words = texts[k % 10].split()
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(len(words))] = "edit" + str(rng.randrange(1000))
        texts.append(" ".join(words))
    for _ in range(30):
        texts.append(prose(rng, 2) + " " + passage + " " + prose(rng, rng.randint(0, 3)))
    return list(enumerate(texts))
