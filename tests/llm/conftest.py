import random

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def rng():
    return random.Random(11)


@pytest.fixture(scope="session")
def corpus(rng):
    """Texts with copies, near copies, shared passages and lines, and every odd case, as ``(doc_id, text)``."""
    words = ["".join(rng.choices("abcdeinorst", k=rng.randint(2, 7))) for _ in range(900)]
    words += [w.capitalize() for w in words[:40]] + ["Größe", "été,", "naïve", "42", "x-y", "ünï"]
    line = lambda n: " ".join(rng.choices(words, k=n))
    texts = ["\n".join(line(rng.randint(3, 30)) for _ in range(rng.randint(2, 9))) for _ in range(110)]
    passage, boiler = line(70), line(9)
    for i in range(0, 60, 4):
        texts[i] += "\n" + passage
    for i in range(0, 110, 3):
        texts[i] = boiler + "\n" + texts[i]
    for i in range(12):
        near = texts[i + 20].split(" ")
        near[rng.randrange(len(near))] = "changed"
        texts.append(" ".join(near))
    texts += texts[5:15] + [texts[5]] * 6
    texts += ["", None, "   \n\t ", "!!!", "!!!", "one", "one two three", "For " * 400, "For " * 400, "\x00\x1f odd\x7f", "a b c"]
    texts.append(line(6000))
    texts.append(texts[-1] + " " + line(30))
    return [(3 * i + 1, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def documents(spark, corpus):
    rows = [(i, t, None if i % 7 == 0 else "en", f"src{i % 3}", None if t is None else len(t)) for i, t in corpus]
    return spark.createDataFrame(rows, DOCUMENTS).repartition(5)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCUMENTS)
