import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    """Documents with what operators must stand: nulls, empty and long texts, exact and near copies, repeated rows, shared lines, odd letters."""
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghijklmnoprstuvwéöñ") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = [text(120) for _ in range(12)]
    out = [(i, t, "en", "a", len(t)) for i, t in enumerate(base)]
    for i, t in enumerate(base[:6]):
        upper = t.translate({c: c - 32 for c in range(97, 123)})
        out.append((100 + i, upper if i % 2 else t, "en", "a", len(t)))  # exact copies but for the case of a-z
        w = t.split()
        w[60] = "changed"
        out.append((200 + i, " ".join(w), "en", "b", None))  # near copies
    line = "the same line in many documents"
    out += [(300 + i, f"{text(9)}\n  {line.upper() if i % 3 else line}\t\n\n{text(5)}", "de", "c", 1) for i in range(12)]
    out += [(400, None, None, None, None), (401, "", "en", None, 0), (402, " \n\t ", "en", "a", 4), (403, "one", "en", "a", 3), (404, "one", "en", "a", 3), (405, "ÄÖ ß É İ Σ é <|endoftext|> don't x\x0by 123 \U0001f600", "de", "a", 9)]
    out += [(406, text(6000), "en", "a", 1), (407, "na " * 3000, "en", "a", 1), (407, "na " * 3000, "en", "a", 1), (None, "no id at all", "en", "a", 1), (None, None, None, None, None)]
    passage = text(80)
    out += [(500 + i, f"{text(20 + i)} {passage} {text(15)}", "en", "d", 1) for i in range(4)]
    return out


@pytest.fixture(scope="session")
def documents():
    return rows()


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
