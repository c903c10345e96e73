import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, id long, n long, x string"


def make(spark, rows):
    """documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(d, t, lang, s, len(t or ""), 1, 2, "x") for d, t, lang, s in rows], COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def texts():
    """Texts with exact copies, near copies, shared passages, nulls, empties, repeats within, and one very long."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghiklmnoprstuvé") for _ in range(rng.randint(1, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, out = prose(60), [None, "", " \t\n", "a", "uno dos tres", "uno  dos\ttres", "la " * 500, prose(3000)]
    for _ in range(40):
        out.append(prose(rng.randint(3, 120)))
    for _ in range(10):
        out.append(prose(30) + " " + passage + "\n" + prose(rng.randint(0, 40)))
    base = prose(150).split()
    for k in range(12):
        w = list(base)
        for _ in range(k // 2):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        out.append(" ".join(w))
    out += [out[20], out[21].upper(), out[21] + " ", out[30], out[30], out[7][:4000] + prose(20)]
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.fixture(scope="session")
def docs(spark, texts):
    return make(spark, [(d, t, "es" if d % 3 else None, f"s{d % 4}" if d % 7 else None) for d, t in texts]).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return make(spark, [])
