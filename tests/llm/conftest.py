import random

import pytest

ROWS = "doc_id long, text string, lang string, source string, n_chars long, uid string, rank string"


def words(r, n, k=60):
    return " ".join(r.choice("the of and in stone river Lamp quick bread under seven night paper wind north").strip() if r.random() < 0.5 else f"w{r.randrange(k)}" for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Rows with nulls, empty and long texts, exact and near copies, shared passages, ties."""
    r = random.Random(4)
    passage = words(r, 60, 500)
    rows = [(1, None), (2, ""), (3, "   \n\t"), (4, "One"), (5, "One"), (6, "one two"), (7, words(r, 4000, 3000))]
    base = words(r, 120, 400)
    for i in range(8, 16):
        w = base.split()
        w[r.randrange(len(w))] = f"edit{i}"
        rows.append((i, " ".join(w)))
    rows += [(i, words(r, 40, 900) + "\n" + passage + " " + words(r, 30, 900)) for i in range(16, 22)]
    rows += [(i, rows[-1][1]) for i in range(22, 25)]
    rows += [(i, words(r, r.randrange(1, 90), 5000)) for i in range(25, 45)]
    rows.append((45, "ÀÉ naïve 日本語 テスト 😀 a\x0bb ﬁn <|endoftext|> <s> token"))
    return rows


@pytest.fixture
def docs(spark, corpus):
    rows = [(i, t, "en", "src0", None if t is None else len(t), "clash", "clash") for i, t in corpus]
    return spark.createDataFrame(rows, ROWS).repartition(3)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], ROWS)
