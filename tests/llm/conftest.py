"""Rows that every operator must take: nulls, empty and very long texts, ties, repeated
rows, and columns with names that operators use themselves."""

import random

import pytest

CLASHING = "h long, mark string, key int, root string, n int, block string, size string, rank int"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"


def words(rnd, n):
    return [rnd.choice("abcdefghij") * rnd.randint(1, 3) + str(rnd.randint(0, 40)) for _ in range(n)]


def awkward_rows():
    rnd = random.Random(5)
    passage = " ".join(words(rnd, 120))
    texts = {}
    for i in range(120):
        kind = i % 6
        own = words(rnd, rnd.randint(20, 90))
        if kind == 0:
            texts[i] = " ".join(own)
        elif kind == 1:
            texts[i] = texts[i - 1]
        elif kind == 2:
            texts[i] = " ".join(own[:5]) + "\n" + passage + "\t\t" + " ".join(own[5:20])
        elif kind == 3:
            near = texts[i - 3].split(" ")
            near[rnd.randrange(len(near))] = "changed"
            texts[i] = " ".join(near)
        elif kind == 4:
            texts[i] = " ".join(own[:3]) * 2
        else:
            texts[i] = ["", None, "one", "  ", "é à ü " * 40, "aaaa" * 150][i // 6 % 6]
    texts[200] = " ".join(words(rnd, 20_000))
    texts[201] = "x" * 3000 + " " + "x" * 3000
    rows = [(i, t) for i, t in texts.items()]
    rows += [(None, texts[0]), (None, "only here without an identifier"), (7, texts[7]), (7, texts[7])]
    rows += [(3, "the same identifier with another text")]
    extra = (1, "m", 2, "r", 3, "b", "s", 4)
    return [
        (i, t, "en", None if k % 9 == 0 else f"src{k % 4}", len(t or ""), *extra)
        for k, (i, t) in enumerate(rows)
    ]


@pytest.fixture(scope="session")
def rows():
    return awkward_rows()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(6).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
