"""Raw corpora read by splits give the rows of whole texts cut at once."""

import random

import pytest

from velum.labels import CORPUS_MARKER
from velum.operators.annotations import split_corpus
from velum.sources.files import read_raw_corpora


def corpus(seed, newline="\n"):
    rnd = random.Random(seed)
    parts = []
    for k in range(60):
        lines = [f"parola{rnd.randint(0, 99)} {rnd.choice(['O', 'B-PER', 'è'])}" for _ in range(rnd.randint(0, 12))]
        ends = [rnd.choice(["\n", "\n", "\n\n", "\n\n\n", "\n" * 4]) for _ in lines]
        start = rnd.choice(["", "", "\n", "\n\n", "\n\n\n"])
        parts.append(start + "".join(a + b for a, b in zip(lines, ends)))
    # One marker that only appears when blank lines collapse, one that is none.
    parts[10] += CORPUS_MARKER.replace("\n", "\n\n") + parts[11]
    parts[20] += CORPUS_MARKER.replace("caso O\n", "caso OX\n") + parts[21]
    return CORPUS_MARKER.join(parts).replace("\n", newline)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("corpora")
    files = {"one": corpus(1), "two": corpus(2), "three": "\n\n" + corpus(3), "four": "", "five": "no marker " * 10}
    files["six"] = CORPUS_MARKER + corpus(6) + CORPUS_MARKER
    for name, text in files.items():
        (path / f"{name}.txt").write_bytes(text.encode())
    return path, files


def whole(spark, files):
    rows = [(name, text.replace("\r\n", "\n").replace("\r", "\n")) for name, text in files.items()]
    found = split_corpus(spark.createDataFrame(rows, "corpus_id string, text string"))
    return sorted(map(tuple, found.collect()))


@pytest.mark.parametrize("size", [300, 1000, 4000, 1 << 27])
def test_same_rows_as_whole_files(spark, folder, size):
    path, files = folder
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        found = read_raw_corpora(spark, str(path))
        rows = found.collect()
        tasks = found.rdd.getNumPartitions()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sorted(map(tuple, rows)) == whole(spark, files)
    if size <= 1000:
        assert tasks > 2 * len(files)


def test_texts_are_not_moved(spark, folder):
    plan = read_raw_corpora(spark, str(folder[0]))._jdf.queryExecution().executedPlan().toString()
    large = plan.split("BroadcastExchange")[0]
    assert "BroadcastHashJoin" in large and "Exchange hashpartitioning" not in large and "Sort" not in large


def test_other_line_ends(spark, tmp_path):
    text = corpus(4, "\r\n")
    (tmp_path / "crlf.txt").write_bytes(text.encode())
    want = whole(spark, {"crlf": text})
    for newline in ("\r\n", "\n"):
        assert sorted(map(tuple, read_raw_corpora(spark, str(tmp_path), newline=newline).collect())) == want


def test_markers_that_cannot_delimit(spark, tmp_path):
    for marker in ("\nx", "a\n\nb", "aba"):
        with pytest.raises(ValueError):
            read_raw_corpora(spark, str(tmp_path), marker=marker)
