"""The pipeline's stages one after the other on a small table."""

from collections import Counter

import corpus_pipeline
from velum.llm.decontaminate import mark_contaminated
from velum.llm.mixing import mixed_sizes
from velum.llm.near_dedup import near_duplicates
from velum.llm.queries import SHARD_BYTES
from velum.llm.toxicity import fit_toxicity, score_toxicity

SF = "/root/testdata/sf0.001"


def ids(df):
    return Counter(r[0] for r in df.select("doc_id").collect())


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]

    model = fit_toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {r.doc_id: r.toxicity for r in score_toxicity(docs, model).collect()}
    mild = stage["toxicity"](spark, docs, SF).cache()
    assert ids(mild) == Counter(i for i, s in scores.items() if s < 0.5)

    least = {r.class_id for r in near_duplicates(mild).collect()}
    single = stage["near_duplicates"](spark, mild, SF).cache()
    assert ids(single) == Counter(least)

    marks = mark_contaminated(single, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()
    clean = stage["decontamination"](spark, single, SF).cache()
    assert ids(clean) == Counter(r.doc_id for r in marks if not r.contaminated)

    taken = {r.doc_id: r.taken // r.size for r in mixed_sizes(clean).collect() if r.taken}
    mixed = stage["mixing"](spark, clean, SF).cache()
    assert ids(mixed) == Counter(taken)
    assert mild.columns == single.columns == clean.columns == mixed.columns == docs.columns

    sharded = stage["sharding"](spark, mixed, SF)
    assert ids(sharded) == Counter(taken)
    rows = sharded.collect()
    size = Counter()
    for r in rows:
        size[r.shard] += len(r.text.encode())
    assert all(r.shard_bytes == size[r.shard] <= SHARD_BYTES for r in rows)

    whole = corpus_pipeline.run(spark, SF)
    assert Counter((r.doc_id, r.shard) for r in whole.collect()) == Counter((r.doc_id, r.shard) for r in rows)
