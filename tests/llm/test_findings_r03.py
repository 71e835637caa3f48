"""What the third review found in the training-data operators."""

import random

from pyspark.sql import functions as F

from fathomline.llm import sentencepiece_dropout, simhash


def test_the_pipeline_goes_by_fingerprints(spark):
    """of each component of fingerprints one document stays, also where the texts' five-word shingles are not alike; then near copies with other fingerprints go."""
    import corpus_pipeline

    rng = random.Random(4)
    words = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(60):
        base = [rng.choice(words) for _ in range(400)]
        rows.append(" ".join(base))
        for n in (1, 3, 12, 16):
            copy = list(base)
            for i in rng.sample(range(400), n):
                copy[i] = f"x{rng.randrange(1000)}"
            rows.append(" ".join(copy))
    rows += [None, "", "  "]
    docs = spark.createDataFrame([(len(rows) - i, t, i) for i, t in enumerate(rows)], "doc_id long, text string, i int")
    classes = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    once = simhash.one_of_each(docs)
    assert once.columns == docs.columns and sorted(r.doc_id for r in once.collect()) == sorted(set(classes.values()))
    stay = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert stay.columns == docs.columns
    left = {r.doc_id for r in stay.collect()}
    assert left == {r.doc_id for r in simhash.representatives(once).collect()} and len(left) < once.count()
    only_by_words = {r.doc_id for r in simhash.representatives(docs).collect()}
    assert any(i not in left for i in only_by_words)  # what the words alone would have kept
    twice = docs.unionAll(docs.withColumn("doc_id", F.lit(None).cast("long")))
    assert simhash.one_of_each(twice).filter("doc_id is null").isEmpty()


def test_dropout_remembers_what_comes_again():
    """op9: units met once are computed once and not remembered, and when the table is full the most visited stay; ids are the agenda's all the while."""
    m = sentencepiece_dropout.DropoutBPE(rate=0.1, seed=7, remembered=400)
    computed, in_step = [], m._in_step
    m._in_step = lambda symbols, sizes, *more: computed.append(len(sizes)) or in_step(symbols, sizes, *more)
    once = " ".join(f"word{k}x{k * k}" for k in range(1000))
    often = " ".join(f"common{k % 20}" for k in range(4000))

    def agree(text):
        units = sentencepiece_dropout.UNITS.findall(" " + text)
        assert m.encode(text) == [i for u, k in zip(units, m.keys(text, len(units))) for i in m.unit(u, k)]

    agree(once)
    assert sum(computed) == 1000 and len(m.paths) == 0
    for k in range(6):
        agree(often + str(k))
        agree(" ".join(f"v{k}y{i % 300}" for i in range(600)))
    assert {" common%d" % k for k in range(20)} <= set(m.paths.root) and len(m.paths.thinned(200)) <= 200
