"""Stages of the pipeline on rows that a key does not tell apart."""

from collections import Counter

import corpus_pipeline
from vigilake.session import tune

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
A, B = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
NEAR = A.replace("a39", "z")


def kept(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    out = corpus_pipeline.near_dedup(tune(spark), docs, "")
    assert out.columns == docs.columns
    return Counter((r.doc_id, r.text) for r in out.collect())


def test_near_dedup_keeps_different_texts_of_one_id(spark):
    got = kept(spark, [(1, A), (1, B), (2, "other words in this one text here")])
    assert got == Counter({(1, A): 1, (1, B): 1, (2, "other words in this one text here"): 1})


def test_near_dedup_drops_copies_whatever_their_ids(spark):
    got = kept(spark, [(None, A), (None, A), (3, NEAR), (3, NEAR), (None, B), (None, None), (4, ""), (4, "")])
    assert sum(n for (_, t), n in got.items() if t in (A, NEAR)) == 1
    assert got[None, B] == 1 and got[None, None] == 1 and got[4, ""] == 2


def test_near_dedup_of_nothing(spark):
    assert kept(spark, []) == Counter()
