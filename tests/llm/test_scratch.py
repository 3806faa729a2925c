"""Scratch tables and shuffles of a finished step leave the disk."""

import os

from corpusrank.llm import op7_minhash as o7
from corpusrank.llm import op10_line_dedup as o10
from corpusrank.llm.common import CLEANUP
from corpusrank.session import ensure_checkpoint_dir


def test_tables_of_a_step_go_with_it(spark):
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    texts = ["one line of some plain words here\nanother line of other words", "One line of some plain words here!", "one line of sum plain words here"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    conf, before = spark.conf.get(CLEANUP, "false"), set(os.listdir(folder))
    assert {r["doc_id"]: r["removed"] for r in o10.per_document(df).collect()}[1] == [0]
    assert {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before} == {"gone"}
    assert o7.near_dedup(df).count() == 3
    assert {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before} == {"gone", "signatures", "sets", "set-groups"}
    assert spark.conf.get(CLEANUP, "false") == conf
