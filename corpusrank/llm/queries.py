"""Registered queries of the training-data operators, with SQL where it can
express the result."""

from __future__ import annotations

from corpusrank.llm import sql
from corpusrank.llm.common import read
from corpusrank.llm import op4_toxicity as toxicity
from corpusrank.llm import op11_alignment as alignment
from corpusrank.llm import op12_bpe as bpe
from corpusrank.llm import op13_runs as periodic
from corpusrank.llm.op1_exact_dedup import exact_dedup
from corpusrank.llm.op2_sharding import shard
from corpusrank.llm.op3_token_counts import histogram
from corpusrank.llm.op5_secrets import scan_secrets
from corpusrank.llm.op6_mixing import mix
from corpusrank.llm.op7_minhash import near_dedup
from corpusrank.llm.op8_quality import quality
from corpusrank.llm.op9_packing import pack
from corpusrank.llm.op10_line_dedup import per_document


def op1_exact_dedup(spark, sf_dir):
    return exact_dedup(read(spark, sf_dir, "documents"))


def op2_sharding(spark, sf_dir):
    return shard(read(spark, sf_dir, "documents"))


def op3_token_counts(spark, sf_dir):
    return histogram(read(spark, sf_dir, "documents"))


def op4_toxicity(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def op5_secrets(spark, sf_dir):
    return scan_secrets(read(spark, sf_dir, "documents"))


def op6_mixing(spark, sf_dir):
    return mix(read(spark, sf_dir, "documents"))


def op8_quality(spark, sf_dir):
    return quality(read(spark, sf_dir, "documents"))


def op7_minhash(spark, sf_dir):
    return near_dedup(read(spark, sf_dir, "documents"))


def op9_packing(spark, sf_dir):
    return pack(read(spark, sf_dir, "documents"))


def op10_line_dedup(spark, sf_dir):
    return per_document(read(spark, sf_dir, "documents"))


def op11_alignment(spark, sf_dir):
    return alignment.per_document(read(spark, sf_dir, "documents"))


def op12_bpe(spark, sf_dir):
    return bpe.digests(read(spark, sf_dir, "documents"))


def op13_runs(spark, sf_dir):
    return periodic.digests(periodic.find_runs(periodic.with_planted_runs(read(spark, sf_dir, "documents"))))


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_sharding, op3_token_counts, op4_toxicity, op5_secrets, op6_mixing,
                                   op7_minhash, op8_quality, op9_packing, op10_line_dedup, op11_alignment, op12_bpe,
                                   op13_runs)}
ORACLES = {"op1_exact_dedup": sql.EXACT_DEDUP, "op6_mixing": sql.MIXING, "op7_minhash": sql.NEAR_DEDUP,
           "op8_quality": sql.QUALITY}
