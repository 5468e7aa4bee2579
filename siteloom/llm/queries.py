"""Queries of the training-data operators and the SQL that DuckDB checks them against."""

from __future__ import annotations

import public_tokenizers

from . import chosen_path, fingerprints, line_dedup, mixing, packing, pii, quality, range_coder, separator_scan, toxicity

BYTE_BPE, WORD_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
END_OF_TEXT = 50256


def _documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _over_documents(f):
    return lambda spark, sf_dir: f(_documents(spark, sf_dir))


def queries():
    return {
        "op1_token_counts": _over_documents(lambda docs: separator_scan.digest(docs, BYTE_BPE, END_OF_TEXT)),
        "op2_chosen_path": _over_documents(chosen_path.digest),
        "op3_packing": _over_documents(lambda docs: packing.digest(docs, BYTE_BPE)),
        "op4_quality_rules": _over_documents(quality.digest),
        "op5_toxicity": lambda spark, sf_dir: toxicity.digest(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")),
        "op6_mixing": _over_documents(mixing.digest),
        "op7_pii": _over_documents(pii.digest),
        "op8_line_dedup": _over_documents(line_dedup.digest),
        "op9_fingerprints": _over_documents(fingerprints.digest),
        "op10_token_files": _over_documents(lambda docs: range_coder.digest(docs, WORD_BPE)),
    }


def oracle_sql():
    return {"op4_quality_rules": quality.ORACLE, "op6_mixing": mixing.ORACLE, "op8_line_dedup": line_dedup.ORACLE}
