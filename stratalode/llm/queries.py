"""Registry of the training-data queries."""

from __future__ import annotations

from . import decontamination, language_model, media, near_dedup, packing, pii, substring_dedup, token_files, toxicity, warc


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_packing": packing.op2_packing,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_near_dedup": near_dedup.op4_near_dedup,
    "op5_language_model": language_model.op5_language_model,
    "op6_decontamination": decontamination.op6_decontamination,
    "op7_warc": warc.op7_warc,
    "op8_token_files": token_files.op8_token_files,
    "op9_media": media.op9_media,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
    "pipeline": pipeline,
}
ORACLES = {
    "op4_near_dedup": near_dedup.ORACLE_SQL,
    "op6_decontamination": decontamination.ORACLE_SQL,
    "op7_warc": warc.ORACLE_SQL,
    "op10_substring_dedup": substring_dedup.ORACLE_SQL,
}
