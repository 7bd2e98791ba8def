"""The registered queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from granary.llm import byte_bpe, decontaminate, lattice_lm, minhash, periodic_runs, ppm_language, quality_rules, simhash, suffix_dedup, toxicity, url_filter, vector_codes, warc


def queries() -> dict:
    return {
        "op1_toxicity": toxicity.query,
        "op2_lattice_lm": lattice_lm.query,
        "op3_minhash": minhash.query,
        "op4_quality_rules": quality_rules.query,
        "op5_decontaminate": decontaminate.query,
        "op6_suffix_dedup": suffix_dedup.query,
        "op7_ppm_language": ppm_language.query,
        "op8_url_filter": url_filter.query,
        "op9_byte_bpe": byte_bpe.query,
        "op10_warc": warc.query,
        "op11_simhash": simhash.query,
        "op12_periodic_runs": periodic_runs.query,
        "op13_vector_codes": vector_codes.query,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_quality_rules": quality_rules.oracle(), "op10_warc": warc.oracle()}
