"""The ten corpus queries and the SQL of those that it can express."""

from __future__ import annotations

from weft.llm import bpe, flac, jaccard_join, license_scan, maxent_lm, mixing, quality_rules, secret_scan, toxicity, warc


def queries():
    return {
        "op1_quality_rules": quality_rules.op1_quality_rules,
        "op2_maxent_lm": maxent_lm.op2_maxent_lm,
        "op3_flac_media": flac.op3_flac_media,
        "op4_jaccard_join": jaccard_join.op4_jaccard_join,
        "op5_mix_sources": mixing.op5_mix_sources,
        "op6_secret_scan": secret_scan.op6_secret_scan,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_warc_archive": warc.op8_warc_archive,
        "op9_license_scan": license_scan.op9_license_scan,
        "op10_byte_bpe": bpe.op10_byte_bpe,
    }


def oracle_sql():
    return {
        "op1_quality_rules": quality_rules.SQL,
        "op4_jaccard_join": jaccard_join.SQL,
        "op5_mix_sources": mixing.SQL,
        "op6_secret_scan": secret_scan.SQL,
        "op8_warc_archive": warc.SQL,
    }
