"""Registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import brown, crf, domtree, kmtree, langid, licenses, pivotal, setsketch, simhash, softmix, turntrie, urltree, winnow

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_decontamination": winnow.op1,
        "op2_lm_score": brown.op2,
        "op3_toxicity": crf.op3,
        "op4_nearest_neighbours": kmtree.op4,
        "op5_near_duplicates": setsketch.op5,
        "op6_mixing": softmix.op6,
        "op7_url_filter": urltree.op7,
        "op8_html_text": domtree.op8,
        "op9_language_id": langid.op9,
        "op10_license_scan": licenses.op10,
        "op11_prefix_trie": turntrie.op11,
        "op12_spelling_variants": pivotal.op12,
        "op13_simhash_duplicates": simhash.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontamination": winnow.ORACLE,
        "op5_near_duplicates": setsketch.ORACLE,
        "op11_prefix_trie": turntrie.ORACLE,
        "op12_spelling_variants": pivotal.ORACLE,
    }
