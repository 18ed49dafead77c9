"""The operators' queries: name -> function of (spark, sf_dir), and the SQL
of those that SQL can express on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marketlens.llm import ann, bpe, collocations, jaccard, langid, mixing, nra, pii, pitmanyor, rangejoin, repeats, secrets, sharding

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": secrets.query,
    "op2_ngram_jaccard": jaccard.query,
    "op3_pii": pii.query,
    "op4_multiprobe_ann": ann.query,
    "op5_mixing": mixing.query,
    "op6_language_id": langid.query,
    "op7_byte_bpe": bpe.query,
    "op8_pitman_yor": pitmanyor.query,
    "op9_suffix_repeats": repeats.query,
    "op10_metric_range_join": rangejoin.query,
    "op11_sampled_splitters": sharding.query,
    "op12_nra": nra.query,
    "op13_collocations": collocations.query,
}

ORACLE_SQL: dict[str, str] = {
    "op5_mixing": mixing.ORACLE_SQL,
    "op11_sampled_splitters": sharding.ORACLE_SQL,
    "op12_nra": nra.ORACLE_SQL,
    "op13_collocations": collocations.ORACLE_SQL,
}
