"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from epochal.llm import ann, bpe, langid, licenses, lines, mixing, repeats, secrets, sharding, simhash, spelling, topk, tries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": sharding.op1_sharding,
    "op2_curves": ann.op2_curves,
    "op3_repeats": repeats.op3_repeats,
    "op4_langid": langid.op4_langid,
    "op5_simhash": simhash.op5_simhash,
    "op6_bpe": bpe.op6_bpe,
    "op7_mixing": mixing.op7_mixing,
    "op8_secrets": secrets.op8_secrets,
    "op9_licenses": licenses.op9_licenses,
    "op10_pivots": topk.op10_pivots,
    "op11_line_dedup": lines.op11_line_dedup,
    "op12_prefix_trie": tries.op12_prefix_trie,
    "op13_spelling": spelling.op13_spelling,
}


def oracle_sql() -> dict[str, str]:
    return {
        "op9_licenses": licenses.op9_sql(),
        "op10_pivots": topk.op10_sql(),
        "op11_line_dedup": lines.op11_sql(),
        "op12_prefix_trie": tries.op12_sql(),
        "op13_spelling": spelling.op13_sql(),
    }
