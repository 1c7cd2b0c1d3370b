"""The subpackage's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, exact_dedup, langid, licenses, media, merges, merkle, minhash, packing, simhash, toxicity, warc, ztrie


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": licenses.op1_license_scan,
        "op2_merge_dropout": merges.op2_merge_dropout,
        "op3_warc": warc.op3_warc,
        "op4_chat": chat.op4_chat,
        "op5_langid": langid.op5_langid,
        "op6_exact_dedup": exact_dedup.op6_exact_dedup,
        "op7_packing": packing.op7_packing,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_simhash": simhash.op9_simhash,
        "op10_media": media.op10_media,
        "op11_minhash": minhash.op11_minhash,
        "op12_merkle": merkle.op12_merkle,
        "op13_prefix_trie": ztrie.op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": licenses.ORACLE, "op3_warc": warc.ORACLE, "op4_chat": chat.ORACLE, "op6_exact_dedup": exact_dedup.ORACLE, "op11_minhash": minhash.ORACLE, "op12_merkle": merkle.ORACLE, "op13_prefix_trie": ztrie.ORACLE}
