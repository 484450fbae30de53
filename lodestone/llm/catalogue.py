"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from lodestone.llm import chat, decontaminate, html_text, licenses, merkle, mixing, quality, sharding, simhash, tokens_out, topk, toxicity, trie
from lodestone.llm.common import table

QUERIES = {
    "op1_sharding": lambda spark, sf_dir: sharding.op1_sharding(table(spark, sf_dir, "documents")),
    "op2_topk": lambda spark, sf_dir: topk.op2_topk(table(spark, sf_dir, "embeddings")),
    "op3_simhash": lambda spark, sf_dir: simhash.op3_simhash(table(spark, sf_dir, "documents")),
    "op4_licenses": lambda spark, sf_dir: licenses.op4_licenses(table(spark, sf_dir, "documents")),
    "op5_toxicity": lambda spark, sf_dir: toxicity.op5_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op6_token_output": lambda spark, sf_dir: tokens_out.op6_token_output(table(spark, sf_dir, "documents")),
    "op7_chat": lambda spark, sf_dir: chat.op7_chat(table(spark, sf_dir, "conversations")),
    "op8_decontaminate": lambda spark, sf_dir: decontaminate.op8_decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
    "op9_html": lambda spark, sf_dir: html_text.op9_html(table(spark, sf_dir, "pages")),
    "op10_mixing": lambda spark, sf_dir: mixing.op10_mixing(table(spark, sf_dir, "documents")),
    "op11_merkle": lambda spark, sf_dir: merkle.op11_merkle(table(spark, sf_dir, "documents")),
    "op12_quality": lambda spark, sf_dir: quality.op12_quality(table(spark, sf_dir, "documents")),
    "op13_trie": lambda spark, sf_dir: trie.op13_trie(table(spark, sf_dir, "conversations")),
}

ORACLE = {
    "op1_sharding": sharding.oracle(),
    "op2_topk": topk.ORACLE_SQL,
    "op8_decontaminate": decontaminate.ORACLE_SQL,
    "op10_mixing": mixing.ORACLE_SQL,
    "op11_merkle": merkle.oracle(),
    "op12_quality": quality.oracle(),
    "op13_trie": trie.ORACLE_SQL,
}
