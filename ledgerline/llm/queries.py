"""The subpackage's queries and the SQL that they are held against."""

from __future__ import annotations

from . import ann, bpe, jaccard, langid, mixing, quality_model, quality_rules, sharding, toxicity, warc

QUERIES = {
    "op1_jump_sharding": sharding.op1_jump_sharding,
    "op2_language_mixture": langid.op2_language_mixture,
    "op3_toxicity_chain": toxicity.op3_toxicity_chain,
    "op4_pivotal_mixing": mixing.op4_pivotal_mixing,
    "op5_vantage_point": ann.op5_vantage_point,
    "op6_quality_ftrl": quality_model.op6_quality_ftrl,
    "op7_rule_ledger": quality_rules.op7_rule_ledger,
    "op8_warc": warc.op8_warc,
    "op9_jaccard_join": jaccard.op9_jaccard_join,
    "op10_bpe": bpe.op10_bpe,
    "rule_ablations": quality_rules.op7_rule_ablations,
    "neighbours_exact": ann.op5_exact,
    "neighbours_recall": ann.op5_recall,
}

ORACLE_SQL = {
    "op1_jump_sharding": sharding.OP1_SQL,
    "op7_rule_ledger": quality_rules.OP7_SQL,
    "op8_warc": warc.OP8_SQL,
    "op9_jaccard_join": jaccard.OP9_SQL,
    "rule_ablations": quality_rules.OP7_ABLATIONS_SQL,
    "neighbours_exact": ann.OP5_EXACT_SQL,
}
