"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from brackwater.llm import alignment, chat, decontaminate, negatives, packing, quality, rules, secrets, sharding, simhash, suffixes, toxicity, warc

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_sharding": sharding.op2_sharding,
    "op3_suffix_dedup": suffixes.op3_suffix_dedup,
    "op4_chat": chat.op4_chat,
    "op5_warc": warc.op5_warc,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_quality_rules": rules.op7_quality_rules,
    "op9_packing": packing.op9_packing,
    "op10_quality": quality.op10_quality,
    "op8_simhash": simhash.op8_simhash,
    "op11_alignment": alignment.op11_alignment,
    "op12_secrets": secrets.op12_secrets,
    "op13_negatives": negatives.op13_negatives,
    "rules_policies": rules.rules_policies,
    "rules_ablations": rules.rules_ablations,
}

ORACLE_SQL: dict[str, str] = {"op3_suffix_dedup": suffixes.OP3_SQL, "op4_chat": chat.OP4_SQL, "op5_warc": warc.OP5_SQL, "op6_decontaminate": decontaminate.OP6_SQL, "op7_quality_rules": rules.OP7_SQL, "op13_negatives": negatives.OP13_SQL, "rules_policies": rules.POLICIES_SQL, "rules_ablations": rules.ABLATIONS_SQL}
