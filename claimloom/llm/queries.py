"""Queries and oracle SQL of this subpackage, which the driver's entry module adds where it can be imported."""

from __future__ import annotations

from claimloom.llm import ann, exact, language, manifest, minhash, mixing, packing, repair, secrets, sharding, substring, toxicity, warc

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_substring": substring.op2_substring,
    "op3_language": language.op3_language,
    "op4_secrets": secrets.op4_secrets,
    "op5_exact_dedup": exact.op5_exact_dedup,
    "op6_packing": packing.op6_packing,
    "op7_ann": ann.op7_ann,
    "op8_sharding": sharding.op8_sharding,
    "op9_minhash": minhash.op9_minhash,
    "op10_mixing": mixing.op10_mixing,
    "op11_warc": warc.op11_warc,
    "op12_manifest": manifest.op12_manifest,
    "op13_repair": repair.op13_repair,
}

#: Those that SQL can express over whole tables; the others are tested against brute force.
ORACLES = {"op2_substring": substring.OP2_SQL, "op9_minhash": minhash.OP9_SQL, "op5_exact_dedup": exact.OP5_SQL, "op10_mixing": mixing.OP10_SQL, "op11_warc": warc.OP11_SQL, "op12_manifest": manifest.OP12_SQL, "op13_repair": repair.OP13_SQL}
