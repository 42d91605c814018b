"""The driver's queries over the training-data operators."""

from __future__ import annotations

from glossmill.llm import alignment, embeddings, fingerprints, language, mixing, packing, quality, ranking, rules, secrets, simhash, substrings, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_rules": rules.op2_rules,
    "op3_quality": quality.op3_quality,
    "op4_packing": packing.op4_packing,
    "op5_secrets": secrets.op5_secrets,
    "op6_substrings": substrings.op6_substrings,
    "op7_language": language.op7_language,
    "op8_simhash": simhash.op8_simhash,
    "op9_embeddings": embeddings.op9_embeddings,
    "op10_mixing": mixing.op10_mixing,
    "op11_fingerprints": fingerprints.op11_fingerprints,
    "op12_alignment": alignment.op12_alignment,
    "op13_search": ranking.op13_search,
}
SQL = {"op5_secrets": secrets.SQL, "op10_mixing": mixing.SQL, "op13_search": ranking.SQL}
