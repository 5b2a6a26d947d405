"""Queries of this subpackage and the SQL some of them are checked against."""

from __future__ import annotations

from eoframe.llm import credentials, exact, hosts, merkle, mixing, packing, prefixes, quality, quotes, repeats, simhash, spots, toxicity

RUNS = {
    "op1_suffix_array_dedup": repeats.op1_suffix_array_dedup,
    "op2_packing": packing.op2_packing,
    "op3_quotation_linking": quotes.op3_quotation_linking,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_simhash_near_dedup": simhash.op5_simhash_near_dedup,
    "op6_spot_fingerprints": spots.op6_spot_fingerprints,
    "op7_credential_scan": credentials.op7_credential_scan,
    "op8_exact_dedup": exact.op8_exact_dedup,
    "op9_url_reputation": hosts.op9_url_reputation,
    "op10_mixing": mixing.op10_mixing,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_quality": quality.op12_quality,
    "op13_prefix_trie": prefixes.op13_prefix_trie,
}

SQL = {"op8_exact_dedup": exact.OP8_SQL, "op11_merkle_manifest": merkle.OP11_SQL, "op13_prefix_trie": prefixes.OP13_SQL}
