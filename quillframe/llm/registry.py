"""The subpackage's queries and their SQL, by name."""

from __future__ import annotations

from . import ann, bpe, cap_filters, collocations, dart_minhash, hard_negatives, langid, licenses, packing, sharding, substring, toxicity, url_filter

QUERIES = {
    "op1_cap_filters": cap_filters.op1_cap_filters,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_langid": langid.op3_langid,
    "op4_posting_lists": ann.op4_posting_lists,
    "op5_sharding": sharding.op5_sharding,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_bpe": bpe.op7_bpe,
    "op8_substring_dedup": substring.op8_substring_dedup,
    "op9_packing": packing.op9_packing,
    "op10_minhash_dedup": dart_minhash.op10_minhash_dedup,
    "op11_collocations": collocations.op11_collocations,
    "op12_license_scan": licenses.op12_license_scan,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}

ORACLES = {
    "op1_cap_filters": cap_filters.ORACLE_SQL,
    "op2_url_filter": url_filter.ORACLE_SQL,
    "op4_posting_lists": ann.ORACLE_SQL,
    "op5_sharding": sharding.ORACLE_SQL,
    "op8_substring_dedup": substring.ORACLE_SQL,
    "op11_collocations": collocations.ORACLE_SQL,
    "op12_license_scan": licenses.ORACLE_SQL,
    "op13_hard_negatives": hard_negatives.ORACLE_SQL,
}
