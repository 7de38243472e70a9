"""Queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import decontaminate, elkan, jaccard, langid, media, mixing, pii, repeats, sharding, simhash, toxicity, urls, whitening

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_jaccard": jaccard.op2_jaccard,
    "op3_sharding": sharding.op3_sharding,
    "op4_fingerprints": simhash.op4_fingerprints,
    "op5_repeats": repeats.op5_repeats,
    "op6_language": langid.op6_language,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_urls": urls.op8_urls,
    "op9_mixing": mixing.op9_mixing,
    "op10_pii": pii.op10_pii,
    "op11_clusters": elkan.op11_clusters,
    "op12_media": media.op12_media,
    "op13_whitening": whitening.op13_whitening,
}

ORACLES = {
    "op2_jaccard": jaccard.ORACLE,
    "op5_repeats": repeats.ORACLE,
    "op9_mixing": mixing.ORACLE,
    "op11_clusters": elkan.ORACLE,
}
