"""The operators' queries by name, and their SQL where SQL can express them."""

from . import align, bpe, centroids, chat, decontam, fingerprint, html, license, lines, near, recipes, substrings, toxicity

QUERIES = {
    "op1_html": html.query,
    "op2_lines": lines.query,
    "op3_substrings": substrings.query,
    "op4_chat": chat.query,
    "op5_bpe": bpe.query,
    "op6_licenses": license.query,
    "op7_fingerprints": fingerprint.query,
    "op8_decontamination": decontam.query,
    "op9_jaccard": near.query,
    "op10_toxicity": toxicity.query,
    "op11_exact": recipes.query,
    "op12_clusters": centroids.query,
    "op13_alignment": align.query,
}
ORACLES = {
    "op3_substrings": substrings.SQL,
    "op4_chat": chat.SQL,
    "op6_licenses": license.SQL,
    "op7_fingerprints": fingerprint.SQL,
    "op8_decontamination": decontam.SQL,
    "op11_exact": recipes.SQL,
    "op12_clusters": centroids.SQL,
}
