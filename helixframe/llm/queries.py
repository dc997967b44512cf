"""The queries of this subpackage, each over whole tables, and their SQL."""

from helixframe.llm import decontam, langid, licenses, lm, mixing, neardup, pii, prefixtrie, quality, setjoin, topk, urls, whitening

QUERIES = {
    "op1_mix": mixing.op1_mix,
    "op2_urls": urls.op2_urls,
    "op3_decontaminate": decontam.op3_decontaminate,
    "op4_quality": quality.op4_quality,
    "op5_licenses": licenses.op5_licenses,
    "op6_topk": topk.op6_topk,
    "op7_lm": lm.op7_lm,
    "op8_pii": pii.op8_pii,
    "op9_neardup": neardup.op9_neardup,
    "op10_language": langid.op10_language,
    "op11_whitening": whitening.op11_whitening,
    "op12_prefix_trie": prefixtrie.op12_prefix_trie,
    "op13_setjoin": setjoin.op13_setjoin,
}
ORACLES = {"op1_mix": mixing.OP1_SQL, "op3_decontaminate": decontam.OP3_SQL, "op5_licenses": licenses.OP5_SQL, "op6_topk": topk.OP6_SQL, "op9_neardup": neardup.OP9_SQL, "op12_prefix_trie": prefixtrie.OP12_SQL, "op13_setjoin": setjoin.OP13_SQL}
