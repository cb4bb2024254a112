"""The queries of this subpackage, and their SQL where SQL can express them."""

from loomgram.llm import decontaminate, html, language, lattice, packing, quality, sharding, simhash, spelling, suffixes, topk, urls, whitening

QUERIES = {
    "op1_decontamination": decontaminate.op1_decontamination,
    "op2_sharding": sharding.op2_sharding,
    "op3_language": language.op3_language,
    "op4_topk": topk.op4_topk,
    "op5_simhash": simhash.op5_simhash,
    "op6_lattice": lattice.op6_lattice,
    "op7_suffixes": suffixes.op7_suffixes,
    "op8_quality": quality.op8_quality,
    "op9_packing": packing.op9_packing,
    "op10_html": html.op10_html,
    "op11_spelling": spelling.op11_spelling,
    "op12_whitening": whitening.op12_whitening,
    "op13_urls": urls.op13_urls,
}
ORACLES: dict[str, str] = {"op4_topk": topk.ORACLE, "op13_urls": urls.ORACLE}
