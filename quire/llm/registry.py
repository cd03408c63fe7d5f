"""Queries of this subpackage, with SQL where SQL can say the same."""

from __future__ import annotations

from quire.llm import boilerplate, encoding, lookalike, mixing, pieces, residue, sentences, tokens

QUERIES = {
    "p1_found": sentences.p1_found,
    "p1_sentences": sentences.p1_sentences,
    "p2_found": pieces.p2_found,
    "p2_pieces": pieces.p2_pieces,
    "p2_files": pieces.p2_files,
    "p3_found": encoding.p3_found,
    "p3_repaired": encoding.p3_repaired,
    "p5_found": boilerplate.p5_found,
    "p5_lines": boilerplate.p5_lines,
    "p5_clean": boilerplate.p5_clean,
    "p6_found": lookalike.p6_found,
    "p6_forms": lookalike.p6_forms,
    "p7_ids": tokens.p7_ids,
    "p7_roundtrip": tokens.p7_roundtrip,
    "p8_mix": mixing.p8_mix,
    "p8_shares": mixing.p8_shares,
    "p9_found": residue.p9_found,
    "p9_clean": residue.p9_clean,
}

ORACLES = {
    "p2_found": """SELECT DISTINCT p.doc_id, p.sec, p.p FROM paragraphs p
 LEFT JOIN (SELECT doc_id, min(lang) AS lang FROM novel_files GROUP BY doc_id) f ON p.doc_id = f.doc_id
 LEFT JOIN voices v ON f.lang = v.lang
 WHERE length(p.text) > coalesce(v.max_chars, (SELECT max_chars FROM voices WHERE lang = 'und'))""",
    "p7_roundtrip": None,
}
ORACLES = {k: v for k, v in ORACLES.items() if v}
