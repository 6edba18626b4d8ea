"""The ``opN_<name>`` queries and, where SQL can say the same, their SQL."""

from __future__ import annotations

from tessera.llm import bpe, chat, decontaminate, html, images, licenses, lm, minhash, suffix, toxicity

QUERIES = {
    "op1_chat": chat.op1_chat,
    "op2_lm": lm.op2_lm,
    "op3_suffix": suffix.op3_suffix,
    "op4_licenses": licenses.op4_licenses,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_minhash": minhash.op6_minhash,
    "op7_images": images.op7_images,
    "op8_bpe": bpe.op8_bpe,
    "op9_html": html.op9_html,
    "op10_decontaminate": decontaminate.op10_decontaminate,
}

ORACLES = {
    "op1_chat": chat.ORACLE_SQL,
    "op3_suffix": suffix.ORACLE_SQL,
    "op6_minhash": minhash.ORACLE_SQL,
    "op10_decontaminate": decontaminate.ORACLE_SQL,
}
