"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, chat, contextmix, fingerprints, neardup, packing, quality, secrets, tokenfiles, toxicity

QUERIES = {
    "op1_fingerprints": fingerprints.op1_fingerprints,
    "op2_contextmix": contextmix.op2_contextmix,
    "op3_neardup": neardup.op3_neardup,
    "op4_quality": quality.op4_quality,
    "op5_perspectives": chat.op5_perspectives,
    "op6_secrets": secrets.op6_secrets,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_bpe": bpe.op8_bpe,
    "op9_tokenfiles": tokenfiles.op9_tokenfiles,
    "op10_packing": packing.op10_packing,
}
ORACLE = {"op5_perspectives": chat.OP5_SQL}
