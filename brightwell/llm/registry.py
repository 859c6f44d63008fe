"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from brightwell.llm import chat, decontaminate, licenses, line_dedup, media, mixing, near_dup, secrets, suffix_dedup, toxicity

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_near_dedup": near_dup.op2_near_dedup,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_chat_format": chat.op4_chat_format,
    "op5_decontamination": decontaminate.op5_decontamination,
    "op6_license_scan": licenses.op6_license_scan,
    "op7_secret_scan": secrets.op7_secret_scan,
    "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
    "op9_media": media.op9_media,
    "op10_toxicity": toxicity.op10_toxicity,
}
ORACLE_SQL = {"op1_mixing": mixing.OP1_SQL, "op2_near_dedup": near_dup.OP2_SQL, "op3_line_dedup": line_dedup.OP3_SQL, "op4_chat_format": chat.OP4_SQL, "op8_suffix_dedup": suffix_dedup.OP8_SQL}
