"""The queries of this subpackage, by name, and DuckDB SQL where it can express them."""

from __future__ import annotations

from panelweave.llm.alignment import op11_token_alignment
from panelweave.llm.backoff_lm import op6_stupid_backoff
from panelweave.llm.bpe import op5_bpe_roundtrip
from panelweave.llm.chat_tree import OP2_SQL, op2_chat_tree
from panelweave.llm.content_sort import OP12_SQL, op12_exact_dedup
from panelweave.llm.dataset_manifest import OP13_SQL, op13_dataset_manifest
from panelweave.llm.decontaminate import OP4_SQL, op4_decontaminate
from panelweave.llm.quality import op9_quality_ratio
from panelweave.llm.sharding import op10_shard_rows
from panelweave.llm.simhash import op7_simhash_components
from panelweave.llm.suffix_dedup import OP3_SQL, op3_substring_dedup
from panelweave.llm.toxicity import op8_toxicity
from panelweave.llm.warc_audit import OP1_SQL, op1_warc_audit

QUERIES = {
    "op1_warc_audit": op1_warc_audit,
    "op2_chat_tree": op2_chat_tree,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_decontaminate": op4_decontaminate,
    "op5_bpe_roundtrip": op5_bpe_roundtrip,
    "op6_stupid_backoff": op6_stupid_backoff,
    "op7_simhash_components": op7_simhash_components,
    "op8_toxicity": op8_toxicity,
    "op9_quality_ratio": op9_quality_ratio,
    "op10_shard_rows": op10_shard_rows,
    "op11_token_alignment": op11_token_alignment,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_dataset_manifest": op13_dataset_manifest,
}

ORACLE_SQL = {
    "op1_warc_audit": OP1_SQL,
    "op2_chat_tree": OP2_SQL,
    "op3_substring_dedup": OP3_SQL,
    "op4_decontaminate": OP4_SQL,
    "op12_exact_dedup": OP12_SQL,
    "op13_dataset_manifest": OP13_SQL,
}
