"""The llm queries by name, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import corpus_pipeline

from .chat_tree import OP4_SQL, op4_chat_format
from .decontaminate import op5_decontaminate
from .hilbert_pack import op1_hilbert_pack
from .merkle import OP11_SQL, op11_merkle_manifest
from .near_dedup import op6_near_dedup
from .quality_crf import op7_quality_crf
from .resample import OP13_SQL, op13_importance_resample
from .secret_cnn import op9_secret_cnn
from .slack_pack import op12_slack_pack
from .suffix_dedup import op10_suffix_dedup
from .toxicity_fst import op2_toxicity_fst
from .url_filter import OP3_SQL, op3_url_filter
from .warc import OP8_SQL, op8_warc

QUERIES = {
    "op1_hilbert_pack": op1_hilbert_pack,
    "op2_toxicity_fst": op2_toxicity_fst,
    "op3_url_filter": op3_url_filter,
    "op4_chat_format": op4_chat_format,
    "op5_decontaminate": op5_decontaminate,
    "op6_near_dedup": op6_near_dedup,
    "op7_quality_crf": op7_quality_crf,
    "op8_warc": op8_warc,
    "op9_secret_cnn": op9_secret_cnn,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_slack_pack": op12_slack_pack,
    "op13_importance_resample": op13_importance_resample,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {"op3_url_filter": OP3_SQL, "op4_chat_format": OP4_SQL, "op8_warc": OP8_SQL, "op11_merkle_manifest": OP11_SQL, "op13_importance_resample": OP13_SQL} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
