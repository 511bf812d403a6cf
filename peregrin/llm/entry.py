"""The queries of this subpackage and their SQL, for the driver's contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import OP8_SQL, op8_event_sourced_chat
from .decontaminate import op2_cgk_decontamination
from .lines import OP3_SQL, op3_deletion_neighbourhood
from .minhash import OP9_SQL, op9_bayes_minhash
from .pieces import op10_offset_pieces
from .quality import OP7_SQL, op7_divergence_rules
from .sharding import OP4_SQL, op4_byte_prefix_shards
from .suffixes import OP5_SQL, op5_lcp_merge_dedup
from .token_files import op1_rans_token_files
from .warc import OP6_SQL, op6_warc_round_trip


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_rans_token_files, op2_cgk_decontamination, op3_deletion_neighbourhood, op4_byte_prefix_shards, op5_lcp_merge_dedup, op6_warc_round_trip, op7_divergence_rules, op8_event_sourced_chat, op9_bayes_minhash, op10_offset_pieces)}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_deletion_neighbourhood": OP3_SQL,
        "op4_byte_prefix_shards": OP4_SQL,
        "op5_lcp_merge_dedup": OP5_SQL,
        "op6_warc_round_trip": OP6_SQL,
        "op7_divergence_rules": OP7_SQL,
        "op8_event_sourced_chat": OP8_SQL,
        "op9_bayes_minhash": OP9_SQL,
    }
