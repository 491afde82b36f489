"""The queries of the training-data operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from . import codes, html_text, langid, neardup, packing, pieces, quality, repeats, sharding, syncmers, tool_calls, topk


def queries() -> dict:
    """One query an operator, over its whole table with production parameters."""
    return {
        "op1_topk": topk.op1_topk,
        "op2_packing": packing.op2_packing,
        "op3_repeats": repeats.op3_repeats,
        "op4_tool_calls": tool_calls.op4_tool_calls,
        "op5_sharding": sharding.op5_sharding,
        "op6_quality": quality.op6_quality,
        "op7_html": html_text.op7_html,
        "op8_neardup": neardup.op8_neardup,
        "op9_syncmers": syncmers.op9_syncmers,
        "op10_pieces": pieces.op10_pieces,
        "op11_codes": codes.op11_codes,
        "op12_langid": langid.op12_langid,
    }


def oracle_sql() -> dict[str, str]:
    """The SQL of those that SQL can express."""
    return topk.ORACLE | tool_calls.ORACLE | codes.ORACLE
