"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parlance.llm.ann import op5_nearest_neighbours
from parlance.llm.decontamination import op8_decontamination
from parlance.llm.html_text import op6_html_text
from parlance.llm.langid import op7_language_id
from parlance.llm.minhash import op1_near_duplicates
from parlance.llm.oracles import near_duplicates_sql, substrings_sql, suffixes_sql
from parlance.llm.packing import op3_packing, packing_sql
from parlance.llm.sanitisation import op4_personal_data
from parlance.llm.sharding import op10_sharding
from parlance.llm.substrings import op2_substrings
from parlance.llm.suffixes import op9_suffixes


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_near_duplicates": op1_near_duplicates,
        "op2_substrings": op2_substrings,
        "op3_packing": op3_packing,
        "op4_personal_data": op4_personal_data,
        "op5_nearest_neighbours": op5_nearest_neighbours,
        "op6_html_text": op6_html_text,
        "op7_language_id": op7_language_id,
        "op8_decontamination": op8_decontamination,
        "op9_suffixes": op9_suffixes,
        "op10_sharding": op10_sharding,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_near_duplicates": near_duplicates_sql(),
        "op2_substrings": substrings_sql(),
        "op3_packing": packing_sql(),
        "op9_suffixes": suffixes_sql(),
    }
