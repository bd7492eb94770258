"""The queries of this subpackage, for __spark_entry__."""

from __future__ import annotations

from lamella.llm.chat import OP7_SQL, op7_chat_format
from lamella.llm.decontam import op6_decontaminate_wand
from lamella.llm.langid import op9_lang_ppm
from lamella.llm.lm import op3_lm_ppm
from lamella.llm.mixing import op8_mix_cube
from lamella.llm.neardup import op2_neardup_multi_index
from lamella.llm.oracles import OP2_SQL, OP10_SQL
from lamella.llm.paragraphs import op1_paragraph_dedup
from lamella.llm.repair import op4_tokens_repair
from lamella.llm.toxicity import op5_toxicity_gru
from lamella.llm.vectors import op10_vectors_flat_graph

QUERIES = {
    "op1_paragraph_dedup": op1_paragraph_dedup,
    "op2_neardup_multi_index": op2_neardup_multi_index,
    "op3_lm_ppm": op3_lm_ppm,
    "op4_tokens_repair": op4_tokens_repair,
    "op5_toxicity_gru": op5_toxicity_gru,
    "op6_decontaminate_wand": op6_decontaminate_wand,
    "op7_chat_format": op7_chat_format,
    "op8_mix_cube": op8_mix_cube,
    "op9_lang_ppm": op9_lang_ppm,
    "op10_vectors_flat_graph": op10_vectors_flat_graph,
}
ORACLE_SQL = {"op2_neardup_multi_index": OP2_SQL, "op7_chat_format": OP7_SQL, "op10_vectors_flat_graph": OP10_SQL}
