"""The queries of this subpackage, by name, and their SQL where it can express them."""

from __future__ import annotations

import corpus_pipeline
from panelspark.llm.chat import OP8_SQL, op8_chat
from panelspark.llm.decontaminate import op5_decontaminate
from panelspark.llm.itemsets import OP12_SQL, op12_itemsets
from panelspark.llm.jaccard import OP3_SQL, op3_jaccard
from panelspark.llm.language import op6_language
from panelspark.llm.packing import op4_packing
from panelspark.llm.prefix_trie import OP11_SQL, op11_prefix_trie
from panelspark.llm.quality import op7_quality
from panelspark.llm.substring_dedup import OP1_SQL, op1_substring_dedup
from panelspark.llm.suffix_dedup import OP9_SQL, op9_suffix_dedup
from panelspark.llm.topk import OP10_SQL, op10_topk
from panelspark.llm.toxicity import op13_toxicity
from panelspark.llm.warc import OP2_SQL, op2_warc

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_substring_dedup": op1_substring_dedup,
    "op2_warc": op2_warc,
    "op3_jaccard": op3_jaccard,
    "op4_packing": op4_packing,
    "op5_decontaminate": op5_decontaminate,
    "op6_language": op6_language,
    "op7_quality": op7_quality,
    "op8_chat": op8_chat,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_topk": op10_topk,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_itemsets": op12_itemsets,
    "op13_toxicity": op13_toxicity,
}

ORACLE_SQL = {
    "op1_substring_dedup": OP1_SQL,
    "op2_warc": OP2_SQL,
    "op3_jaccard": OP3_SQL,
    "op8_chat": OP8_SQL,
    "op9_suffix_dedup": OP9_SQL,
    "op10_topk": OP10_SQL,
    "op11_prefix_trie": OP11_SQL,
    "op12_itemsets": OP12_SQL,
}
