"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from strataline.llm.brown import op2_brown_lm
from strataline.llm.decontaminate import OP4_SQL, op4_decontaminate
from strataline.llm.langid import op7_langid
from strataline.llm.mixing import op12_mix_sources
from strataline.llm.packing import op10_sum_of_squares_packing
from strataline.llm.pii import op8_pii_feistel
from strataline.llm.prefixtrie import OP13_SQL, op13_prefix_trie
from strataline.llm.quality import op1_quality_fm
from strataline.llm.simhash import op6_simhash
from strataline.llm.tokenbin import op9_token_segments
from strataline.llm.topk import OP3_SQL, op3_topk
from strataline.llm.toxicity import op5_toxicity_chain
from strataline.llm.whitening import op11_whiten

QUERIES = {
    "op1_quality_fm": op1_quality_fm,
    "op2_brown_lm": op2_brown_lm,
    "op3_topk": op3_topk,
    "op4_decontaminate": op4_decontaminate,
    "op5_toxicity_chain": op5_toxicity_chain,
    "op6_simhash": op6_simhash,
    "op7_langid": op7_langid,
    "op8_pii_feistel": op8_pii_feistel,
    "op9_token_segments": op9_token_segments,
    "op10_sum_of_squares_packing": op10_sum_of_squares_packing,
    "op11_whiten": op11_whiten,
    "op12_mix_sources": op12_mix_sources,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLE_SQL: dict[str, str] = {"op3_topk": OP3_SQL, "op4_decontaminate": OP4_SQL, "op13_prefix_trie": OP13_SQL}
