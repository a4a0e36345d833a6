"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from seqloom.llm.ann import op9_additive_quantisation
from seqloom.llm.bounded import op13_bounded_space_packing
from seqloom.llm.bpe import op1_byte_bpe
from seqloom.llm.chat import OP10_SQL, op10_snapshot_collapse
from seqloom.llm.crosstok import op12_postings_cogroup
from seqloom.llm.jaccard import OP5_SQL, op5_size_aware_jaccard
from seqloom.llm.packing import op7_best_fit_packing
from seqloom.llm.pii import op4_weak_supervision_pii
from seqloom.llm.spelling import OP11_SQL, op11_spelling_halves
from seqloom.llm.substrings import op2_phrase_automata
from seqloom.llm.topk import OP6_SQL, op6_maxscore_topk
from seqloom.llm.toxicity import op3_counterfactual_toxicity
from seqloom.llm.warc import op8_dictionary_warc

QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_phrase_automata": op2_phrase_automata,
    "op3_counterfactual_toxicity": op3_counterfactual_toxicity,
    "op4_weak_supervision_pii": op4_weak_supervision_pii,
    "op5_size_aware_jaccard": op5_size_aware_jaccard,
    "op6_maxscore_topk": op6_maxscore_topk,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_dictionary_warc": op8_dictionary_warc,
    "op9_additive_quantisation": op9_additive_quantisation,
    "op10_snapshot_collapse": op10_snapshot_collapse,
    "op11_spelling_halves": op11_spelling_halves,
    "op12_postings_cogroup": op12_postings_cogroup,
    "op13_bounded_space_packing": op13_bounded_space_packing,
}

ORACLE_SQL = {
    "op5_size_aware_jaccard": OP5_SQL,
    "op6_maxscore_topk": OP6_SQL,
    "op10_snapshot_collapse": OP10_SQL,
    "op11_spelling_halves": OP11_SQL,
}
