"""The queries of this subpackage and their SQL oracles."""

from __future__ import annotations

from sparsemill.llm.bpe import op1_byte_bpe
from sparsemill.llm.chat import OP8_SQL, op8_reply_trees
from sparsemill.llm.langid import op6_language_id
from sparsemill.llm.lm import op3_deleted_interpolation
from sparsemill.llm.mixing import OP9_SQL, op9_curriculum_mix
from sparsemill.llm.ogg import op7_ogg_media
from sparsemill.llm.sharding import op10_kd_tree_shards
from sparsemill.llm.simhash import op4_simhash
from sparsemill.llm.spelling import OP13_SQL, op13_spelling_variants
from sparsemill.llm.substring_dedup import OP2_SQL, op2_substring_dedup
from sparsemill.llm.suffix import OP11_SQL, op11_suffix_decontamination
from sparsemill.llm.topk import OP5_SQL, op5_exact_top_k
from sparsemill.llm.trie import OP12_SQL, op12_prefix_trie

QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_deleted_interpolation": op3_deleted_interpolation,
    "op4_simhash": op4_simhash,
    "op5_exact_top_k": op5_exact_top_k,
    "op6_language_id": op6_language_id,
    "op7_ogg_media": op7_ogg_media,
    "op8_reply_trees": op8_reply_trees,
    "op9_curriculum_mix": op9_curriculum_mix,
    "op10_kd_tree_shards": op10_kd_tree_shards,
    "op11_suffix_decontamination": op11_suffix_decontamination,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLES: dict[str, str] = {
    "op2_substring_dedup": OP2_SQL,
    "op5_exact_top_k": OP5_SQL,
    "op8_reply_trees": OP8_SQL,
    "op9_curriculum_mix": OP9_SQL,
    "op11_suffix_decontamination": OP11_SQL,
    "op12_prefix_trie": OP12_SQL,
    "op13_spelling_variants": OP13_SQL,
}
