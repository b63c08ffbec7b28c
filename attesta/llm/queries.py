"""The queries of the corpus operators, and DuckDB SQL for those that SQL can express."""

from attesta.llm.decontaminate import op5_decontamination
from attesta.llm.language import op3_language_id
from attesta.llm.lloyd import OP12_SQL, op12_lloyd_clusters
from attesta.llm.maintext import OP11_SQL, op11_main_text
from attesta.llm.mtree import OP7_SQL, op7_mtree_topk
from attesta.llm.packing import op8_cost_balanced_packing
from attesta.llm.quality import op4_quality_classifier
from attesta.llm.rans import op2_rans_tokens
from attesta.llm.secrets import op9_secret_scan
from attesta.llm.shards import OP1_SQL, op1_extendible_shards
from attesta.llm.simhash import op6_simhash_groups
from attesta.llm.spelling import OP13_SQL, op13_spelling_variants
from attesta.llm.warc import OP10_SQL, op10_arc_to_warc

QUERIES = {f.__name__: f for f in (op1_extendible_shards, op2_rans_tokens, op3_language_id, op4_quality_classifier, op5_decontamination, op6_simhash_groups, op7_mtree_topk, op8_cost_balanced_packing, op9_secret_scan, op10_arc_to_warc, op11_main_text, op12_lloyd_clusters, op13_spelling_variants)}
SQL = {"op1_extendible_shards": OP1_SQL, "op7_mtree_topk": OP7_SQL, "op10_arc_to_warc": OP10_SQL, "op11_main_text": OP11_SQL, "op12_lloyd_clusters": OP12_SQL, "op13_spelling_variants": OP13_SQL}
