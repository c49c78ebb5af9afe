"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from .byte_bpe import op13_byte_bpe
from .chat_format import OP6_SQL, op6_chat_format
from .decontaminate import OP9_SQL, op9_benchmark_decontamination
from .hard_negatives import OP12_SQL, op12_hard_negatives
from .html_extract import op10_html_extract
from .license_scan import op8_license_scan
from .lm_score import op2_lm_score
from .near_dedup import op1_simhash_near_dedup
from .packing import op5_length_packing
from .pii import op4_pii_skip_chain
from .spelling_variants import op11_spelling_variants
from .topk_codes import OP7_SQL, op7_exact_topk_codes
from .toxicity import op3_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup,
        op2_lm_score,
        op3_toxicity,
        op4_pii_skip_chain,
        op5_length_packing,
        op6_chat_format,
        op7_exact_topk_codes,
        op8_license_scan,
        op9_benchmark_decontamination,
        op10_html_extract,
        op11_spelling_variants,
        op12_hard_negatives,
        op13_byte_bpe,
    )
}
ORACLE = {"op6_chat_format": OP6_SQL, "op7_exact_topk_codes": OP7_SQL, "op9_benchmark_decontamination": OP9_SQL, "op12_hard_negatives": OP12_SQL}
