"""The queries of this subpackage, and SQL for those that SQL can express."""

from .op01_bpe import op1_bpe_pair_index
from .op02_chat import op2_chat_format
from .op03_pii import op3_pii_disclosure
from .op04_exact import OP4_SQL, op4_exact_radix
from .op05_quality import op5_quality_kneser_ney
from .op06_suffix import op6_suffix_merge
from .op07_media import op7_media_sniff
from .op08_packing import op8_vector_packing
from .op09_blocks import op9_substring_blocks
from .op10_simhash import op10_simhash_bitslice
from .op11_counts import op11_token_counts
from .op12_search import OP12_SQL, op12_treap_search
from .op13_periods import op13_periodic_runs

QUERIES = {f.__name__: f for f in (op1_bpe_pair_index, op2_chat_format, op3_pii_disclosure, op4_exact_radix, op5_quality_kneser_ney, op6_suffix_merge, op7_media_sniff, op8_vector_packing, op9_substring_blocks, op10_simhash_bitslice, op11_token_counts, op12_treap_search, op13_periodic_runs)}
SQL = {"op4_exact_radix": OP4_SQL, "op12_treap_search": OP12_SQL.strip()}
