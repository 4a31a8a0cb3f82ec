"""The queries of the training-data operators and their DuckDB SQL, for __spark_entry__."""

from palimpsest.llm.binary import op9_token_output
from palimpsest.llm.dedup import OP4_SQL, op4_exact_dedup
from palimpsest.llm.embeddings import op6_embedding_near_dedup
from palimpsest.llm.jaccard import op5_ngram_jaccard
from palimpsest.llm.langid import op8_language_id
from palimpsest.llm.lines import OP1_SQL, op1_line_dedup
from palimpsest.llm.mixing import op3_mix_sources
from palimpsest.llm.packing import op10_pack
from palimpsest.llm.scoring import op7_ngram_scores
from palimpsest.llm.tokens import op2_token_counts

QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_token_counts, op3_mix_sources, op4_exact_dedup, op5_ngram_jaccard, op6_embedding_near_dedup, op7_ngram_scores, op8_language_id, op9_token_output, op10_pack)}
ORACLES: dict[str, str] = {"op1_line_dedup": OP1_SQL, "op4_exact_dedup": OP4_SQL}
