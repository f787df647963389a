"""The queries of this subpackage, by name, and the SQL that says the same where SQL can."""

from __future__ import annotations

from skuweave.llm.ann import op11_nearest
from skuweave.llm.embedjoin import op9_embeddings
from skuweave.llm.infill import OP13_SQL, op13_infill
from skuweave.llm.langid import op2_language
from skuweave.llm.lines import OP4_SQL, op4_lines
from skuweave.llm.mixing import op1_mix
from skuweave.llm.nearjoin import op8_jaccard
from skuweave.llm.packing import op5_pack
from skuweave.llm.phrases import OP12_SQL, op12_phrases
from skuweave.llm.quality import OP10_SQL, op10_quality
from skuweave.llm.sharding import op3_shards
from skuweave.llm.tokens import op7_tokens
from skuweave.llm.toxicity import op6_toxicity

QUERIES = {
    "op1_mix": op1_mix,
    "op2_language": op2_language,
    "op3_shards": op3_shards,
    "op4_lines": op4_lines,
    "op5_pack": op5_pack,
    "op6_toxicity": op6_toxicity,
    "op7_tokens": op7_tokens,
    "op8_jaccard": op8_jaccard,
    "op9_embeddings": op9_embeddings,
    "op10_quality": op10_quality,
    "op11_nearest": op11_nearest,
    "op12_phrases": op12_phrases,
    "op13_infill": op13_infill,
}

ORACLES = {"op4_lines": OP4_SQL, "op10_quality": OP10_SQL, "op12_phrases": OP12_SQL, "op13_infill": OP13_SQL}
