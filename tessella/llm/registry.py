"""Queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from tessella.llm.ann import OP10_SQL, op10_nearest
from tessella.llm.bpe import op2_bpe
from tessella.llm.decontam import OP3_SQL, op3_decontamination
from tessella.llm.jaccard import OP6_SQL, op6_jaccard
from tessella.llm.langid import op12_language_id
from tessella.llm.licenses import op7_licenses
from tessella.llm.linededup import OP5_SQL, op5_line_dedup
from tessella.llm.pii import op1_pii
from tessella.llm.quality import op4_quality
from tessella.llm.secrets import op8_secrets
from tessella.llm.variants import op11_spelling_variants
from tessella.llm.warc import OP9_SQL, op9_warc
from tessella.llm.whitening import op13_embedding_whitening

QUERIES = {
    "op1_pii": op1_pii, "op2_bpe": op2_bpe, "op3_decontamination": op3_decontamination, "op5_line_dedup": op5_line_dedup, "op7_licenses": op7_licenses, "op8_secrets": op8_secrets, "op9_warc": op9_warc, "op10_nearest": op10_nearest, "op4_quality": op4_quality,
    "op6_jaccard": op6_jaccard, "op11_spelling_variants": op11_spelling_variants, "op12_language_id": op12_language_id,
    "op13_embedding_whitening": op13_embedding_whitening,
}
ORACLE: dict[str, str] = {"op3_decontamination": OP3_SQL, "op5_line_dedup": OP5_SQL, "op9_warc": OP9_SQL, "op10_nearest": OP10_SQL, "op6_jaccard": OP6_SQL}
