"""The subpackage's queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from .annulus_clusters import OP13_SQL, op13_annulus_clusters
from .conversation_repair import OP11_SQL, op11_conversation_repair
from .decontamination import OP10_SQL, op10_decontamination
from .hilbert_shards import op3_hilbert_shards
from .license_scan import op7_license_scan
from .line_dedup import op9_line_dedup
from .ngram_join import OP2_SQL, op2_ngram_join
from .packing import op8_best_fit_packing
from .quality_classifier import op12_quality_classifier
from .quality_rules import op6_quality_rules
from .token_files import op1_token_files
from .toxicity import op4_toxicity
from .warc_fixity import OP5_SQL, op5_warc_fixity

QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_ngram_join": op2_ngram_join,
    "op3_hilbert_shards": op3_hilbert_shards,
    "op4_toxicity": op4_toxicity,
    "op5_warc_fixity": op5_warc_fixity,
    "op6_quality_rules": op6_quality_rules,
    "op7_license_scan": op7_license_scan,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_line_dedup": op9_line_dedup,
    "op10_decontamination": op10_decontamination,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_quality_classifier": op12_quality_classifier,
    "op13_annulus_clusters": op13_annulus_clusters,
}

QUERIES_SQL: dict[str, str] = {
    "op2_ngram_join": OP2_SQL,
    "op5_warc_fixity": OP5_SQL,
    "op10_decontamination": OP10_SQL,
    "op11_conversation_repair": OP11_SQL,
    "op13_annulus_clusters": OP13_SQL,
}
