"""The corpus operators' queries and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from .decontaminate import OP7_SQL, op7_decontaminate
from .languages import op6_language_id
from .licenses import op2_license_scan
from .manifest import OP11_SQL, op11_manifest
from .mixing import op1_mix_sources
from .near_duplicates import OP9_SQL, op9_near_duplicates
from .quality import op4_quality_rules
from .repeats import OP12_SQL, op12_substring_dedup
from .resampling import OP13_SQL, op13_importance_resampling
from .secrets import op5_secret_scan
from .sharding import op8_shards
from .token_counts import op3_token_counts
from .warc import OP10_SQL, op10_warc

QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_license_scan": op2_license_scan,
    "op3_token_counts": op3_token_counts,
    "op4_quality_rules": op4_quality_rules,
    "op5_secret_scan": op5_secret_scan,
    "op6_language_id": op6_language_id,
    "op7_decontaminate": op7_decontaminate,
    "op8_shards": op8_shards,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_warc": op10_warc,
    "op11_manifest": op11_manifest,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_importance_resampling": op13_importance_resampling,
}
ORACLES = {
    "op7_decontaminate": OP7_SQL,
    "op9_near_duplicates": OP9_SQL,
    "op10_warc": OP10_SQL,
    "op11_manifest": OP11_SQL,
    "op12_substring_dedup": OP12_SQL,
    "op13_importance_resampling": OP13_SQL,
}
