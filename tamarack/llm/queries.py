"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from .centroids import OP12_SQL, op12_centroid_clusters
from .decontamination import OP7_SQL, op7_decontamination
from .language_id import op1_language_id
from .license_scan import op4_license_scan
from .media_columns import op8_media_columns
from .mixing import op10_mixing
from .ngram_join import OP9_SQL, op9_ngram_join
from .periodic_runs import op11_periodic_runs
from .secret_scans import OP6_SQL, op6_secret_scans
from .substring_dedup import OP3_SQL, op3_substring_dedup
from .token_counts import op2_token_counts
from .url_filters import op5_url_filters
from .warc import OP13_SQL, op13_warc

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_token_counts": op2_token_counts,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_license_scan": op4_license_scan,
    "op5_url_filters": op5_url_filters,
    "op6_secret_scans": op6_secret_scans,
    "op7_decontamination": op7_decontamination,
    "op8_media_columns": op8_media_columns,
    "op9_ngram_join": op9_ngram_join,
    "op10_mixing": op10_mixing,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_centroid_clusters": op12_centroid_clusters,
    "op13_warc": op13_warc,
}

ORACLES = {
    "op3_substring_dedup": OP3_SQL,
    "op6_secret_scans": OP6_SQL,
    "op7_decontamination": OP7_SQL,
    "op9_ngram_join": OP9_SQL,
    "op12_centroid_clusters": OP12_SQL,
    "op13_warc": OP13_SQL,
}
