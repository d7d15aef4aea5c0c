"""Queries of the training-data operators, and SQL where SQL can express them."""

from __future__ import annotations

from .closed_itemsets import OP12_SQL, op12_closed_itemsets
from .decontamination import OP9_SQL, op9_decontamination
from .hard_negatives import OP13_SQL, op13_hard_negatives
from .language_id import op1_language_id
from .license_scan import op3_license_scan
from .ngram_join import OP10_SQL, op10_ngram_jaccard
from .pii import op6_pii
from .quality_rules import ABLATION_SQL, OP5_SQL, op5_quality_rules, quality_ablation
from .secret_scan import op4_secret_scan
from .sentencepiece_codec import op8_sentencepiece
from .substring_dedup import op7_substring_dedup
from .token_records import op11_token_records
from .url_filter import op2_url_filter

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_url_filter": op2_url_filter,
    "op3_license_scan": op3_license_scan,
    "op4_secret_scan": op4_secret_scan,
    "op5_quality_rules": op5_quality_rules,
    "op6_pii": op6_pii,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_decontamination": op9_decontamination,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "op11_token_records": op11_token_records,
    "op12_closed_itemsets": op12_closed_itemsets,
    "op13_hard_negatives": op13_hard_negatives,
    "quality_ablation": quality_ablation,
}
SQL = {"quality_ablation": ABLATION_SQL, "op10_ngram_jaccard": OP10_SQL, "op12_closed_itemsets": OP12_SQL, "op13_hard_negatives": OP13_SQL, "op5_quality_rules": OP5_SQL, "op9_decontamination": OP9_SQL}
