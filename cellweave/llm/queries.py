"""The training-data queries and, where SQL can say the same, their SQL."""

from __future__ import annotations

from . import decontaminate, jaccard, knn, pieces, pii, quality, secrets, tokenfile, toxicity, warc

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_knn": knn.op2_knn,
    "op3_pieces": pieces.op3_pieces,
    "op4_token_files": tokenfile.op4_token_files,
    "op5_jaccard": jaccard.op5_jaccard,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_pii": pii.op7_pii,
    "op8_quality": quality.op8_quality,
    "op9_secret_scan": secrets.op9_secret_scan,
    "op10_warc": warc.op10_warc,
}

ORACLES = {
    "op1_decontaminate": decontaminate.ORACLE,
    "op2_knn": knn.ORACLE,
    "op5_jaccard": jaccard.ORACLE,
    "op10_warc": warc.ORACLE,
}
