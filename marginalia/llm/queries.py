"""Queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .media_png import op8_media_png
from .merkle_manifest import OP13_SQL, op13_merkle_manifest
from .phrases import OP12_SQL, op12_phrases
from .piece_bpe import op6_piece_bpe
from .quality_knn import op5_quality_knn
from .reply_trees import OP11_SQL, op11_reply_trees
from .secret_scan import op1_secret_scan
from .simhash_groups import op7_simhash_groups
from .spaced_seeds import op9_spaced_seeds
from .token_shards import op4_token_shards
from .toxicity_ordinal import op3_toxicity_ordinal
from .url_rules import OP2_SQL, op2_url_rules
from .warc_store import OP10_SQL, op10_warc_store


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (op1_secret_scan, op2_url_rules, op3_toxicity_ordinal, op4_token_shards, op5_quality_knn, op6_piece_bpe, op7_simhash_groups, op8_media_png, op9_spaced_seeds, op10_warc_store, op11_reply_trees, op12_phrases, op13_merkle_manifest)
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    return {"op2_url_rules": OP2_SQL, "op10_warc_store": OP10_SQL, "op11_reply_trees": OP11_SQL, "op12_phrases": OP12_SQL, "op13_merkle_manifest": OP13_SQL}
