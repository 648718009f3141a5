"""One query for each corpus operator, at production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barloom.llm.common import table

#: where the public vocabulary files are; a parameter of every operator that needs one
TOKENIZERS = {"ids": "word_bpe_49k.json", "pieces": "piece_bpe_32k.model"}


def tokenizer_path(kind: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZERS[kind]))


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.html import extract

    return extract(table(spark, sf_dir, "pages"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.quality import score, train

    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.pii import pii_digest

    return pii_digest(table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.spviterbi import encode

    return encode(table(spark, sf_dir, "documents"), tokenizer_path("pieces"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.decontaminate import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.audio import media_digest

    return media_digest(table(spark, sf_dir, "documents"))


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.tokenpack import token_files

    return token_files(table(spark, sf_dir, "documents"), tokenizer_path("ids"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.jaccard import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.lines import line_digest

    return line_digest(table(spark, sf_dir, "documents"))


def op10_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from barloom.llm.pfp import repeat_digest

    return repeat_digest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_main_text, op2_quality, op3_pii, op4_sentencepiece, op5_decontaminate, op6_media, op7_token_ids, op8_jaccard_join, op9_line_dedup, op10_repeated_bytes)}


def oracle_sql() -> dict[str, str]:
    from barloom.llm.lines import DIGEST_SQL

    return {"op9_line_dedup": DIGEST_SQL}
