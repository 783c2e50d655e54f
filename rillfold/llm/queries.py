"""The queries over documents, and the SQL they are checked with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillfold.llm import langid, pack, tokens
from rillfold.session import table


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_ids(table(spark, d, "documents").select("doc_id", "text", "n_chars"), "byte_bpe_50k")


def p6_unsplit(spark: SparkSession, d: str) -> DataFrame:
    """Each text as one stretch without a split, two letters for each byte, after an empty line: what the tree encodes.

    The ids must give the stretch back, and be those that the tokenizer gives for it as a whole.
    """
    stretch = F.concat(F.lit("a\n\n"), F.translate(F.hex(F.encode("text", "utf-8")), "0123456789ABCDEF", "abcdefghijklmnop"))
    docs = table(spark, d, "documents").select("doc_id", stretch.alias("text"))
    return tokens.compared(docs, tokens.token_ids(docs, "byte_bpe_50k"), "byte_bpe_50k")


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack.pack(table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "pack_budgets"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """Per budget: the documents in containers, and whether none is overfull, each document is there as a whole and cut only if it must be, and little is unused."""
    return pack.fill(p7_containers(spark, d), table(spark, d, "pack_budgets"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = table(spark, d, "documents"), table(spark, d, "doc_langs")
    return langid.wrong_labels(docs, labels, model=langid.model_for(docs, labels, f"{d}/documents.parquet"))


def p8_segments(spark: SparkSession, d: str) -> DataFrame:
    """Each segment of each document, with language, confidence and letters."""
    docs, labels = table(spark, d, "documents"), table(spark, d, "doc_langs")
    found = langid.detect(docs, labels, model=langid.model_for(docs, labels, f"{d}/documents.parquet"))
    return found.select("doc_id", F.posexplode("segments").alias("segment", "s")).select("doc_id", "segment", "s.language", "s.confidence", "s.letters")


QUERIES = {f.__name__: f for f in (p6_ids, p6_unsplit, p7_containers, p7_fill, p8_found, p8_segments)}

SQL: dict[str, str] = {
    "p6_unsplit": """
        select doc_id, md5('a' || chr(10) || chr(10) || translate(hex(encode(text)), '0123456789ABCDEF', 'abcdefghijklmnop')) as text_md5, case when text is null then null else true end as same from documents""",
    "p7_fill": """
        select budget_id, (select count(*) from documents where text is not null and text <> '') as n_docs, true as none_overfull, true as all_whole, true as cut_only_if_must, true as little_unused from pack_budgets""",
}
