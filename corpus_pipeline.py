"""The corpus pipeline: documents in, packed training sequences out, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs. All
but the last return the columns of documents. Null texts fail the quality rules, an empty table gives an empty result, and
other columns pass through all but the last stage.
"""

from __future__ import annotations

from partwise.llm.decontamination import clean_documents
from partwise.llm.packing import pack
from partwise.llm.quality_rules import filter_documents
from partwise.llm.secret_scan import redact
from partwise.llm.shared import table, written
from partwise.llm.signature_join import one_of_each_group


def quality_rules(spark, docs, sf_dir):
    """Drops rejected documents, and failed lines from the others."""
    return filter_documents(docs, clean=True)


def near_duplicates(spark, docs, sf_dir):
    """Keeps the document with the least id of each group of linked documents."""
    return one_of_each_group(docs)


def decontamination(spark, docs, sf_dir):
    """Drops documents contaminated with benchmark items."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark, docs, sf_dir):
    """Masks the spans of secrets."""
    return redact(docs)


def packing(spark, docs, sf_dir):
    """Pieces of all documents in sequences."""
    return pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secrets),
    ("packing", packing),
]

# Components, the order of packing and the tokeniser are not expressible; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name.replace(' ', '-')}")
    return docs
