"""Corpus preparation as stages over documents; see STAGES.

Each function takes (spark, docs, sf_dir) and works on all rows of ``docs``, the
rows that the stage before it kept. All but the last return the columns of
documents. Rows with a null or empty text, or a null doc_id, are kept by every
filter; rows that share a doc_id stay or go together in the near-duplicate
stage and are judged one by one in the others; no rows give no rows.
"""

from quern.llm import bpe, decontaminate, near_dup, secrets, toxicity
from quern.llm.common import cut, table


def remove_toxic(spark, docs, sf_dir):
    """Documents that the toxicity models reject go; learned from the labelled ones among ``docs``."""
    return toxicity.clean(docs, toxicity.labelled(docs, table(spark, sf_dir, "labels")))


def remove_near_duplicates(spark, docs, sf_dir):
    """The least doc_id of each group of near copies stays."""
    return near_dup.distinct(docs)


def remove_benchmark(spark, docs, sf_dir):
    """Documents that contain an item of benchmark go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def remove_secrets(spark, docs, sf_dir):
    """Secrets in texts are replaced; all documents stay."""
    return secrets.clean(docs)


def tokenize(spark, docs, sf_dir):
    """doc_id, n_tokens, ids, the text decoded from them, and both digests."""
    return bpe.encode(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("near_dedup", remove_near_duplicates),
    ("decontamination", remove_benchmark),
    ("secrets", remove_secrets),
    ("bpe", tokenize),
]
#: The classifier, the lexer and the tokenizer are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages in order over documents; what each keeps is written to the checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
