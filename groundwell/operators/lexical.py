"""Okapi BM25 over a corpus, for many questions at once.

Layout. The text never moves. Each task holds the weighted terms of a block of questions, whose number
is bounded, counts them inside each document's own row, and keeps the k best documents of each
question seen so far; only those leave the task, for one small exchange by question. Documents of a batch are
scored in lots of bounded work, whatever the number of questions, and the k-th score of a question is a bar for
later ones. No shuffle is keyed
by term except the vocabulary count, which is combined map-side first, so a term found in every
document does not make a hot task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.bind import unroll
from ..functions.text import tokens
from ..session import BROADCAST_MAX_ROWS, cut_lineage
from .best import RunningBest

# The constants of the scoring formula.
K1, B, EPSILON = 1.5, 0.75, 0.25
LOT_CELLS = 1 << 20  # matches of a document's term and a question that are held at once, beside those of one document
DIGITS = 6  # scores are compared after rounding, so summation order cannot change a ranking


@dataclass(frozen=True)
class Corpus:
    """A corpus: one row per document with its tokens, and the vocabulary counts."""

    tokens: DataFrame
    vocabulary: DataFrame
    n_docs: int
    n_tokens: int
    mean_idf: float

    @property
    def mean_length(self) -> float:
        return self.n_tokens / self.n_docs if self.n_docs else 0.0


def raw_idf(df: Column, n_docs) -> Column:
    return F.log(F.lit(float(n_docs)) - df + 0.5) - F.log(df + 0.5)


def document_tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the document's tokens in order, in its own row."""
    return docs.select(F.col(doc_id).alias("doc_id"), tokens(F.col(text)).alias("tokens"))


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """term, df, n_tokens: in how many documents a term occurs; n_tokens sums to the corpus size.

    Each document sends every distinct term once, and its length with the first of them, so the
    counts need no shuffle by document and are combined before the one by term.
    """
    return token_vocabulary(document_tokens(docs, doc_id, text))


def token_vocabulary(tokenised: DataFrame) -> DataFrame:
    """`vocabulary` of documents that are cut into `tokens` already."""
    rows = tokenised.select(F.size("tokens").alias("dl"), F.array_distinct("tokens").alias("_distinct"))
    length = F.when(F.col("at") == 0, F.col("dl")).otherwise(0)
    return unroll(rows, "_distinct", "term", "at").groupBy("term").agg(
        F.count("*").alias("df"), F.sum(length).alias("n_tokens")
    )


def token_stats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Token and distinct-token counts per document; a map over the rows."""
    return docs.select(
        F.col(doc_id).alias("doc_id"), tokens(F.col(text)).alias("_t")
    ).select(
        "doc_id", F.size("_t").cast("bigint").alias("n_tokens"),
        F.size(F.array_distinct("_t")).cast("bigint").alias("n_distinct"),
    )


def build_corpus(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Corpus:
    """Tokenise and count. Tokens and vocabulary are written once; only three totals reach the driver."""
    return token_corpus(cut_lineage(document_tokens(docs, doc_id, text)))


def token_corpus(tokenised: DataFrame) -> Corpus:
    """The corpus of documents (doc_id, tokens). They are read several times, so pass them with their lineage cut."""
    vocab = cut_lineage(token_vocabulary(tokenised))
    n_docs = tokenised.count()
    totals = vocab.agg(
        F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"),
        F.coalesce(F.avg(raw_idf(F.col("df"), n_docs)), F.lit(0.0)).alias("mean_idf"),
    ).first()
    return Corpus(tokenised.select("doc_id", "tokens"), vocab, n_docs, int(totals["n_tokens"]), float(totals["mean_idf"]))


def corpus_idf(corpus: Corpus) -> DataFrame:
    """term, df, idf. A negative idf is replaced by a small share of the vocabulary's mean idf."""
    idf = raw_idf(F.col("df"), corpus.n_docs)
    floor = EPSILON * corpus.mean_idf
    return corpus.vocabulary.select("term", "df", F.when(idf < 0, F.lit(floor)).otherwise(idf).alias("idf"))


def question_terms(questions: DataFrame, qid: str = "qid", text: str = "text") -> DataFrame:
    """qid, term, qtf: repeated question terms count each time."""
    rows = questions.select(F.col(qid).alias("qid"), tokens(F.col(text)).alias("_tokens"))
    return unroll(rows, "_tokens", "term").groupBy("qid", "term").agg(F.count("*").alias("qtf"))


def _question_blocks(terms: DataFrame, max_rows: int) -> list[DataFrame]:
    """Blocks of question terms, each small enough to broadcast, split by question."""
    n_terms = terms.count()
    if n_terms <= max_rows:
        return [terms]
    n_blocks = -(-n_terms * 5 // (4 * max_rows))
    block = F.pmod(F.xxhash64("qid"), F.lit(n_blocks))
    return [terms.where(block == b) for b in range(n_blocks)]


def _lots(doc: np.ndarray, work: np.ndarray) -> Iterator[slice]:
    """Stretches of rows sorted by document, each of whole documents and of about `LOT_CELLS` work."""
    last = np.flatnonzero(np.append(doc[1:] != doc[:-1], True))
    lot = np.cumsum(work)[last] // LOT_CELLS
    ends = last[np.append(lot[1:] != lot[:-1], True)] + 1
    for start, end in zip([0, *ends[:-1].tolist()], ends.tolist()):
        yield slice(start, end)


def bm25_best(corpus: Corpus, weighted: DataFrame, k: int) -> DataFrame:
    """qid, doc_id, score: of each task, the k best documents of each question of a block.

    `weighted` (qid, term, weight) is one block; its number of rows is bounded by `_question_blocks`.
    """
    table = weighted.select("qid", "term", "weight").toArrow()
    names = pc.unique(table.column("qid"))
    names = names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names
    order = pc.sort_indices(table, [("term", "ascending")])
    table = table.take(order).combine_chunks()
    terms = pc.unique(table.column("term"))
    terms = terms.combine_chunks() if isinstance(terms, pa.ChunkedArray) else terms
    asker = pc.index_in(table.column("qid"), names).to_numpy().astype(np.int64)
    starts = np.searchsorted(pc.index_in(table.column("term"), terms).to_numpy(), np.arange(len(terms) + 1))
    weight = table.column("weight").to_numpy()
    shared = weighted.sparkSession.sparkContext.broadcast((names, terms, starts, asker, weight))
    kind, mean = corpus.tokens.schema["doc_id"].dataType.simpleString(), corpus.mean_length or 1.0
    schema = f"qid {weighted.schema['qid'].dataType.simpleString()}, doc_id {kind}, score double"

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, terms, starts, asker, weight = shared.value
        held = RunningBest(len(names), k)
        for batch in batches:
            lists = batch.column(1)
            sizes = np.where(lists.is_valid().to_numpy(zero_copy_only=False), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0).astype(np.int64)
            found = pc.index_in(lists.flatten(), terms).fill_null(-1).to_numpy().astype(np.int64)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            pairs, tf = np.unique(doc[found >= 0] * len(terms) + found[found >= 0], return_counts=True)
            if not len(pairs):
                continue
            doc, term = pairs // len(terms), pairs % len(terms)
            gain = tf * (K1 + 1.0) / (tf + K1 * (1.0 - B + B * sizes[doc] / mean))
            many = starts[term + 1] - starts[term]  # questions that ask the term
            for lot in _lots(doc, many):
                of, asked = doc[lot], many[lot]
                at = np.arange(asked.sum()) - np.repeat(np.cumsum(asked) - asked, asked) + np.repeat(starts[term[lot]], asked)
                cells, cell = np.unique(np.repeat(of, asked) * len(names) + asker[at], return_inverse=True)
                score = np.round(np.bincount(cell, weights=weight[at] * np.repeat(gain[lot], asked)), DIGITS)
                cells, score = cells[score > 0], score[score > 0]
                held.add(cells % len(names), -score, cells // len(names), batch.column(0))
        if held.ids is not None:
            yield pa.RecordBatch.from_arrays([names.take(pa.array(held.question)), held.ids, pa.array(-held.value)], ["qid", "doc_id", "score"])

    return corpus.tokens.select("doc_id", "tokens").mapInArrow(best, schema)


def best_per_question(scored: DataFrame, k: int, order: list[Column], rank: str = "rank") -> DataFrame:
    """The first k rows of each question. Each task keeps only its own first k before the shuffle."""
    window = W.partitionBy("qid").orderBy(*order)
    return scored.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def ranked(rows: DataFrame, order: list[Column], rank: str) -> DataFrame:
    """Number all rows of each question in the given order."""
    return rows.withColumn(rank, F.row_number().over(W.partitionBy("qid").orderBy(*order)))


def bm25_topk(
    corpus: Corpus,
    questions: DataFrame,
    k: int,
    qid: str = "qid",
    text: str = "text",
    max_block_terms: int = BROADCAST_MAX_ROWS,
) -> DataFrame:
    """qid, doc_id, score, rank: the k best documents of each question with a positive score.

    Question terms are held by every task, so their number is counted first; a larger set is answered
    block by block, each block within the bound and each question in exactly one block.
    """
    idf = corpus_idf(corpus)
    ranked = None
    for terms in _question_blocks(question_terms(questions, qid, text), max_block_terms):
        weighted = idf.join(F.broadcast(terms), "term").select(
            "qid", "term", (F.col("qtf") * F.col("idf")).alias("weight")
        )
        part = best_per_question(
            bm25_best(corpus, weighted, k), k, [F.desc("score"), F.asc("doc_id")]
        )
        ranked = part if ranked is None else ranked.unionByName(part)
    return ranked.select("qid", "doc_id", "score", "rank")
