"""Vector search and reranking for batches of queries."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as Win
from pyspark.sql import functions as F

from sutraloom.runtime import collect_bounded

#: Query vectors that go out together; more come in further blocks.
BLOCK = 2_000
DIGITS = 6

# Words that a passage for an intent should name.
INTENT_WORDS = {
    "treatment": ("remedy", "treatment", "medicine", "cure", "therapy"),
    "diet": ("food", "diet", "eat", "avoid", "nutrition", "meal"),
    "lifestyle": ("routine", "lifestyle", "daily", "practice", "habit"),
    "symptoms": ("symptom", "sign", "manifest", "indicate"),
    "causes": ("cause", "reason", "origin", "due to"),
}


def top_k(vectors: DataFrame, key: str, vector: str, queries: DataFrame, query_key: str, query_vector: str, k: int = 5, block: int = BLOCK) -> DataFrame:
    """(query key, key, score): the k most similar vectors of each query by cosine, ties to the smaller key.

    Exact to DIGITS digits of the score: vectors that agree in these rank by key. A block of queries goes out by broadcast (its size is bounded by `block`); each task multiplies its vectors
    with it and keeps k of them per query, so that k rows per query and task move. Null and zero vectors match nothing;
    vectors of another length than the query are left out."""
    key_type, query_type = vectors.schema[key].dataType.simpleString(), queries.schema[query_key].dataType.simpleString()
    source = vectors.select(F.col(key).alias("_k"), F.col(vector).cast("array<double>").alias("_v")).where(F.col("_v").isNotNull())
    wanted = queries.select(F.col(query_key).alias("i"), F.col(query_vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull())
    blocks = max(1, -(-wanted.count() // block))
    result = None
    for b in range(blocks):
        rows = collect_bounded(wanted.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b), 3 * block + 1_000, "query vectors of a block")
        groups: dict[int, tuple[list, list]] = {}
        for r in rows:
            v = np.array(r["v"], dtype=np.float64)
            if (norm := np.linalg.norm(v)) > 0:
                ids, vs = groups.setdefault(len(v), ([], []))
                ids.append(r["i"])
                vs.append(v / norm)
        held = vectors.sparkSession.sparkContext.broadcast({n: (ids, np.stack(vs)) for n, (ids, vs) in groups.items()})

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            best: dict = {}
            for batch in batches:
                lists, keys = batch.column(1), batch.column(0)
                flat = lists.flatten().to_numpy(zero_copy_only=False)
                lengths = np.asarray(pc.list_value_length(lists).fill_null(0))
                starts = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(lengths) else lengths
                for n, (ids, q) in held.value.items():
                    at = np.flatnonzero(lengths == n)
                    m = flat[starts[at][:, None] + np.arange(n)]
                    norms = np.linalg.norm(m, axis=1)
                    good = norms > 0
                    at, m, norms = at[good], m[good], norms[good]
                    if not len(at):
                        continue
                    scores = np.round((m / norms[:, None]) @ q.T, DIGITS)
                    # all rows at or above each query's k-th score: ties are settled by key when queries merge
                    least = np.partition(scores, len(at) - k, axis=0)[len(at) - k] if len(at) > k else np.full(len(ids), -2.0)
                    picked: dict[int, list] = {}
                    for row, j in zip(*np.nonzero(scores >= least)):
                        picked.setdefault(j, []).append((-float(scores[row, j]), keys[int(at[row])].as_py()))
                    for j, found in picked.items():
                        best[ids[j]] = heapq.nsmallest(k, best.get(ids[j], []) + found)
            rows = [(i, key, -s) for i, mine in best.items() for s, key in mine]
            yield pa.RecordBatch.from_pydict({"q": [r[0] for r in rows], "k": [r[1] for r in rows], "s": [r[2] for r in rows]}, schema=schema)

        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import StructType

        out = StructType.fromDDL(f"q {query_type}, k {key_type}, s double")
        schema = to_arrow_schema(out)
        part = source.mapInArrow(run, out)
        result = part if result is None else result.unionByName(part)
    rank = F.row_number().over(Win.partitionBy("q").orderBy(F.desc("s"), "k"))
    ranked = result.withColumn("_r", rank).where(F.col("_r") <= k)
    return ranked.select(F.col("q").alias(query_key), F.col("k").alias(key), F.col("s").alias("score"))


def best_per_document(hits: DataFrame, group: str, key: str, limit: int) -> DataFrame:
    """Of the hits of several queries of one group: each document once with its best score, the best `limit` of them."""
    best = hits.groupBy(group, key).agg(F.max("score").alias("score"))
    rank = F.row_number().over(Win.partitionBy(group).orderBy(F.desc("score"), key))
    return best.withColumn("_r", rank).where(F.col("_r") <= limit).drop("_r")


def words_named(text: Column, words: tuple[str, ...]) -> Column:
    """How many of the words a text contains, in any case; none for a null text."""
    low = F.lower(text)
    total = F.lit(0)
    for w in words:
        total = total + F.coalesce(F.contains(low, F.lit(w)).cast("int"), F.lit(0))
    return total


def intent_score(text: Column, intent: Column) -> Column:
    """Share of the intent's words that a text contains; 0 for an intent without words."""
    cases = F.lit(0.0)
    for name, words in INTENT_WORDS.items():
        cases = F.when(intent == name, F.least(F.lit(1.0), words_named(text, words) / len(words))).otherwise(cases)
    return cases


def length_score(text: Column) -> Column:
    n = F.length(text)
    return F.when(n.isNull(), 0.0).when(n.between(200, 1000), 1.0).when(n < 200, n / 200.0).otherwise(0.8)


def rerank(hits: DataFrame, group: str, key: str, text: str, source: str, intent: Column, k: int = 5) -> DataFrame:
    """Hits with semantic, intent, diversity, quality and final score, the best k of each group.

    A group has the few hits that retrieval left, so its windows are small whatever the corpus. Ties: by score, then
    key. Where the best score is not positive, semantic scores are 0."""
    own, same = Win.partitionBy(group), Win.partitionBy(group, source)
    top = F.max("score").over(own)
    scored = (
        hits.withColumn("semantic_score", F.when(top > 0, F.col("score") / top).otherwise(0.0))
        .withColumn("intent_score", F.coalesce(intent_score(F.col(text), intent), F.lit(0.0)))
        .withColumn("diversity_score", 1.0 / F.count("*").over(same))
        .withColumn("quality_score", F.coalesce(length_score(F.col(text)), F.lit(0.0)))
    )
    final = F.col("semantic_score") * 0.50 + F.col("intent_score") * 0.25 + F.col("diversity_score") * 0.15 + F.col("quality_score") * 0.10
    scored = scored.withColumn("final_score", final)
    rank = F.row_number().over(own.orderBy(F.desc(F.round("final_score", 9)), F.desc("score"), key))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def rendered_context(reranked: DataFrame, group: str, text: str, source: str, page: str) -> DataFrame:
    """(group, context): the passages in rank order under their sources, blank lines between."""
    part = F.format_string("[Source %d: %s, Page %s]\n%s", "rank", F.coalesce(source, F.lit("unknown")), F.coalesce(F.col(page), F.lit(-1)).cast("string"), F.coalesce(text, F.lit("")))
    ordered = F.array_sort(F.collect_list(F.struct("rank", part.alias("part"))))
    return reranked.groupBy(group).agg(F.array_join(F.transform(ordered, lambda x: x["part"]), "\n\n").alias("context"))


def confidence(reranked: DataFrame, group: str, text: str, answer_length: Column | None = None, cites: Column | None = None, coverage: Column | None = None) -> DataFrame:
    """(group, confidence) of an answer from its passages: 0.40 mean final score, 0.20 number of passages (of five), 0.15
    answer length (of 400), 0.15 citations (of three), 0.10 entity coverage; at most 1. Without an answer, the passages
    stand for it."""
    length = answer_length if answer_length is not None else F.sum(F.coalesce(F.length(text), F.lit(0)))
    cited = cites if cites is not None else F.count("*")
    covered = coverage if coverage is not None else F.lit(0.5)
    part = lambda x, of: F.least(x / of, F.lit(1.0))
    value = F.avg("final_score") * 0.40 + part(F.count("*"), 5.0) * 0.20 + part(length, 400.0) * 0.15 + part(cited, 3.0) * 0.15 + covered * 0.10
    return reranked.groupBy(group).agg(F.round(F.least(value, F.lit(1.0)), 6).alias("confidence"))


def answer_confidence(score: Column, passages: Column, answer: Column, cited: Column, covered: Column) -> Column:
    """Confidence of one answer from the mean final score and the number of its passages, its length, citations and
    coverage of entities, weighted as in `confidence`; 0 without passages."""
    part = lambda x, of: F.least(x / of, F.lit(1.0))
    value = score * 0.40 + part(passages, 5.0) * 0.20 + part(F.length(answer), 400.0) * 0.15 + part(cited, 3.0) * 0.15 + covered * 0.10
    return F.when(passages > 0, F.round(F.least(value, F.lit(1.0)), 6)).otherwise(0.0)


def pooled(vectors: Column, mask: Column) -> Column:
    """Mean of a sequence's vectors where the mask is 1, scaled to length 1 (a mask of zeros gives zeros)."""
    kept = F.filter(F.zip_with(vectors, mask, lambda v, m: F.when(m == 1, v)), lambda v: v.isNotNull())
    size = F.greatest(F.size(kept).cast("double"), F.lit(1e-9))
    total = F.aggregate(F.slice(kept, 2, F.greatest(F.size(kept) - 1, F.lit(0))), F.try_element_at(kept, F.lit(1)), lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    mean = F.transform(total, lambda x: x / size)
    norm = F.sqrt(F.aggregate(mean, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(mean, lambda x: x / F.greatest(norm, F.lit(1e-12)))
