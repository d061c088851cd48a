"""Search and recommendation. Vector work runs on bounded blocks with numpy and returns top-k rows only."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.scalars import safe_divide
from lumenframe.operators.features import term_counts, terms
from lumenframe.operators.neighbours import NEAR, QUERY_ROWS, Items, Search, matrix, nearest
from lumenframe.operators.scaling import attach_row, spread, top_per_group
from lumenframe.session import cut_lineage, scratch_path

BLOCK_ROWS = 2_048


def _unit(vectors: Sequence) -> np.ndarray:
    m = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> list[np.ndarray]:
    """Per row the positions of the k best finite scores, ties by id."""
    out = []
    for row in scores:
        at = np.flatnonzero(np.isfinite(row))
        if len(at) > 4 * k:
            cut = np.partition(row[at], len(at) - k)[len(at) - k]
            at = at[row[at] >= cut]
        out.append(at[np.lexsort((ids[at], -row[at]))][:k])
    return out


#: Rows of a block at most, some tens of megabytes, and queries that a task scores at a time.
MOST_BLOCK_ROWS, STRIP_QUERIES = 16_384, 512


def knn_join(queries: DataFrame, items: DataFrame, k: int, metric: str = "cosine", keys: Sequence[str] = (),
             skip_self: bool = True, earlier_only: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Exact k nearest items per query: ``(query_id, item_id, score, rank)``.

    Both inputs have ``id`` and ``vector`` (and the columns of ``keys``; only rows with equal keys are
    compared). Both sides are cut into blocks; a task sees one query block and one item block and
    returns k rows per query, so no pair list ever exists. Euclidean scores are negative distances.
    Each row is copied to all blocks of the other side, so blocks grow with the root of the rows, from ``block_rows`` up to ``MOST_BLOCK_ROWS``.
    """
    keys = list(keys)

    def block_of(n):
        return F.greatest(F.lit(block_rows), F.least(F.lit(MOST_BLOCK_ROWS), F.ceil(F.sqrt(n * F.lit(block_rows)))))

    def blocks(df, side):
        if not keys:
            count = df.count()
            n = -(-count // max(block_rows, min(MOST_BLOCK_ROWS, math.ceil(math.sqrt(count * block_rows))))) or 1
            return df.withColumn("_blk", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")), F.lit(n)
        sizes = df.groupBy(*keys).agg(F.ceil(F.count("*") / block_of(F.count("*"))).cast("int").alias(f"_n{side}"))
        return df.join(sizes, keys).withColumn("_blk", F.pmod(F.xxhash64("id"), F.col(f"_n{side}")).cast("int")), sizes

    cols = ("id", "vector", *keys)
    q, nq = blocks(queries.select(*[F.col(c).alias(c) for c in cols]), "q")
    i, ni = blocks(items.select(*[F.col(c).alias(c) for c in cols]), "i")
    if keys:
        q, i = q.join(ni, keys), i.join(nq, keys)
        span_i, span_q = F.col("_ni"), F.col("_nq")
    else:
        span_i, span_q = ni, nq
    q = q.withColumn("_qb", F.col("_blk")).withColumn("_ib", F.explode(F.sequence(F.lit(0), span_i - 1)))
    i = i.withColumn("_ib", F.col("_blk")).withColumn("_qb", F.explode(F.sequence(F.lit(0), span_q - 1)))
    on = [*keys, "_qb", "_ib"]

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "item_id": [], "score": []}).astype({"query_id": "int64", "item_id": "int64"})
        qi, ii = left["id"].to_numpy(), right["id"].to_numpy()
        form = _unit if metric == "cosine" else (lambda v: np.stack(v).astype(float))
        a, b = form(left["vector"]), form(right["vector"])
        out = []
        for at in range(0, len(qi), STRIP_QUERIES):
            x, mine = a[at : at + STRIP_QUERIES], qi[at : at + STRIP_QUERIES]
            s = x @ b.T if metric == "cosine" else -np.sqrt(np.maximum((x * x).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * x @ b.T, 0))
            if skip_self:
                s[mine[:, None] == ii[None]] = -np.inf
            if earlier_only:
                s[mine[:, None] <= ii[None]] = -np.inf
            picks = _best(s, ii, k)
            rows = np.repeat(np.arange(len(mine)), [len(p) for p in picks])
            cols = np.concatenate(picks) if picks else np.array([], dtype=int)
            out.append((mine[rows], ii[cols], s[rows, cols]))
        return pd.DataFrame(dict(zip(("query_id", "item_id", "score"), (np.concatenate(c) for c in zip(*out)))))

    def named(df):  # new column identities: both sides may come from one table
        return df.select(*[F.col(c).alias(c) for c in ("id", "vector", *on)])

    near = named(q).groupBy(*on).cogroup(named(i).groupBy(*on)).applyInPandas(nearest, "query_id bigint, item_id bigint, score double")
    if keys:
        near = near.groupBy("query_id", "item_id").agg(F.max("score").alias("score"))
    return top_per_group(near, ["query_id"], ["-score", "item_id"], k, "rank").select("query_id", "item_id", "score", "rank")


MAX_QUERIES = 4_096


def cosine_topk(queries: DataFrame, items: DataFrame, k: int, max_queries: int = MAX_QUERIES) -> DataFrame:
    """k best items for a small set of query vectors: one pass over the items without a shuffle of vectors.

    More than ``max_queries`` queries go to the blocked join instead.
    """
    rows = queries.select("id", "vector").limit(max_queries + 1).collect()
    if len(rows) > max_queries:
        return knn_join(queries, items, k, skip_self=False)
    qi = np.array([r["id"] for r in rows])
    qv = _unit([r["vector"] for r in rows]) if rows else np.zeros((0, 0))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = [(np.array([]), np.array([], dtype="int64")) for _ in qi]
        for pdf in batches:
            if not len(pdf) or not len(qi):
                continue
            ids = pdf["id"].to_numpy()
            s = qv @ _unit(pdf["vector"]).T
            for n, at in enumerate(_best(s, ids, k)):
                sc, ii = np.concatenate([best[n][0], s[n, at]]), np.concatenate([best[n][1], ids[at]])
                keep = np.lexsort((ii, -sc))[:k]
                best[n] = (sc[keep], ii[keep])
        for n, (sc, ii) in enumerate(best):
            if len(ii):
                yield pd.DataFrame({"query_id": np.repeat(qi[n], len(ii)), "item_id": ii, "score": sc})

    near = spread(items.select("id", "vector")).mapInPandas(scan, "query_id bigint, item_id bigint, score double")
    return top_per_group(near, ["query_id"], ["-score", "item_id"], k, "rank").select("query_id", "item_id", "score", "rank")


def _marked(df: DataFrame, bands: int, bits: int, dim: int, seed: int) -> DataFrame:
    """With ``_s``, per band the sign pattern of ``bits`` random projections."""
    planes = np.random.default_rng(seed).standard_normal((bands, bits, dim))

    @F.pandas_udf("array<bigint>")
    def signs(vectors: pd.Series) -> pd.Series:
        m = np.stack(vectors.to_numpy()).astype(float)
        bit = (np.einsum("nd,pbd->npb", m, planes) >= 0).astype(np.int64)
        return pd.Series(list((bit << np.arange(bits)).sum(2)))

    return df.withColumn("_s", signs("vector"))


def hyperplane_buckets(df: DataFrame, bands: int, bits: int, dim: int, seed: int = 0) -> DataFrame:
    """One row per band with the sign pattern of ``bits`` random projections."""
    return _marked(df, bands, bits, dim, seed).select(*df.columns, F.posexplode("_s").alias("band", "bucket"))


#: Numbers that the vectors of a block hold, rows of a block at least, and items that a query meets at a time.
LSH_BLOCK, LSH_LEAST_ROWS, LSH_STRIP = 4_194_304, 1_024, 2_048


def knn_lsh(queries: DataFrame, items: DataFrame, k: int, dim: int, bands: int = 12, bits: int = 5, seed: int = 0) -> DataFrame:
    """Approximate k nearest by random hyperplanes; candidates are compared exactly, big buckets in blocks.

    Pairs that share several buckets would be compared in each of them. Where that comes to more than all pairs, as with few and large buckets, every pair is met once, and counts if it shares a bucket.
    """
    marked = [stored(_marked(df.select("id", "vector"), bands, bits, dim, seed), "lsh-marks") for df in (queries, items)]
    buckets = [df.select(F.posexplode("_s").alias("band", "bucket")).groupBy("band", "bucket").agg(F.count("*").alias(n)) for df, n in zip(marked, ("q", "i"))]
    in_buckets = buckets[0].join(buckets[1], ["band", "bucket"]).agg(F.sum(F.col("q").cast("double") * F.col("i"))).first()[0] or 0.0
    rows, same = zip(*[df.groupBy("id").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(1))).first() for df in marked])
    if in_buckets <= rows[0] * rows[1]:
        each = [df.select("id", "vector", F.posexplode("_s").alias("band", "bucket")) for df in marked]
        return knn_join(*each, k, keys=["band", "bucket"])
    most = max(LSH_LEAST_ROWS, LSH_BLOCK // dim)
    i_blocks = -(-rows[1] // most)
    q_blocks = max(-(-rows[0] // most), min(-(-2 * queries.sparkSession.sparkContext.defaultParallelism // i_blocks), -(-rows[0] // LSH_LEAST_ROWS)))
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = marked[0].select("id", "vector", "_s", own(q_blocks).alias("_qb")).withColumn("_ib", every(i_blocks))
    i = marked[1].select("id", "vector", "_s", own(i_blocks).alias("_ib")).withColumn("_qb", every(q_blocks))

    def met(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return Search.of_nothing()
        (qi, a, qs), (ii, b, si) = ((t.column("id").to_numpy(), matrix(t.column("vector").combine_chunks()), t.column("_s").combine_chunks()) for t in (left, right))
        units = [np.divide(m, n, out=np.zeros_like(m), where=n > 0) for m in (a, b) for n in (np.linalg.norm(m, axis=1, keepdims=True),)]
        marks = [s.flatten().to_numpy().astype(np.int32 if bits < 32 else np.int64).reshape(len(s), -1) for s in (qs, si)]
        search = Search(qi, units[0], k * same[0] * same[1], "cosine", True, False, np.full(len(qi), np.inf), marks=marks[0])  # rows of one id count as one
        whole = Items(ii, units[1], "cosine", marks[1])
        cuts = [0, *range(LSH_STRIP // 4, len(ii), LSH_STRIP), len(ii)]
        for first in range(0, len(qi), QUERY_ROWS):
            for x, y in zip(cuts, cuts[1:]):
                search.meet(np.arange(first, min(first + QUERY_ROWS, len(qi))), whole.part(slice(x, y)))
        return search.result()

    near = q.groupBy("_qb", "_ib").cogroup(i.groupBy("_qb", "_ib")).applyInArrow(met, NEAR).groupBy("query_id", "item_id").agg(F.max("score").alias("score"))
    return top_per_group(near, ["query_id"], ["-score", "item_id"], k, "rank").select("query_id", "item_id", "score", "rank")


def group_centroids(df: DataFrame, label: str, vector: str) -> DataFrame:
    """Mean vector per label."""
    e = df.select(label, F.posexplode(vector).alias("pos", "x")).groupBy(label, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return e.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("vector"))  # one entry per dimension


def knn_classify(train: DataFrame, test: DataFrame, label: str, k: int) -> DataFrame:
    """Majority label of the k nearest (ties to the smaller label)."""
    near = nearest(test, train, k).join(train.select(F.col("id").alias("item_id"), F.col(label).alias("_l")), "item_id")
    votes = near.groupBy("query_id", "_l").agg(F.count("*").alias("n"))
    return votes.groupBy("query_id").agg(F.min_by("_l", F.struct(-F.col("n"), F.col("_l"))).alias("predicted"))


def knn_regress(train: DataFrame, test: DataFrame, target: str, k: int, metric: str = "cosine") -> DataFrame:
    near = nearest(test, train, k, metric).join(train.select(F.col("id").alias("item_id"), F.col(target).alias("_y")), "item_id")
    return near.groupBy("query_id").agg(F.avg("_y").alias("predicted"))


def inverted_index(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(term, document, tf) postings."""
    return term_counts(docs, id_col, text).select("term", id_col, "tf")


#: Documents and queries that meet in one task, and documents under one maximum.
DOC_BLOCK, QUERY_BLOCK, MAXIMA_BLOCK = 8_192, 4_096, 256


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written once, for those who read it several times."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bm25_topk(docs: DataFrame, queries: DataFrame, k: int, k1: float = 1.2, b: float = 0.75, doc_block: int = DOC_BLOCK, query_block: int = QUERY_BLOCK,
              scored=None) -> DataFrame:
    """BM25 over whole texts: ``docs(id, text)``, ``queries(id, text)``.

    One pass tokenises the documents and writes the postings of the queries' terms and the documents' lengths. Postings are dealt out by blocks of documents, so a term that most
    documents hold has a part in every block, and each block meets the queries by blocks too. Inside, a query adds up the maxima of its terms over small runs of documents: runs that can't
    reach the ``k``-th best score found so far are skipped, and k documents a query leave the task. ``scored``, an accumulator, counts the postings that were added up.
    """
    qterms = queries.select(F.col("id").alias("qid"), F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    words = spread(docs.select("id", "text")).select("id", terms(F.col("text")).alias("w"))
    # No term is empty: the empty string stands once in each document and brings its length along.
    vocabulary = stored(qterms.select("term").unionByName(qterms.sparkSession.createDataFrame([("",)], "term string")).distinct().withColumn("t", F.when(F.col("term") != "", F.monotonically_increasing_id())), "bm25-terms")
    each = F.explode(F.array_append(F.coalesce("w", F.array().cast("array<string>")), F.lit(""))).alias("term")
    held = words.select("id", F.coalesce(F.size("w"), F.lit(0)).alias("len"), each).join(vocabulary, "term").groupBy("id", "len", "t").agg(F.count("*").alias("tf"))
    written = stored(held, "bm25-postings")
    whole = written.where("t IS NULL").agg(F.count("*").alias("n"), F.avg("len").alias("avg")).first()
    n, avg = whole["n"], whole["avg"] or 1.0
    postings = written.where("t IS NOT NULL")
    idf = postings.groupBy("t").agg(F.log(1 + (F.lit(n) - F.count("*") + 0.5) / (F.count("*") + 0.5)).alias("idf"))
    asked = cut_lineage(qterms.join(vocabulary, "term").join(idf, "t").select("qid", "t", "idf"))
    d_blocks = max(-(-n // doc_block), min(docs.sparkSession.sparkContext.defaultParallelism, -(-n // 512)), 1)
    q_blocks = max(-(-queries.count() // query_block), 1)
    part = lambda c, blocks: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    copies = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = postings.select("id", "t", (F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.lit(avg)))).alias("impact"), part("id", d_blocks).alias("_d"), copies(q_blocks).alias("_q"))
    right = asked.select("qid", "t", "idf", part("qid", q_blocks).alias("_q"), copies(d_blocks).alias("_d"))
    near = left.groupBy("_d", "_q").cogroup(right.groupBy("_d", "_q")).applyInPandas(_score_block(k, scored), "query_id bigint, item_id bigint, score double")
    return top_per_group(near, ["query_id"], ["-score", "item_id"], k, "rank").select("query_id", "item_id", "score", "rank")


def _score_block(k: int, scored):
    def best_of(scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
        scores = np.round(scores, 10)  # equal texts tie, whatever the order of their sums
        at = np.flatnonzero(scores > 0)
        if len(at) > k:
            at = at[scores[at] >= np.partition(scores[at], len(at) - k)[len(at) - k]]
        return at[np.lexsort((ids[at], -scores[at]))][:k]

    def score(postings: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = ([], [], [])
        if len(postings) and len(asked):
            ids, doc = np.unique(postings["id"].to_numpy(), return_inverse=True)
            order = np.lexsort((doc, postings["t"].to_numpy()))
            doc, impact = doc[order], postings["impact"].to_numpy()[order]
            terms, start = np.unique(postings["t"].to_numpy()[order], return_index=True)
            stop = np.append(start[1:], len(doc))
            runs = len(ids) // MAXIMA_BLOCK + 1
            maxima = np.zeros((len(terms), runs))
            np.maximum.at(maxima, (np.repeat(np.arange(len(terms)), stop - start), doc // MAXIMA_BLOCK), impact)
            place = {t: j for j, t in enumerate(terms.tolist())}
            total = np.zeros(runs * MAXIMA_BLOCK)
            for qid, mine in asked.groupby("qid", sort=True):
                held = [(place[t], w) for t, w in zip(mine["t"].tolist(), mine["idf"].tolist()) if t in place]
                if not held:
                    continue
                which, weight = np.array([j for j, _ in held]), np.array([w for _, w in held])
                most = weight @ maxima[which]
                first = np.zeros(runs, bool)
                first[np.argsort(-most, kind="stable")[: max(1, runs // 8)]] = True
                total[:] = 0
                for chosen in (first, None):
                    if chosen is None:  # what could still come up to the k-th best
                        top = best_of(total[: len(ids)], ids)
                        floor = total[top[-1]] if len(top) == k else 0.0
                        chosen = ~first & (most >= floor * (1 - 1e-9))
                    if not chosen.any():
                        continue
                    whole = chosen.all()
                    for j, w in zip(which, weight):
                        d, x = doc[start[j] : stop[j]], impact[start[j] : stop[j]]
                        if not whole:
                            keep = chosen[d // MAXIMA_BLOCK]
                            d, x = d[keep], x[keep]
                        total[d] += w * x
                        if scored is not None:
                            scored.add(len(d))
                top = best_of(total[: len(ids)], ids)
                out[0].append(np.full(len(top), qid))
                out[1].append(ids[top])
                out[2].append(np.round(total[top], 10))
        cols = [np.concatenate(x) if x else np.zeros(0, kind) for x, kind in zip(out, (np.int64, np.int64, np.float64))]
        return pd.DataFrame(dict(zip(("query_id", "item_id", "score"), cols)))

    return score


def fuse_ranks(a: DataFrame, b: DataFrame, k: int, offset: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists."""
    both = a.select("query_id", "item_id", "rank").unionByName(b.select("query_id", "item_id", "rank"))
    s = both.groupBy("query_id", "item_id").agg(F.sum(1.0 / (offset + F.col("rank"))).alias("score"))
    return top_per_group(s, ["query_id"], ["-score", "item_id"], k, "rank")


#: Candidates that one task of the reranker's training holds, candidates that are trained on one by one, and bins of a feature, as the trees have them.
TRAIN_ROWS, EACH_TRAIN_ROWS, BINS = 200_000, 2_000_000, 32


def fit_reranker(candidates: DataFrame, features: Sequence[str], label: str, seed: int = 1):
    """Boosted trees on candidate features (position among them).

    Every tree reads all rows several times from memory, in the partitions they come in. A grouping gives few of them, as its rows are small, so many rows are dealt out again.
    Trees see no more of a feature than its bin, so beyond ``EACH_TRAIN_ROWS`` candidates those of the same bins are counted first, see ``_fit_by_bins``; the candidates are read four times then.
    """
    def trees(inputs: Sequence[str], **more):
        return Pipeline(stages=[VectorAssembler(inputCols=list(inputs), outputCol="_f"), GBTRegressor(featuresCol="_f", labelCol=label, predictionCol="_p", maxIter=10, maxDepth=3, seed=seed, **more)])

    if candidates.count() > EACH_TRAIN_ROWS:
        return _fit_by_bins(candidates.select(*features, label), list(features), label, trees)
    rows = cut_lineage(candidates.select(*features, label))
    return trees(features).fit(_dealt(rows))


def _dealt(rows: DataFrame) -> DataFrame:
    parts = -(-rows.count() // TRAIN_ROWS)
    return rows.repartition(parts) if parts > rows.rdd.getNumPartitions() else rows


def _fit_by_bins(rows: DataFrame, features: list[str], label: str, trees):
    """Trees over one row for each combination of bins, with the mean label and the number of rows as its weight.

    All rows of a combination get the same prediction, and squares around their mean are the same before and after any split, so every split gains what it gains over the rows. A bin is a
    value where a feature has at most ``BINS``, else it lies between quantiles of all rows (to a thousandth of the rows).
    """
    seen = rows.agg(F.count_if(F.col(label).isNull() | F.isnan(label)).alias("_bad"), *[F.approx_count_distinct(f).alias(f"_d{j}") for j, f in enumerate(features)]).first()
    if seen["_bad"]:
        raise ValueError(f"{label} must not be null or NaN")
    edges: dict[str, list[float]] = {}
    for j, f in enumerate(features):
        values = sorted(float(r[0]) for r in rows.where(F.col(f).isNotNull()).select(f).distinct().limit(BINS + 1).collect()) if seen[f"_d{j}"] <= 2 * BINS else []
        if 0 < len(values) <= BINS:
            edges[f] = [(x + y) / 2 for x, y in zip(values, values[1:])] or values
    many = [f for f in features if f not in edges]
    if many:
        edges |= {f: sorted(set(q)) for f, q in zip(many, rows.approxQuantile(many, [n / BINS for n in range(1, BINS)], 0.001))}
    bins = [f"_b{j}" for j in range(len(features))]
    binned = Bucketizer(splitsArray=[[-math.inf, *edges[f], math.inf] for f in features], inputCols=features, outputCols=bins)
    plain = [(F.col(b) + F.lit(0.0)).alias(b) for b in bins]  # without the note that they are categories; they have an order
    cells = cut_lineage(binned.transform(rows).groupBy(*plain).agg(F.avg(label).alias(label), F.count("*").cast("double").alias("_n")))
    return PipelineModel([binned, *trees(bins, weightCol="_n").fit(_dealt(cells)).stages])


def rerank(model, candidates: DataFrame, k: int) -> DataFrame:
    s = model.transform(candidates).select("query_id", "item_id", F.col("_p").alias("score"))
    return top_per_group(s, ["query_id"], ["-score", "item_id"], k, "rank")


def recommend(candidates: DataFrame, user: str, item: str, score: str, category: str, k: int, per_category: int) -> DataFrame:
    """Top k per user with at most ``per_category`` items of one category."""
    spread = top_per_group(candidates, [user, category], ["-" + score, item], per_category)
    return top_per_group(spread, [user], ["-" + score, item], k, "rank").select(user, item, category, score, "rank")


def popular_items(facts: DataFrame, item: str, k: int, by: Sequence[str] = ()) -> DataFrame:
    c = facts.groupBy(*by, item).agg(F.count("*").alias("n"))
    if by:
        return top_per_group(c, by, ["-n", item], k, "rank")
    return top_per_group(c.withColumn("_all", F.lit(1)), ["_all"], ["-n", item], k, "rank").drop("_all")


def with_fallback(users: DataFrame, user: str, segment: str, personal: DataFrame, by_segment: DataFrame, overall: DataFrame, item: str) -> DataFrame:
    """First choice per user: own list, else the segment's, else the overall list."""
    one = lambda df: df.where(F.col("rank") == 1)
    s = one(by_segment).select(segment, F.col(item).alias("_s"))
    p = one(personal).select(user, F.col(item).alias("_p"))
    j = users.join(p, user, "left").join(s, segment, "left")
    j = attach_row(j, one(overall).select(F.col(item).alias("_o")))
    origin = F.when(F.col("_p").isNotNull(), "personal").when(F.col("_s").isNotNull(), "segment").otherwise("overall")
    return j.select(user, F.coalesce("_p", "_s", "_o").alias(item), origin.alias("origin"))


def nearest_earlier(vectors: DataFrame, least: float) -> DataFrame:
    """Per query (``id`` grows with time) the nearest earlier one with a score of at least ``least``.

    The threshold bounds the search from the start: a strict one leaves few cells possible.
    """
    return nearest(vectors, vectors, 1, earlier_only=True, least=least)


def semantic_cache(vectors: DataFrame, threshold: float, cost: float, near: DataFrame | None = None) -> DataFrame:
    """Per query (``id`` grows with time) the nearest earlier one with a score of at least ``threshold``, a hit; misses have no item.

    ``near`` takes the result of ``nearest_earlier`` on the same vectors with at most this threshold, which serves several thresholds: the nearest one either reaches a threshold or none does.
    """
    near = nearest_earlier(vectors, threshold) if near is None else near.where(F.col("score") >= threshold)
    near = near.select(F.col("query_id").alias("id"), "item_id", "score")
    j = vectors.select("id").join(near, "id", "left")
    hit = F.col("item_id").isNotNull()
    return j.select("id", "item_id", "score", hit.alias("hit"), F.when(hit, F.lit(0.0)).otherwise(F.lit(cost)).alias("cost"))


def route_queries(df: DataFrame, text: str, prices: dict[str, float]) -> DataFrame:
    """Tier by length and question shape, price per tier."""
    words = F.size(F.filter(F.split(F.col(text), r"\s+"), lambda w: w != ""))
    tier = F.when(words > 60, "large").when((words > 20) | F.col(text).contains("\n"), "medium").otherwise("small")
    price = F.create_map(*[F.lit(x) for kv in prices.items() for x in kv])
    return df.withColumn("tier", tier).withColumn("cost", price[F.col("tier")])


# Engagement weights.
ENGAGEMENT = {"purchase": 1.0, "click": 0.5, "view": 0.0}


def implicit_labels(events: DataFrame, user: str, item: Column, kind: str) -> DataFrame:
    weight = F.create_map(*[F.lit(x) for kv in ENGAGEMENT.items() for x in kv])
    w = F.try_element_at(weight, F.col(kind))
    return events.where(w.isNotNull()).groupBy(user, item.alias("item")).agg(F.max(w).alias("label"))


def position_ctr(shown: DataFrame, rank: str, clicked: Column) -> DataFrame:
    """Click rate per rank and the inverse-propensity weight against rank 1."""
    r = shown.groupBy(rank).agg(F.count("*").alias("shown"), F.avg(clicked.cast("double")).alias("ctr"))
    top = r.agg(F.min_by("ctr", rank).alias("_top"))
    return attach_row(r, top).select(rank, "shown", "ctr", safe_divide(F.col("_top"), F.col("ctr")).alias("weight"))


def hashed_terms(docs: DataFrame, buckets: int = 128) -> DataFrame:
    """``id, vector``: how often terms of each hash bucket (CRC-32) stand in a text."""
    places = F.transform(terms(F.coalesce(F.col("text"), F.lit(""))), lambda w: F.crc32(w.cast("binary")) % buckets)

    @F.pandas_udf("array<double>")
    def counted(found: pd.Series) -> pd.Series:
        return pd.Series([np.bincount(np.asarray(x, np.int64), minlength=buckets).astype(float) for x in found])

    return docs.select("id", counted(places).alias("vector"))


def shared_attribute_components(edges: DataFrame, entity: str, attribute: str) -> DataFrame:
    """Entities linked through shared attributes get the smallest linked entity as ``component``.

    Labels flow entity to attribute to entity (two partial aggregations, no pair list), then every
    label is replaced by its own label, which halves long chains. It ends when no label changes.
    """
    e = cut_lineage(edges.select(entity, attribute).where(F.col(attribute).isNotNull()).distinct())
    labels = e.select(entity).distinct().withColumn("component", F.col(entity))
    while True:
        via = e.join(labels, entity).groupBy(attribute).agg(F.min("component").alias("_m"))
        low = e.join(via, attribute).groupBy(entity).agg(F.min("_m").alias("_m"))
        step = labels.join(low, entity).select(entity, F.least("component", "_m").alias("_c"), F.col("component").alias("_old"))
        jump = step.select(F.col(entity).alias("_c"), F.col("_c").alias("_cc"))
        nxt = cut_lineage(step.join(jump, "_c", "left").select(entity, F.least("_c", "_cc").alias("component"), "_old"))
        done = nxt.where(F.col("component") != F.col("_old")).isEmpty()
        labels = nxt.drop("_old")
        if done:
            return labels
