"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Every query reads the driver's tables (or tables Spark derives from them)
whole. Doubles are rounded to 6 places so results compare across engines.
The derived inputs:

* messages: ``events`` x ``documents`` (text of document
  ``event_id % count(documents)``), true event = ``event_type``;
* vectors: ``embeddings`` (64-dim unit vectors, label 0..9);
* per-block clustering: the first ``k`` messages of a block (by time, id)
  are the centres, ``k`` = distinct events of the block; run ``r`` of the
  multi-run table instead takes the ``k`` messages with the smallest
  ``md5(msg_id || '-' || r)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from horosphere.functions import hyperbolic as H
from horosphere.functions.vectors import as_double, explode_vector
from horosphere.operators import blocks as B
from horosphere.operators import clustering as C
from horosphere.operators import results as R
from horosphere.operators import scores as S
from horosphere.operators import text as TX
from horosphere.operators import vectorize as V
from horosphere.session import cut_lineage, written
from horosphere.sources.messages import messages_from_tables, standardize

HASH_DIM = 64
RUNS = 5
WINDOWS = (1, 2, 3, 4, 5, 1000)


def r6(c):
    return F.round(c, 6)


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def msgs(spark, sf, with_text=True):
    return messages_from_tables(spark, sf, with_text)


def blocks(spark, sf, with_text=False):
    return B.assign_blocks(msgs(spark, sf, with_text))


def emb(spark, sf):
    return read(spark, sf, "embeddings").select(
        "vec_id", "label", as_double("embedding").alias("v"))


def exploded(df, ids, vec):
    e = explode_vector(df, ids, vec)
    return e.withColumn("x", r6(F.col("x")))


# ---------------------------------------------------------------- S / P / B

def q_load_clean(spark, sf):
    """Text lengths are taken per document, so texts never travel through the join."""
    lens = read(spark, sf, "documents").where(F.col("text").isNotNull()).select(
        "doc_id", F.length("text").cast("bigint").alias("text_chars"))
    return msgs(spark, sf, False).join(lens, "doc_id").select(
        "msg_id", "created_at", "event", "doc_id", "text_chars")


def q_standardize(spark, sf):
    """S1-S4 on text columns made from ``events`` by rule: missing cells, bad and
    zoned times; every such row is dropped or converted."""
    i = F.col("event_id")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    raw = read(spark, sf, "events").select(
        i.alias("id"),
        F.when(i % 7 == 0, F.lit("NA")).when(i % 11 == 0, F.lit("")).otherwise(F.concat(F.lit("text "), i)).alias("body"),
        F.when(i % 13 == 0, F.lit("not a time")).when(i % 17 == 0, F.concat(iso, F.lit("Z")))
        .when(i % 19 == 0, F.concat(iso, F.lit("+02:00"))).when(i % 23 == 0, F.lit("NULL")).otherwise(iso).alias("at"),
        F.when(i % 29 == 0, F.lit("nan")).otherwise(F.col("event_type")).alias("kind"))
    return standardize(raw, "body", "at", "kind", "id", mode="drop").select("msg_id", "text", "created_at", "event")


def q_block_assign(spark, sf):
    return blocks(spark, sf).select("msg_id", "block_id", "block_name", "is_offline")


def q_block_stats(spark, sf):
    return B.block_stats(blocks(spark, sf))


def q_block_sketches(spark, sf):
    """B2/B3 from stored sketches: blocks, weeks and the whole table, against the exact numbers of distinct events."""
    b = blocks(spark, sf)
    stored = written(B.block_sketches(b), "block-sketches")
    week = F.date_trunc("week", F.col("start_ts")).cast("date")
    scopes = [("block", F.col("block_id").cast("string")), ("week", week.cast("string")), ("total", F.lit("all"))]
    got = S.union_all([B.merged_stats(stored.withColumn("part", c), "part").withColumn("scope", F.lit(n)) for n, c in scopes])
    own = b.join(stored.select("block_id", F.col("start_ts").alias("_s")), "block_id")
    exact = S.union_all([own.withColumn("start_ts", F.col("_s")).select(c.alias("part"), "event").groupBy("part")
                         .agg(F.countDistinct("event").alias("exact")).withColumn("scope", F.lit(n)) for n, c in scopes])
    near = F.abs(F.col("num_events") - F.col("exact")) <= 0.05 * F.col("exact")
    return got.join(exact, ["scope", "part"]).select("scope", "part", "start_ts", "end_ts", "num_messages",
                                                     F.col("exact").alias("num_events"), near.alias("within_5_percent"))


def q_table_stats(spark, sf):
    return B.table_stats(msgs(spark, sf, False))


def q_block_table_stats(spark, sf):
    return B.block_and_table_stats(blocks(spark, sf))


def q_block_fetch(spark, sf):
    return B.get_block(blocks(spark, sf), "M3").select("msg_id", "created_at", "event")


def q_label_encode(spark, sf):
    return B.encode_labels(blocks(spark, sf)).select("msg_id", "block_id", "label_id")


def q_label_encode_union(spark, sf):
    sp = B.split_70_20_10(blocks(spark, sf))
    fit = sp.where(F.col("split").isin("train", "val"))
    return B.encode_labels(fit, fit_on=fit).select("msg_id", "block_id", "split", "label_id")


def q_split_config(spark, sf):
    return B.split_config(blocks(spark, sf)).select("msg_id", "block_id", "split")


def q_split_70_20_10(spark, sf):
    return B.split_70_20_10(blocks(spark, sf)).select("msg_id", "block_id", "split")


def q_split_80_20(spark, sf):
    return B.split_80_20(blocks(spark, sf)).select("msg_id", "block_id", "split")


# ---------------------------------------------------------------- T

def q_prompt_build(spark, sf):
    """Prompts are built once per document and joined to its messages."""
    p = TX.build_prompt("text", TX.prompt_template("summarize"))
    per_doc = read(spark, sf, "documents").select(
        "doc_id", F.md5(p).alias("prompt_md5"), F.length(p).cast("bigint").alias("prompt_chars"))
    return msgs(spark, sf, False).join(per_doc, "doc_id").select(
        "msg_id", "prompt_md5", "prompt_chars")


def q_mock_summary(spark, sf):
    """Summaries are computed once per document and joined to its messages."""
    docs = read(spark, sf, "documents").select("doc_id", "text")
    per_doc = TX.summarize_mock_sql(docs).select("doc_id", "summary")
    return msgs(spark, sf, False).join(per_doc, "doc_id").select("msg_id", "summary")


def _doc_keys(spark, sf):
    """Cache key and length of every document's text, taken once per document."""
    return read(spark, sf, "documents").where(F.col("text").isNotNull()).select(
        "doc_id", "text", TX.text_key("text").alias("key"))


def _offline_cache(spark, sf):
    """Summary cache of the offline block's documents with an even doc_id:
    the others, and texts that only later blocks bring, are misses."""
    m0 = blocks(spark, sf).where("block_id = 0 and doc_id % 2 = 0").select("doc_id").distinct()
    return (TX.summarize_mock_sql(_doc_keys(spark, sf).join(m0, "doc_id", "left_semi"))
            .dropDuplicates(["key"])
            .select("key", F.lit(TX.DEFAULT_MODEL).alias("model"), F.lit("summarize").alias("prompt_type"), "summary"))


def q_cache_misses(spark, sf):
    later = blocks(spark, sf).where(F.col("block_id") > 0).select("doc_id").distinct()
    texts = _doc_keys(spark, sf).join(later, "doc_id", "left_semi")
    miss = TX.cache_misses(texts, _offline_cache(spark, sf), model=TX.DEFAULT_MODEL, prompt_type="summarize")
    return miss.select("key", F.length("text").cast("bigint").alias("text_chars"))


def q_cache_apply(spark, sf):
    """Per document: hits come from the cache, misses from the (mock) model; then joined to the messages."""
    docs = _doc_keys(spark, sf)
    out = TX.apply_cache(docs, _offline_cache(spark, sf), model=TX.DEFAULT_MODEL, prompt_type="summarize")
    fresh = TX.mock_summary(TX.build_prompt("text", TX.prompt_template("summarize")))
    per_doc = out.select("doc_id", "from_cache", F.when(F.col("from_cache"), F.col("summary")).otherwise(fresh).alias("summary"))
    return msgs(spark, sf, False).join(per_doc, "doc_id").select("msg_id", "from_cache", "summary")


def q_summary_stats(spark, sf):
    """T4/T5: a model that fails on some texts; rows and successes."""
    def model(prompts):
        if any(len(p) % 10 == 0 for p in prompts):
            raise ValueError("refused")
        return [p[:20] for p in prompts]
    out = TX.summarize(read(spark, sf, "documents").where(F.col("text").isNotNull()).select("doc_id", "text"), model)
    return TX.summary_stats(out).select("rows", "succeeded")


def q_model_names(spark, sf):
    """Served model name of a short name, given table first."""
    short = F.element_at(F.array(*map(F.lit, ("llama3.1", "qwen2.5", "gemma2", "mine", "unknown"))),
                         (F.col("event_id") % 5 + 1).cast("int"))
    e = read(spark, sf, "events").select("event_id", short.alias("short"))
    return e.select("event_id", TX.resolve_model_col("short", {"mine": "own:1b"}).alias("model"))


# ---------------------------------------------------------------- V

def q_time_features(spark, sf):
    m = msgs(spark, sf, False)
    return m.select("msg_id", r6(V.time_days("created_at").cast("double")).alias("t_days"),
                    r6(V.time_seconds("created_at").cast("double")).alias("t_secs"))


def doc_vectors(spark, sf, only=None):
    """Hashed text vectors of the documents (optionally only those in ``only``)."""
    d = read(spark, sf, "documents").select("doc_id", "text")
    if only is not None:
        d = d.join(only, "doc_id", "left_semi")
    return V.hashed_text_vectors(d, "doc_id", "text", HASH_DIM, "text_vec")


def q_hashed_embed(spark, sf):
    return exploded(doc_vectors(spark, sf), ["doc_id"], "text_vec")


def word_vectors(spark, sf):
    """Word vectors: tokens of ``benchmark`` texts, each mapped to the
    embedding whose ``vec_id`` is the token's MD5 bucket mod count(embeddings)."""
    e = read(spark, sf, "embeddings")
    n = e.select(F.count(F.lit(1)).alias("_n"))
    toks = (read(spark, sf, "benchmark").select(F.explode(V.tokens("text")).alias("token"))
            .distinct().crossJoin(F.broadcast(n)))
    toks = toks.withColumn("vec_id", F.pmod(
        F.conv(F.substring(F.md5("token"), 1, 8), 16, 10).cast("bigint"), F.col("_n")))
    return toks.join(e.select("vec_id", as_double("embedding").alias("vector")), "vec_id") \
               .select("token", "vector")


def q_word_vector_mean(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "text")
    wv = V.word_vector_mean(d, "doc_id", word_vectors(spark, sf), 64, "text")
    return exploded(wv, ["doc_id"], "text_vec")


def message_vectors(spark, sf, include_time=True, text=True):
    m = msgs(spark, sf, False)
    dv = doc_vectors(spark, sf)
    x = m.join(dv, "doc_id")
    if not text:
        x = x.withColumn("text_vec", F.array().cast("array<double>"))
    return x.withColumn("vec", V.concat_time("text_vec", "created_at", include_time)) \
            .drop("text_vec")


def q_concat_vectors(spark, sf):
    x = message_vectors(spark, sf)
    return x.select("msg_id", F.size("vec").cast("bigint").alias("dim"),
                    r6(F.aggregate(F.slice("vec", 1, HASH_DIM), F.lit(0.0),
                                   lambda a, t: a + t)).alias("text_sum"),
                    r6(F.element_at("vec", HASH_DIM + 1)).alias("t_days"),
                    r6(F.element_at("vec", HASH_DIM + 2)).alias("t_secs"))


# ---------------------------------------------------------------- H / J

def pairs(spark, sf):
    """Neighbour pairs (vec_id, vec_id + 1): an equi-join, not all pairs."""
    e = emb(spark, sf)
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return e.join(nxt, "vec_id")


def q_poincare_exp0(spark, sf):
    return exploded(emb(spark, sf).select("vec_id", H.poincare_exp0("v").alias("p")),
                    ["vec_id"], "p")


def q_poincare_log0(spark, sf):
    e = emb(spark, sf).select("vec_id", H.poincare_exp0("v").alias("p"))
    return exploded(e.select("vec_id", H.poincare_log0("p").alias("q")), ["vec_id"], "q")


def q_mobius_add(spark, sf):
    p = pairs(spark, sf).select("vec_id", H.poincare_exp0("v").alias("x"),
                                H.poincare_exp0("w").alias("y"))
    return exploded(p.select("vec_id", H.mobius_add("x", "y").alias("z")), ["vec_id"], "z")


def q_poincare_distance(spark, sf):
    p = pairs(spark, sf).select("vec_id", H.poincare_exp0("v").alias("x"),
                                H.poincare_exp0("w").alias("y"))
    return p.select("vec_id", r6(H.poincare_distance("x", "y")).alias("d"))


def q_poincare_distance_acosh(spark, sf):
    p = pairs(spark, sf).select("vec_id", H.poincare_exp0("v").alias("x"),
                                H.poincare_exp0("w").alias("y"))
    return p.select("vec_id", r6(H.poincare_distance_acosh("x", "y")).alias("d"))


def q_poincare_project(spark, sf):
    return exploded(emb(spark, sf).select("vec_id", H.poincare_project("v").alias("p")),
                    ["vec_id"], "p")


def hyperboloid_pairs(spark, sf):
    return pairs(spark, sf).select("vec_id", H.hyperboloid_exp0("v").alias("x"),
                                   H.hyperboloid_exp0("w").alias("y"))


def q_minkowski_dot(spark, sf):
    p = hyperboloid_pairs(spark, sf)
    return p.select("vec_id", r6(H.minkowski_dot("x", "y")).alias("mdot"))


def q_minkowski_norm(spark, sf):
    e = emb(spark, sf).select("vec_id", "v")
    return e.select("vec_id", r6(H.minkowski_norm("v")).alias("mnorm"))


def q_hyperboloid_exp0(spark, sf):
    return exploded(emb(spark, sf).select("vec_id", H.hyperboloid_exp0("v").alias("h")),
                    ["vec_id"], "h")


def q_hyperboloid_log0(spark, sf):
    e = emb(spark, sf).select("vec_id", H.hyperboloid_exp0("v").alias("h"))
    return exploded(e.select("vec_id", H.hyperboloid_log0("h").alias("q")), ["vec_id"], "q")


def q_hyperboloid_distance(spark, sf):
    p = hyperboloid_pairs(spark, sf)
    return p.select("vec_id", r6(H.hyperboloid_distance("x", "y")).alias("d"))


def q_hyperboloid_project(spark, sf):
    return exploded(emb(spark, sf).select("vec_id", H.hyperboloid_project("v").alias("h")),
                    ["vec_id"], "h")


def label_centroids(spark, sf, manifold=None):
    e = emb(spark, sf)
    if manifold == "poincare":
        e = e.withColumn("v", H.poincare_exp0("v"))
    return C.centroids(e.withColumnRenamed("label", "cluster"), "v", ["cluster"],
                       manifold=manifold)


def q_hyperbolic_mean(spark, sf):
    return exploded(label_centroids(spark, sf, "poincare").select("cluster", "center"),
                    ["cluster"], "center")


def nearest(spark, sf):
    e = emb(spark, sf)
    return C.assign_nearest(e, label_centroids(spark, sf), "v", out="pred")


def q_nearest_center(spark, sf):
    return nearest(spark, sf).select("vec_id", "pred")


def q_hyperbolic_assign(spark, sf):
    e = emb(spark, sf).withColumn("p", H.poincare_exp0("v"))
    return C.assign_nearest(e, label_centroids(spark, sf, "poincare"), "p",
                            metric="poincare", out="pred").select("vec_id", "pred")


def q_inertia(spark, sf):
    return C.inertia(emb(spark, sf), label_centroids(spark, sf), "v") \
            .select(r6(F.col("inertia")).alias("inertia"))


def q_cluster_sizes(spark, sf):
    s = C.cluster_sizes(nearest(spark, sf), "pred")
    return s.select("min_size", "max_size", r6(F.col("mean_size")).alias("mean_size"))


def inertia_by_k(spark, sf):
    """Inertia with the first k label means as centres, k = 2..9, one pass."""
    cen = label_centroids(spark, sf).select("cluster", "center")
    return C.prefix_inertia(emb(spark, sf), cen, "v").where(F.col("k") >= 2)


def q_inertia_by_k(spark, sf):
    return inertia_by_k(spark, sf).select("k", r6(F.col("inertia")).alias("inertia"))


def q_elbow_k(spark, sf):
    return C.elbow_k(inertia_by_k(spark, sf)).select(F.col("best_k").cast("bigint"))


def q_silhouette_squared(spark, sf):
    s = C.silhouette_squared(nearest(spark, sf), "v", "pred", id_col="vec_id")
    return s.select(r6(F.col("silhouette_squared")).alias("silhouette_squared"))


def _steps(points, vec, id_col, group, start, n, **kw):
    """Centres after ``n`` steps of the k-means operator from given ones."""
    return C.keyed_kmeans(points, vec, id_col, group, start=start, max_iter=n, tol=-1.0, **kw)


def q_hyperbolic_lloyd_2steps(spark, sf):
    """Hyperbolic k-means from the 10 rows with the smallest MD5 of their id, two steps."""
    e = emb(spark, sf).withColumn("p", H.poincare_exp0("v")).select("vec_id", "p")
    # top 10 by hash: per-partition top-k then a 10-row merge (no global sort)
    top = e.withColumn("_h", F.md5(F.col("vec_id").cast("string"))).orderBy("_h").limit(10)
    start = (top.withColumn("cluster", (F.row_number().over(Window.orderBy("_h")) - 1)
                            .cast("bigint")).select("cluster", F.col("p").alias("center")))
    res = _steps(e, "p", "vec_id", [], start, 2, metric="poincare", stop_rule="absolute")
    return exploded(res.centers, ["cluster"], "center")


def block_lloyd(spark, sf, steps=2):
    """K-means per block from its first k messages (k = distinct events)."""
    keys = block_keys(spark, sf)
    dv = doc_vectors_table(spark, sf)
    pts = with_vectors(keys, spark, sf, dv=dv).select("block_id", "msg_id", "event", "vec")
    start = first_k_centers(spark, sf, keys, dv=dv)
    return pts, _steps(pts, "vec", "msg_id", ["block_id"], start, steps)


def q_block_kmeans_centers(spark, sf):
    return exploded(block_lloyd(spark, sf)[1].centers, ["block_id", "cluster"], "center")


def q_block_kmeans_inertia(spark, sf):
    """Inertia of the last assignment, as the operator reports it."""
    return block_lloyd(spark, sf)[1].inertia.select("block_id", F.round("inertia", 4).alias("inertia"), "n_iter")


def q_block_kmeans_predict(spark, sf):
    """C4: rows per cluster under the fitted centres."""
    pts, res = block_lloyd(spark, sf)
    return res.predict(pts.select("block_id", "vec"), "vec", keep_vec=False).groupBy("block_id", "pred").agg(F.count(F.lit(1)).alias("rows"))


def q_kmeans_seeded(spark, sf):
    """The eight rows that k-means|| starts from, with the rows each one stands for."""
    s = C.start_centers(emb(spark, sf), 8, "v", "vec_id", trials=1)
    return s.select("cluster", "vec_id", F.col("weight").cast("bigint").alias("weight"))


def q_silhouette_by_k(spark, sf):
    """Silhouettes for the first k label means as centres, k = 2..9, all in two passes."""
    cen = label_centroids(spark, sf).select("cluster", "center")
    many = cen.withColumn("k", F.explode(F.sequence(F.lit(2).cast("bigint"), F.lit(9).cast("bigint")))).where(F.col("cluster") < F.col("k"))
    return C.silhouette_by_k(emb(spark, sf), many, "v").select("k", "clusters", r6(F.col("silhouette")).alias("silhouette"))


# ---------------------------------------------------------------- M

def emb_pairs(spark, sf):
    return nearest(spark, sf).select(F.col("label").cast("bigint").alias("y_true"),
                                     F.col("pred").alias("y_pred"))


def q_contingency(spark, sf):
    return S.contingency(emb_pairs(spark, sf))


def _one(metric, average="arithmetic"):
    def q(spark, sf):
        t = S.score_table(emb_pairs(spark, sf), average_method=average,
                          with_ami=(metric == "ami"))
        name = metric if average == "arithmetic" else f"nmi_{average}"
        return t.select(r6(F.col(metric)).alias(name))
    return q


def q_scores_all(spark, sf):
    t = S.score_table(emb_pairs(spark, sf))
    return t.select(*[r6(F.col(m)).alias(m) for m in S.ALL_SCORES])


def q_scores_quality_toxic(spark, sf):
    lab = read(spark, sf, "labels")
    t = S.score_table(lab, "quality", "toxic")
    return t.select(*[r6(F.col(m)).alias(m) for m in S.ALL_SCORES])


def block_k(b):
    return b.groupBy("block_id").agg(F.countDistinct("event").alias("k"))


def block_keys(spark, sf):
    """Narrow message keys with block ids (no text, no vectors), written once: blocks, centres and
    points all read them."""
    return written(blocks(spark, sf).select("msg_id", "doc_id", "block_id", "block_name", "created_at", "event"), "block-keys")


def doc_vectors_table(spark, sf):
    """Document vectors computed once and written to the shared checkpoint
    folder, so every consumer in a query reads them instead of re-hashing."""
    return cut_lineage(doc_vectors(spark, sf))


def with_vectors(keys, spark, sf, include_time=True, text=True, docs=None, dv=None):
    """Attach ``vec`` (hashed document vector ++ time) to message keys."""
    dv = dv if dv is not None else doc_vectors(spark, sf, docs)
    x = keys.join(dv, "doc_id")
    if not text:
        x = x.withColumn("text_vec", F.array().cast("array<double>"))
    return x.withColumn("vec", V.concat_time("text_vec", "created_at", include_time)) \
            .drop("text_vec")


def block_points(spark, sf, include_time=True, text=True):
    return with_vectors(block_keys(spark, sf), spark, sf, include_time, text)


def top_k_per_group(keys, group, order, k_table):
    """Rows ranked ``< k`` per group. A first rank within (group, salt) keeps at
    most kmax rows of each part, so no task sorts a whole group; then each
    group's own k applies to what is left. The rank filters are literal bounds
    on the bare rank, for which Spark also drops rows before the shuffle."""
    kmax = int(k_table.agg(F.max("k")).first()[0] or 0)
    salt = F.pmod(F.xxhash64(*order), F.lit(64))
    part = Window.partitionBy(*group, "_salt").orderBy(*order)
    few = (keys.withColumn("_salt", salt).withColumn("_r", F.row_number().over(part))
           .where(F.col("_r") <= kmax).drop("_salt", "_r"))
    w = Window.partitionBy(*group).orderBy(*order)
    ranked = few.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= kmax) \
        .withColumn("cluster", (F.col("_r") - 1).cast("bigint")).drop("_r")
    kcols = [c for c in k_table.columns if c != "k"]
    return ranked.join(k_table, kcols).where(F.col("cluster") < F.col("k")).drop("k")


def first_k_centers(spark, sf, keys, include_time=True, text=True, dv=None):
    """Centres per block: its first k messages (k = distinct events)."""
    top = top_k_per_group(keys, ["block_id"], ["created_at", "msg_id"], block_k(keys))
    docs = top.select("doc_id").distinct()
    cen = with_vectors(top, spark, sf, include_time, text, docs, dv)
    return cut_lineage(cen.select("block_id", "cluster", F.col("vec").alias("center")))     # counted, then fetched


def block_predictions(spark, sf, include_time=True, text=True, dv=None):
    keys = block_keys(spark, sf)
    dv = dv if dv is not None else doc_vectors_table(spark, sf)
    pts = with_vectors(keys, spark, sf, include_time, text, dv=dv).select("block_id", "event", "vec")
    cen = first_k_centers(spark, sf, keys, include_time, text, dv)
    return C.assign_nearest(pts, cen, "vec", ["block_id"], out="pred", keep_vec=False)


def q_scores_per_block(spark, sf):
    p = block_predictions(spark, sf)
    t = S.score_table(p, "event", "pred", ["block_id"])
    return t.select("block_id", *[r6(F.col(m)).alias(m) for m in S.ALL_SCORES])


# ---------------------------------------------------------------- R / K

def run_centers(spark, sf, keys, dv):
    """Run r: the k messages of each block with the smallest md5(msg_id-r)."""
    runs = F.sequence(F.lit(0).cast("bigint"), F.lit(RUNS - 1).cast("bigint"))
    x = keys.withColumn("run", F.explode(runs)).withColumn(
        "_h", F.md5(F.concat(F.col("msg_id").cast("string"), F.lit("-"),
                             F.col("run").cast("string"))))
    top = top_k_per_group(x, ["run", "block_id"], ["_h"], block_k(keys))
    cen = with_vectors(top, spark, sf, dv=dv)
    return cen.select("run", "block_id", "cluster", F.col("vec").alias("center"))


def run_scores(spark, sf, block=None):
    """Long metric table ``(run, block_id, block_name, metric, value)``; of one block if named.

    All runs are assigned from one copy of each vector."""
    keys = block_keys(spark, sf)
    if block is not None:
        keys = keys.where(F.col("block_id") == block)
    dv = doc_vectors_table(spark, sf)
    pts = with_vectors(keys, spark, sf, dv=dv).select("block_id", "event", "vec")
    p = C.assign_views(pts, run_centers(spark, sf, keys, dv), "vec", ["block_id"], {"all": (0, None)}, over="run")
    t = S.score_table(p, "event", "pred", ["run", "block_id"])
    t = t.withColumn("block_name", F.concat(F.lit("M"), F.col("block_id").cast("string")))
    return S.to_long(t, ["run", "block_id", "block_name"], ("nmi", "ami"))


def q_runs_mean_std(spark, sf):
    rs = run_scores(spark, sf, 0)
    return R.mean_std(rs, ["metric"]).select("metric", r6(F.col("mean")).alias("mean"),
                                             r6(F.col("std")).alias("std"))


def q_blocks_mean_std(spark, sf):
    rs = run_scores(spark, sf)
    return R.mean_std(rs, ["block_name", "metric"]).select(
        "block_name", "metric", r6(F.col("mean")).alias("mean"), r6(F.col("std")).alias("std"))


def q_block_table(spark, sf):
    rs = run_scores(spark, sf)
    t = R.block_table(rs, ("nmi", "ami"))
    return t.select("block_name", "block_order",
                    *[r6(F.col(c)).alias(c) for c in t.columns
                      if c not in ("block_name", "block_order")])


def q_run_block_average(spark, sf):
    rs = run_scores(spark, sf)
    t = R.mean_std(rs, ["run", "metric"])
    return t.select("run", "metric", r6(F.col("mean")).alias("mean"),
                    r6(F.col("std")).alias("std"))


def q_runs_of_blocks(spark, sf):
    rs = run_scores(spark, sf)
    t = R.two_level_mean(rs, "run", ["metric"])
    return t.select("metric", r6(F.col("mean")).alias("mean"), r6(F.col("std")).alias("std"))


def q_format_paper_style(spark, sf):
    rs = run_scores(spark, sf, 0)
    t = R.mean_std(rs, ["metric"])
    return t.select("metric", R.format_paper_style("mean", "std").alias("formatted"))


def q_best_epoch(spark, sf):
    rs = run_scores(spark, sf, 0)
    log = rs.select(F.col("run").alias("epoch"), F.lit("val").alias("phase"), "metric", "value")
    b = R.best_epoch(log, "nmi", "val")
    return b.select("epoch", r6(F.col("value")).alias("value"))


def q_compare_configs(spark, sf):
    """Text with time, text alone, time alone: slices of one vector, assigned in one pass."""
    keys = block_keys(spark, sf)
    dv = doc_vectors_table(spark, sf)
    pts = with_vectors(keys, spark, sf, dv=dv).select("block_id", "event", "vec")
    views = {"text+time": (0, HASH_DIM + 2), "text": (0, HASH_DIM), "time": (HASH_DIM, HASH_DIM + 2)}
    p = C.assign_views(pts, first_k_centers(spark, sf, keys, dv=dv), "vec", ["block_id"], views)
    t = S.score_table(p.withColumnRenamed("view", "config"), "event", "pred", ["config", "block_id"])
    t = R.compare(S.to_long(t, ["config", "block_id"], ("nmi", "ami")), "config", ("nmi", "ami"))
    return t.select("config", *[r6(F.col(c)).alias(c) for c in ("nmi", "ami")])


def q_summary_defaults(spark, sf):
    """Mean and std of chosen metrics, 0/0 for one that no row has."""
    rows = read(spark, sf, "events").select(
        F.concat(F.lit("m"), (F.col("event_id") % 2).cast("string")).alias("metric"), "value")
    t = R.summary(rows, ("m0", "m1", "absent"))
    return t.select("metric", r6(F.col("mean")).alias("mean"), r6(F.col("std")).alias("std"))


# ---------------------------------------------------------------- E

def fixed_encoder(manifold="poincare", c=1.0, single=False):
    """Weights by formula: W_l[i, j] = 0.3 sin(7i + 3j + l), b_l[j] = 0.1 cos(j + l)."""
    import numpy as np
    from horosphere.operators.encoder import Encoder, EncoderConfig
    cfg = EncoderConfig(64, 6, 4, 2, 0.1, "relu", manifold, c, single)
    ws = [(0.3 * np.sin(7 * np.arange(a)[:, None] + 3 * np.arange(b)[None] + n), 0.1 * np.cos(np.arange(b) + n))
          for n, (a, b) in enumerate(cfg.dims())]
    return Encoder(cfg, ws)


def _encoded(euclidean=False, **kw):
    def q(spark, sf):
        from horosphere.operators.encoder import encode
        e = encode(emb(spark, sf).select("vec_id", "v"), fixed_encoder(**kw), "v", "h", euclidean)
        return exploded(e, ["vec_id"], "h")
    return q


# ---------------------------------------------------------------- H, other curvatures and norms

C_GRID, SCALES = (0.5, 1.0, 2.0), (0.0, 0.01, 1.0, 50.0)


def q_hyperbolic_grid(spark, sf):
    """H1-H13 for several curvatures on vectors scaled to norms 0, .01, 1 and 50: the pairs are joined once (as they
    are stored) and every pair meets the settings in its own task."""
    e = read(spark, sf, "embeddings").select("vec_id", "embedding")
    pairs = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next")), "vec_id")
    pairs = pairs.select("vec_id", as_double("embedding").alias("v"), as_double("next").alias("w"))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    grid = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(s).alias("scale")) for c in C_GRID for s in SCALES])
    c = F.col("c")
    x = pairs.select("vec_id", "v", "w", F.inline(grid))
    x = x.select("vec_id", "c", "scale", F.transform("v", lambda t: t * F.col("scale")).alias("v"),
                 F.transform("w", lambda t: t * 0.5).alias("w"))
    x = x.select("vec_id", "c", "scale", "v", H.poincare_exp0("v", c).alias("e"), H.poincare_exp0("w", c).alias("q"))
    x = x.select("vec_id", "c", "scale", "v", "q", H.poincare_project("e", c).alias("p"))
    x = x.select("vec_id", "c", "scale", "p", "q", H.mobius_add("p", "q", c).alias("m"), H.poincare_log0("p", c).alias("l"),
                 H.hyperboloid_exp0(F.transform("v", lambda t: t * 0.1), c).alias("h"), H.hyperboloid_exp0("q", c).alias("g"))
    return x.select(
        "vec_id", "c", "scale", r6(total("p")).alias("p_sum"), r6(total("l")).alias("l_sum"),
        r6(total("m")).alias("m_sum"), F.round(H.poincare_distance("p", "q", c), 4).alias("d"),
        F.round(H.poincare_distance_acosh("p", "q", c), 4).alias("d_acosh"),
        r6(total("h") / F.col("h")[0]).alias("h_rel"), r6(total(H.hyperboloid_log0("h", c))).alias("hl_sum"),
        F.round(H.hyperboloid_distance("h", "g", c), 4).alias("hd"),
        r6(H.hyperboloid_project("h", c)[0] / F.col("h")[0]).alias("hp_rel"))


def q_update_rule(spark, sf):
    from horosphere.streaming.blocks import update_flags
    st = B.block_stats(blocks(spark, sf)).select("block_id")
    return update_flags(st, WINDOWS).select("block_id", "window", "update")


def q_stream_daily_blocks(spark, sf):
    from horosphere.streaming.blocks import stream_daily_counts
    return stream_daily_counts(spark, sf, "events.parquet")


def q_stream_daily_stats(spark, sf):
    from horosphere.streaming.blocks import stream_daily_stats
    return stream_daily_stats(spark, sf, "events.parquet")


def q_stream_assign(spark, sf):
    from horosphere.streaming.blocks import stream_assign
    cen = label_centroids(spark, sf)
    return stream_assign(spark, sf, cen, files="embeddings.parquet").select("vec_id", "pred")


def q_stream_kmeans(spark, sf):
    """The embeddings as a stream, label means of weight 20 as first centres, half forgotten at each batch."""
    from horosphere.session import scratch_path
    from horosphere.streaming.blocks import file_source
    from horosphere.streaming.clusters import stream_centers, stream_kmeans
    start = label_centroids(spark, sf).select("cluster", "center", F.lit(20.0).alias("weight"))
    schema = read(spark, sf, "embeddings").schema
    src = file_source(spark, sf, schema, "embeddings.parquet").select("vec_id", as_double("embedding").alias("v"))
    work = scratch_path(spark, "stream-kmeans")
    stream_kmeans(src, work, start, vec="v", id_col="vec_id", decay=0.5).awaitTermination()
    got = stream_centers(spark, work)
    return exploded(got, ["cluster", "weight"], "center")


def queries() -> dict:
    q = {
        "load_clean": q_load_clean, "block_assign": q_block_assign,
        "block_stats": q_block_stats, "block_sketches": q_block_sketches, "table_stats": q_table_stats,
        "block_table_stats": q_block_table_stats, "block_fetch": q_block_fetch,
        "label_encode": q_label_encode, "label_encode_union": q_label_encode_union,
        "split_config": q_split_config, "split_70_20_10": q_split_70_20_10,
        "split_80_20": q_split_80_20,
        "prompt_build": q_prompt_build, "mock_summary": q_mock_summary,
        "cache_misses": q_cache_misses, "cache_apply": q_cache_apply,
        "time_features": q_time_features, "hashed_embed": q_hashed_embed,
        "word_vector_mean": q_word_vector_mean, "concat_vectors": q_concat_vectors,
        "poincare_exp0": q_poincare_exp0, "poincare_log0": q_poincare_log0,
        "mobius_add": q_mobius_add, "poincare_distance": q_poincare_distance,
        "poincare_distance_acosh": q_poincare_distance_acosh,
        "poincare_project": q_poincare_project, "minkowski_dot": q_minkowski_dot,
        "minkowski_norm": q_minkowski_norm, "hyperboloid_exp0": q_hyperboloid_exp0,
        "hyperboloid_log0": q_hyperboloid_log0, "hyperboloid_distance": q_hyperboloid_distance,
        "hyperboloid_project": q_hyperboloid_project, "hyperbolic_mean": q_hyperbolic_mean,
        "nearest_center": q_nearest_center, "hyperbolic_assign": q_hyperbolic_assign,
        "hyperbolic_lloyd_2steps": q_hyperbolic_lloyd_2steps,
        "block_kmeans_centers": q_block_kmeans_centers, "block_kmeans_inertia": q_block_kmeans_inertia,
        "block_kmeans_predict": q_block_kmeans_predict, "kmeans_seeded": q_kmeans_seeded,
        "silhouette_by_k": q_silhouette_by_k, "inertia": q_inertia,
        "inertia_by_k": q_inertia_by_k, "elbow_k": q_elbow_k,
        "silhouette_squared": q_silhouette_squared, "cluster_sizes": q_cluster_sizes,
        "contingency": q_contingency,
        "nmi": _one("nmi"), "nmi_geometric": _one("nmi", "geometric"),
        "nmi_min": _one("nmi", "min"), "nmi_max": _one("nmi", "max"),
        "ami": _one("ami"), "ari": _one("ari"), "fmi": _one("fmi"),
        "homogeneity": _one("homogeneity"), "completeness": _one("completeness"),
        "v_measure": _one("v_measure"), "scores_all": q_scores_all,
        "scores_quality_toxic": q_scores_quality_toxic, "scores_per_block": q_scores_per_block,
        "runs_mean_std": q_runs_mean_std, "blocks_mean_std": q_blocks_mean_std,
        "block_table": q_block_table, "run_block_average": q_run_block_average,
        "runs_of_blocks": q_runs_of_blocks, "format_paper_style": q_format_paper_style,
        "best_epoch": q_best_epoch, "compare_configs": q_compare_configs,
        "standardize": q_standardize, "summary_stats": q_summary_stats, "model_names": q_model_names,
        "summary_defaults": q_summary_defaults, "hyperbolic_grid": q_hyperbolic_grid,
        "linear_fixed": _encoded(single=True), "encode_fixed_poincare": _encoded(c=2.0),
        "encode_fixed_hyperboloid": _encoded(manifold="hyperboloid", c=0.5),
        "encode_euclidean_fixed": _encoded(euclidean=True),
        "update_rule": q_update_rule, "stream_daily_blocks": q_stream_daily_blocks,
        "stream_daily_stats": q_stream_daily_stats, "stream_assign": q_stream_assign, "stream_kmeans": q_stream_kmeans,
    }
    return q
