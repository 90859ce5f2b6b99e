"""User-level jobs (X1-X9, K2/K3): detect, evaluate, offline / online runs, sweeps.

Text and vector stages run once and are cached; every run, block and
configuration reuses them. Driver loops only order the work (runs, blocks,
epochs); every heavy step is a Spark job over the cached vector table.
Blocks that share encoder weights are clustered together in one keyed
k-means, so an online run with window w needs one clustering job per
weight version, not one per block.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from horosphere.operators import blocks as B
from horosphere.operators import clustering as C
from horosphere.operators import encoder as EN
from horosphere.operators import scores as S
from horosphere.operators import text as TX
from horosphere.operators import vectorize as V
from horosphere.session import written


@dataclass
class RunConfig:
    """Every switch of a run (the original YAML keys as fields)."""
    name: str = "default"
    use_summary: bool = True
    prompt_type: str = "summarize"
    summarize_fn: object = None          # pd.Series -> pd.Series; None = built-in mock
    model: str = TX.DEFAULT_MODEL
    model_options: dict | None = None    # e.g. temperature, max_tokens: passed to summarize_fn
    cache_path: str | None = None        # persistent summary cache on shared storage
    embedding: str = "hashed"            # hashed | word_mean | table | callable
    text_dim: int = 64
    include_time: bool = True
    use_hyperbolic: bool = True
    manifold: str = "poincare"
    c: float = 1.0
    hidden_dim: int = 64
    num_layers: int = 3
    dropout: float = 0.1
    activation: str = "relu"
    epochs: int = 100
    lr: float = 0.01
    weight_decay: float = 1e-4
    patience: int = 10
    batch_size: int | None = 256
    n_init: int = 10
    max_iter: int = 300
    val_n_init: int = 1
    val_max_iter: int = 20
    seed: int = 42
    window: int = 1
    extra: dict = field(default_factory=dict)

    def vector_key(self) -> tuple:
        """Fields the vector stage reads: configs sharing it share vectors."""
        return (self.use_summary, self.prompt_type, id(self.summarize_fn), self.embedding,
                self.text_dim, self.include_time, self.model, self.cache_path)


# ------------------------------------------------------------------ stages

def summarize_stage(texts: DataFrame, cfg: RunConfig) -> DataFrame:
    """Replace ``text`` by its summary; one row per distinct text goes in.

    The built-in mock is an expression. A user's model gets each text once:
    through the persistent cache if ``cache_path`` is set, else into a
    table of the shared folder; either way the answers are read back.
    """
    if not cfg.use_summary:
        return texts
    if cfg.summarize_fn is None:
        s = TX.summarize_mock_sql(texts, "text", cfg.prompt_type, "summary")
    elif cfg.cache_path:
        s = TX.summarize_cached(texts, cfg.summarize_fn, cfg.cache_path, "text", cfg.prompt_type, cfg.model,
                                cfg.model_options).drop("from_cache")
    else:
        s = written(TX.summarize(texts, cfg.summarize_fn, "text", cfg.prompt_type, cfg.model,
                                 options=cfg.model_options).drop("model", "success", "error", "seconds"), "summaries")
    return s.drop("text").withColumnRenamed("summary", "text")


def vector_stage(msgs: DataFrame, cfg: RunConfig, vectors: DataFrame | None = None,
                 text_key: str | None = None) -> DataFrame:
    """V1-V5: ``vec`` = text vector ++ time vector, per distinct original text."""
    return V.vectorize_messages(msgs, cfg.embedding, cfg.text_dim, text_key, cfg.include_time,
                                vectors=vectors, fn=cfg.extra.get("embed_fn"), out="vec",
                                rewrite=lambda t: summarize_stage(t, cfg))


def encoder_config(cfg: RunConfig, input_dim: int) -> EN.EncoderConfig:
    return EN.EncoderConfig(input_dim, cfg.hidden_dim, None, cfg.num_layers, cfg.dropout,
                            cfg.activation, cfg.manifold, cfg.c)


def embed(df: DataFrame, enc: EN.Encoder | None, out: str = "h") -> DataFrame:
    """E5, or the raw vectors when the hyperbolic stage is off."""
    if enc is None:
        return df.withColumn(out, F.col("vec"))
    return EN.encode(df, enc, "vec", out)


def cluster_groups(df: DataFrame, group: list[str], cfg: RunConfig, vec: str = "h",
                   true_col: str = "event", k_table: DataFrame | None = None,
                   n_init: int | None = None, max_iter: int | None = None) -> DataFrame:
    """K-means in every group at once, k = distinct true labels of the group."""
    kt = k_table if k_table is not None else \
        df.groupBy(*group).agg(F.countDistinct(true_col).alias("k"))
    res = C.keyed_kmeans(df, vec, "msg_id", group, k_table=kt,
                         n_init=n_init or cfg.n_init, max_iter=max_iter or cfg.max_iter, seed=cfg.seed)
    return res.predict(df, vec, "pred")


# ------------------------------------------------------------------ X1 / X2

def detect_events(msgs: DataFrame, k: int | None = None, k_table: DataFrame | None = None,
                  group: list[str] | tuple = (), enc: EN.Encoder | None = None,
                  cfg: RunConfig | None = None) -> DataFrame:
    """summarise? -> vectorise -> encode -> k-means; adds ``pred``."""
    cfg = cfg or RunConfig()
    if k is None and k_table is None:
        raise ValueError("n_clusters must be specified")
    v = msgs if "vec" in msgs.columns else vector_stage(msgs, cfg)
    h = embed(v, enc if cfg.use_hyperbolic else None)
    kt = k_table
    if kt is None:
        kt = (h.select(*group).distinct() if group else
              h.sparkSession.range(1).select()).withColumn("k", F.lit(int(k)))
    return cluster_groups(h, list(group), cfg, k_table=kt)


def evaluate(msgs: DataFrame, group: list[str] | tuple = (), enc: EN.Encoder | None = None,
             cfg: RunConfig | None = None) -> DataFrame:
    """X1 with k = number of true events, then NMI and AMI."""
    g = list(group)
    kt = msgs.groupBy(*g).agg(F.countDistinct("event").alias("k")) if g else \
        msgs.agg(F.countDistinct("event").alias("k"))
    pred = detect_events(msgs, k_table=kt, group=g, enc=enc, cfg=cfg)
    return S.evaluate_clustering(pred, "event", "pred", g)


# ------------------------------------------------------------------ many models in one pass

@dataclass
class Model:
    """A run of a configuration: its encoder (None without the hyperbolic stage) and the vectors it reads."""
    cfg: RunConfig
    run: int
    input: str
    enc: EN.Encoder | None


def embed_models(rows: DataFrame, models: dict[str, Model]) -> DataFrame:
    """(msg_id, event, [block_id,] model, seed, h): every row of ``rows`` (input, ..., vec) by every model of its input."""
    spark = rows.sparkSession
    by_input: dict = {}
    for name, m in models.items():
        by_input.setdefault(m.input, []).append((name, m.cfg.seed, m.enc))
    bc = spark.sparkContext.broadcast(by_input)
    keep = [f for f in rows.schema.fields if f.name not in ("input", "vec")]
    schema = EN.T.StructType([*keep, EN.T.StructField("model", EN.T.StringType()), EN.T.StructField("seed", EN.T.LongType()),
                              EN.T.StructField("h", EN.T.ArrayType(EN.T.DoubleType()))])

    def run(batches):
        for pdf in batches:
            for name, part in pdf.groupby("input", sort=False):
                X = C._matrix(part["vec"])
                rest = part.drop(columns=["input", "vec"])
                for model, seed, enc in bc.value.get(name, []):
                    yield rest.assign(model=model, seed=seed, h=list(enc.forward(X) if enc else X))[schema.names]

    return rows.mapInPandas(run, schema)


def score_models(rows: DataFrame, models: dict[str, Model], base: RunConfig, k: dict | None = None, metrics=("nmi", "ami"),
                 n_init: int | None = None, max_iter: int | None = None) -> dict[str, dict]:
    """Model -> scores of its clustering of ``rows``, all models in the same k-means and one score table. ``k``: clusters by
    input, else the distinct events of each model's rows."""
    spark = rows.sparkSession
    h = embed_models(rows, models).persist()
    kt = spark.createDataFrame([(n, int(k[m.input])) for n, m in models.items()], "model string, k long") if k \
        else h.groupBy("model").agg(F.countDistinct("event").alias("k"))
    res = C.keyed_kmeans(h, "h", "msg_id", ["model"], k_table=kt, n_init=n_init or base.n_init,
                         max_iter=max_iter or base.max_iter, seed_col="seed")
    pred = res.predict(h, "h", "pred")
    got = {r["model"]: r.asDict() for r in S.scores(pred, "event", "pred", ["model"], metrics).collect()}  # a row per model
    h.unpersist()
    return got


def train_models(rows: DataFrame, models: dict[str, Model], base: RunConfig, logs: dict | None = None) -> dict:
    """Train every model on the ``train`` part of its input, validated on the ``val`` part after every epoch: one job an
    epoch for all weights, one clustering for all validations. Models whose input lacks a part stay as they are."""
    from functools import reduce
    rows = rows.persist()
    parts = {(r["input"], r["split"]) for r in rows.groupBy("input", "split").count().collect()}    # three per input
    inputs = sorted({m.input for m in models.values() if m.enc is not None
                     and {(m.input, "train"), (m.input, "val")} <= parts})
    todo = {n: m for n, m in models.items() if m.enc is not None and m.input in inputs}
    if not todo:
        rows.unpersist()
        return {}
    cols = ["msg_id", "vec", "event"]
    part = lambda i, s: rows.where((F.col("input") == i) & (F.col("split") == s)).select(*cols)
    table = reduce(DataFrame.unionByName, [EN.training_rows(part(i, "train"), part(i, "val"), name=i) for i in inputs])
    seen = rows.where(F.col("split").isin("train", "val")).groupBy("input").agg(F.countDistinct("event").alias("n"))
    classes = {r["input"]: r["n"] for r in seen.collect()}
    jobs = {n: EN.Training(m.enc, m.cfg.seed, m.input, m.cfg.epochs, m.cfg.lr, m.cfg.weight_decay, m.cfg.patience,
                           log=(logs or {}).get(n)) for n, m in todo.items()}
    val = rows.where(F.col("split") == "val").select("input", *cols)

    def validate(encs: dict) -> dict:
        got = score_models(val.where(F.col("input").isin(sorted({todo[n].input for n in encs}))),
                           {n: todo[n] for n in encs}, base, None, ("nmi", "ami"), base.val_n_init, base.val_max_iter)
        return {n: (got[n]["nmi"], got[n]["ami"]) if n in got else (0.0, 0.0) for n in encs}

    hist = EN.train_many(jobs, table, classes, "msg_id", base.batch_size, validate)
    rows.unpersist()
    return hist


def train_block(enc: EN.Encoder, block: DataFrame, cfg: RunConfig, cuts=(0.7, 0.9),
                log: list | None = None) -> dict | None:
    """Train on the first 70 % (validate on the next 20 %) of one block.

    A block whose train or validation part is empty skips the update.
    """
    sp = B.positional_split(block, cuts, ("train", "val", "test")).withColumn("input", F.lit(""))
    return train_models(sp, {"": Model(cfg, 0, "", enc)}, cfg, {"": log}).get("")


# ------------------------------------------------------------------ X3 offline

def _inputs(vectors: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    return S.union_all([df.select(F.lit(i).alias("input"), *columns) for i, df in vectors.items()])


def offline_runs(vectors: dict[str, DataFrame], cfgs: list[tuple[RunConfig, str]], runs: int = 5,
                 experiment: str = "offline") -> DataFrame:
    """X3/X6 for many configurations at once: ``cfgs`` names the table of ``vectors`` that each one reads. All runs of all
    configurations that share loop settings train in the same passes and are clustered and scored together."""
    spark = next(iter(vectors.values())).sparkSession
    rows = []
    loops: dict = {}
    for at, (cfg, i) in enumerate(cfgs):
        key = (cfg.use_hyperbolic, cfg.batch_size, cfg.n_init, cfg.max_iter, cfg.val_n_init, cfg.val_max_iter)
        loops.setdefault(key, []).append((at, cfg, i))
    for (hyperbolic, *_), members in loops.items():
        base = members[0][1]
        used = {i: vectors[i] for _, _, i in members}
        cut = {i: (B.split_70_20_10 if hyperbolic else B.split_80_20)(B.get_block(df, "M0")) for i, df in used.items()}
        sp = _inputs(cut, ["msg_id", "event", "vec", "split"]).persist()
        facts = {r["input"]: r for r in sp.groupBy("input").agg(
            F.countDistinct("event").alias("k"), F.max(F.size("vec")).alias("dim")).collect()}    # a row per input
        models = {}
        for at, cfg, i in members:
            for r in range(runs):
                rc = replace(cfg, seed=cfg.seed + r)
                enc = EN.Encoder.init(encoder_config(rc, facts[i]["dim"]), rc.seed) if hyperbolic else None
                models[f"{at}:{r}"] = Model(rc, r, i, enc)
        if hyperbolic:
            train_models(sp, models, base)
        test = sp.where(F.col("split") == "test").select("input", "msg_id", "event", "vec")
        got = score_models(test, models, base, {i: f["k"] for i, f in facts.items()}, S.ALL_SCORES)
        rows += [(experiment, m.cfg.name, m.run, "M0", s, float(got[n][s])) for n, m in models.items() if n in got
                 for s in S.ALL_SCORES]
        sp.unpersist()
    return spark.createDataFrame(rows, "experiment string, config string, run long, "
                                       "block_name string, metric string, value double")


def offline_run(vec_blocks: DataFrame, cfg: RunConfig, runs: int = 5,
                experiment: str = "offline") -> DataFrame:
    """On M0, per run: fresh encoder (seed + run), 70/20/10 split, train,
    score the test part with k = distinct events of the whole block. Without
    the hyperbolic stage nothing is trained and the last 20 % are scored."""
    return offline_runs({"": vec_blocks}, [(cfg, "")], runs, experiment)


# ------------------------------------------------------------------ X4 online

def online_runs(vec_blocks: DataFrame, cfgs: list[RunConfig], runs: int = 5, experiment: str = "online") -> DataFrame:
    """M0 then daily blocks in order, every run of every configuration (which may differ in name, window, seed
    and the encoder's settings). At block i the models with i % window == 0 retrain together (K1), then all models
    cluster the block together with k = its distinct events. Weights carry over."""
    spark = vec_blocks.sparkSession
    mine = vec_blocks.storageLevel == StorageLevel.NONE      # a caller's cache stays the caller's
    vb = vec_blocks.persist() if mine else vec_blocks
    ids = [r["block_id"] for r in vb.select("block_id").distinct().orderBy("block_id").collect()]
    dim = len(vb.select("vec").first()["vec"])
    models = {}
    for at, cfg in enumerate(cfgs):
        for r in range(runs):
            rc = replace(cfg, seed=cfg.seed + r)
            models[f"{at}:{r}"] = Model(rc, r, "", EN.Encoder.init(encoder_config(rc, dim), rc.seed)
                                        if rc.use_hyperbolic else None)
    out = []
    for b in ids:
        block = vb.where(F.col("block_id") == b)
        due = {n: m for n, m in models.items() if m.enc is not None and b % m.cfg.window == 0}
        if due:
            train_models(B.positional_split(block, (0.7, 0.9), ("train", "val", "test")).withColumn("input", F.lit("")),
                         due, cfgs[0])
        got = score_models(block.select(F.lit("").alias("input"), "msg_id", "event", "vec"), models, cfgs[0])
        out += [(m.run, b, s, float(got[n][s]), experiment, m.cfg.name, f"M{b}") for n, m in models.items() if n in got
                for s in ("nmi", "ami")]
    if mine:
        vb.unpersist()
    return spark.createDataFrame(out, "run long, block_id long, metric string, value double, experiment string, "
                                      "config string, block_name string")


def online_run(vec_blocks: DataFrame, cfg: RunConfig, runs: int = 5,
               experiment: str = "online") -> DataFrame:
    """Every run of one configuration, see ``online_runs``."""
    return online_runs(vec_blocks, [cfg], runs, experiment)


def window_sweep(vec_blocks: DataFrame, cfg: RunConfig, windows=(1, 2, 3, 4, 5, 1000),
                 runs: int = 5) -> DataFrame:
    """X4 for every window size (1000 stands for never retraining), all in the same passes."""
    return online_runs(vec_blocks, [replace(cfg, window=w, name=f"w={w}") for w in windows], runs, "window")


# ------------------------------------------------------------------ X6-X9

ABLATION_EPOCHS = 50     # fixed value of the original study


def run_config(vec_blocks: DataFrame, cfg: RunConfig, runs: int = 5, epochs: int | None = ABLATION_EPOCHS) -> DataFrame:
    """One configuration, ``runs`` runs of the offline protocol."""
    return offline_run(vec_blocks, cfg if epochs is None else replace(cfg, epochs=epochs), runs, "ablation")


# The five sweeps' settings (fixed values of the original study grids).
GRIDS = {
    "vectorization": [dict(name=f"{e}{'+time' if t else ''}", embedding=e, include_time=t)
                      for e in ("hashed", "word_mean") for t in (True, False)],
    "hyperbolic": [dict(name="no_model_no_hyperbolic", use_summary=False, use_hyperbolic=False),
                   dict(name="no_model", use_summary=False), dict(name="no_hyperbolic", use_hyperbolic=False),
                   dict(name="hyperboloid", manifold="hyperboloid"), dict(name="poincare", manifold="poincare")],
    "prompt": [dict(name=p, prompt_type=p) for p in ("summarize", "paraphrase")],
    "layers": [dict(name=f"layers={n}", num_layers=n) for n in (1, 2, 3, 4, 5)],
    "width": [dict(name=f"hidden={w}", hidden_dim=w) for w in (16, 32, 64, 128, 256, 512)],
}


def sweep(msgs_blocks: DataFrame, base: RunConfig, grid: list[dict], runs: int = 5,
          vectors: DataFrame | None = None, epochs: int | None = ABLATION_EPOCHS, made: dict | None = None) -> DataFrame:
    """Every setting of a grid, all trained in the same passes (``offline_runs``); the vector stage is
    computed once per distinct vector key and written to the shared folder. Without ``vectors`` the word-vector
    settings train their own on the corpus. ``made`` shares the tables between grids."""
    made = {} if made is None else made
    cfgs = []
    for setting in grid:
        cfg = replace(base, **setting) if epochs is None else replace(base, **setting, epochs=epochs)
        key = repr(cfg.vector_key())
        if key not in made:
            made[key] = written(vector_stage(msgs_blocks, cfg, vectors), "sweep-vectors")
        cfgs.append((cfg, key))
    return offline_runs({k: made[k] for _, k in cfgs}, cfgs, runs, "ablation")


def run_ablation(msgs_blocks: DataFrame, base: RunConfig, runs: int = 5, vectors: DataFrame | None = None,
                 epochs: int | None = ABLATION_EPOCHS, grids: dict | None = None) -> DataFrame:
    """All five sweeps (22 settings) on one loaded table, in the same passes."""
    grids = grids or GRIDS
    named = [dict(s, name=f"{g}/{s['name']}") for g, rows in grids.items() for s in rows]
    got = sweep(msgs_blocks, base, named, runs, vectors, epochs)
    parts = F.split("config", "/", 2)
    return got.select("experiment", parts[1].alias("config"), "run", "block_name", "metric", "value", parts[0].alias("grid"))


def run_all(spark: SparkSession, msgs: DataFrame, base: RunConfig, runs: int = 5,
            windows=(1, 2, 3, 4, 5, 1000), epochs: int | None = ABLATION_EPOCHS, grids: dict | None = None) -> dict:
    """Offline, online, ablation and window analysis on one input."""
    blocks = B.assign_blocks(msgs)
    vb = written(vector_stage(blocks, base), "vectors")
    return {"offline": offline_run(vb, base, runs), "online": online_run(vb, base, runs),
            "ablation": run_ablation(blocks, base, runs, None, epochs, grids),
            "window": window_sweep(vb, base, windows, runs)}


# ------------------------------------------------------------------ bench helpers

def bench_block_kmeans(spark: SparkSession, sf_dir: str) -> None:
    """C12 at scale: k-means++ with 10 starts in every block at once."""
    from horosphere.plans.catalog import block_points
    pts = block_points(spark, sf_dir).persist()
    kt = pts.groupBy("block_id").agg(F.countDistinct("event").alias("k"))
    res = C.keyed_kmeans(pts, "vec", "msg_id", ["block_id"], k_table=kt, n_init=10,
                         max_iter=50, seed=42)
    pred = res.predict(pts, "vec", "pred")
    S.evaluate_clustering(pred, "event", "pred", ["block_id"]).write.format("noop") \
        .mode("overwrite").save()
    pts.unpersist()


def bench_encoder(spark: SparkSession, sf_dir: str, epochs: int = 5) -> None:
    """E6/E5 at scale: a few full-batch epochs on M0, then encode every message."""
    from horosphere.plans.catalog import block_points
    pts = block_points(spark, sf_dir).persist()
    m0 = B.get_block(pts, "M0")
    enc = EN.Encoder.init(EN.EncoderConfig(66), 42)
    EN.train(enc, m0, None, epochs, seed=42, vec="vec", label="event", id_col="msg_id")
    EN.encode(pts, enc, "vec", "h").write.format("noop").mode("overwrite").save()
    pts.unpersist()
