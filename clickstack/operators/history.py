"""Query-aware pooling of a click history with embedding tables (the data half of the
sequence encoder).

A token's score is a dot product with the row's query vector, which is a weighted sum of
context embeddings; so the score is the same weighted sum of dot products of the token with
each context value.  Those are computed once per DISTINCT (token, context value) pair and
joined back as numbers: no vector is copied onto a token.  For contexts of few values the products
are one map per token, so the exploded tokens are shuffled once.  One groupBy(row) keeps the top-k
(map-side partial collect of small structs); representation vectors are fetched for the k
chosen tokens only.  Vector tables are broadcast when their size is small (checked),
otherwise joined by shuffle.  An id without a vector counts as the zero vector."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as vx
from ..functions.sequence import parse_lenient, tail
from ..session import cut_lineage, may_broadcast

# Fixed value: epsilon inside the log of the recency decay.
DECAY_EPS = 1e-8


@dataclass(frozen=True)
class HistorySpec:
    seq_col: str = "seq"
    row_key: str = "rid"
    max_len: int = 400
    top_k: int = 120
    tau: float = 512.0
    gating: str = "softmax"  # softmax | relu
    query_mode: str = "concat"  # S1 | S2 | concat
    query_key: str = "inventory_id"
    context_cols: tuple = ()
    dim: int = 64
    # id shift of each lookup into the embedding table: table row vec_id = key + offset
    att_offset: int = 0
    rep_offset: int = 0
    query_offset: int = 0
    context_offsets: dict = field(default_factory=dict)


MAP_VALUES = 256  # a context column of up to so many values is looked up in the token's map
TASK_TOKENS = 2_000_000  # exploded tokens that one task groups by row
BROADCAST_PRODUCTS = 500_000  # products of tokens and context values that may be broadcast as maps
BROADCAST_VALUES = 8_000_000  # vector elements that may be broadcast (64 MB of doubles)


def lookup(emb: DataFrame, offset: int, out: str, key: str = "_key") -> DataFrame:
    """(key, vector<double>) view of the embedding table with vec_id = key + offset."""
    return emb.select((F.col("vec_id") - F.lit(int(offset))).alias(key), vx.as_double("embedding").alias(out))


def with_vector(rows: DataFrame, emb: DataFrame, offset: int, key: str, out: str, dim: int, vectors: int | None = None) -> DataFrame:
    """``rows`` with the vector of ``key`` (zero where there is none).  A large embedding table
    (``vectors`` rows, counted if not given) is first cut to the ids that occur; what is left is
    broadcast if it is small."""
    table = lookup(emb, offset, out, key)
    if (emb.count() if vectors is None else vectors) * dim > BROADCAST_VALUES:
        table = table.join(rows.select(key).distinct(), key, "left_semi")
        small = table.select(key).limit(BROADCAST_VALUES // dim + 1).count() * dim <= BROADCAST_VALUES
    else:
        small = True
    joined = rows.join(F.broadcast(table) if small else table, key, "left")
    return joined.withColumn(out, F.coalesce(out, vx.zeros(dim)))


def query_parts(spec: HistorySpec) -> list[tuple[str, int, float]]:
    """(column, offset, weight) of the context embeddings that make up the query vector: S1 =
    the query key, S2 = mean of the context columns, concat = their average."""
    if spec.query_mode not in ("S1", "S2", "concat"):
        raise ValueError(f"unknown query mode {spec.query_mode!r}")
    half = 0.5 if spec.query_mode == "concat" else 1.0
    own = [(spec.query_key, spec.query_offset, half)] if spec.query_mode != "S2" else []
    n = len(spec.context_cols)
    rest = [(c, spec.context_offsets.get(c, 0), half / n) for c in spec.context_cols] if spec.query_mode != "S1" else []
    return own + rest


def with_query_vectors(rows: DataFrame, emb: DataFrame, spec: HistorySpec) -> DataFrame:
    """``rows`` with the query vectors of all modes (``s1``, ``s2``, ``concat``) from one lookup
    of each context column."""
    n = emb.count()
    df = with_vector(rows, emb, spec.query_offset, spec.query_key, "s1", spec.dim, n)
    ctx = []
    for c in spec.context_cols:
        df = with_vector(df, emb, spec.context_offsets.get(c, 0), c, f"_ctx_{c}", spec.dim, n)
        ctx.append(f"_ctx_{c}")
    return (df.withColumn("s2", vx.mean(ctx, spec.dim))
            .withColumn("concat", vx.combine(["s1", "s2"], [0.5, 0.5], spec.dim)).drop(*ctx))


def histories(rows: DataFrame, spec: HistorySpec) -> DataFrame:
    """(row, context columns, kept tokens, their number), written once."""
    keys = list(dict.fromkeys(c for c, _, _ in query_parts(spec)))
    toks = tail(parse_lenient(F.col(spec.seq_col)), spec.max_len)
    # per-row values are projected BEFORE the generator; an expression placed next to
    # posexplode would be evaluated once per output token (re-parsing the history)
    return cut_lineage(rows.select(spec.row_key, *keys, toks.alias("_toks")).withColumn("_L", F.size("_toks")), "histories")


def token_scores(rows: DataFrame, emb: DataFrame, spec: HistorySpec) -> DataFrame:
    """One row per (row, kept token): score = <att(token), q> + ln(exp(-age/max(1,tau)) + 1e-8),
    age = position from the newest token."""
    return _scored(histories(rows, spec), emb, spec)


def _scored(base: DataFrame, emb: DataFrame, spec: HistorySpec, by_row: bool = False) -> DataFrame:
    """``token_scores`` of ``histories``.  ``by_row``: the rows are dealt by their key before their tokens are
    made, some ``TASK_TOKENS`` a task, so that grouping the tokens by row needs no shuffle of them; a
    row's first record carries ``_row`` = 1, and rows without tokens are one record without token."""
    parts = query_parts(spec)
    keys = list(dict.fromkeys(c for c, _, _ in parts))
    n = emb.count()
    size = base.agg(F.sum("_L").alias("_tokens"), *[F.countDistinct(c).alias(c) for c in keys]).first()
    few = [c for c in keys if size[c] <= MAP_VALUES]
    dealt = base
    if by_row:
        slots = max((size["_tokens"] or 0) // TASK_TOKENS + 1, int(base.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        dealt = base.repartition(slots, spec.row_key)
    generate = F.posexplode_outer if by_row else F.posexplode
    e = dealt.select(spec.row_key, *keys, "_L", generate("_toks").alias("pos", "token"))
    first = F.coalesce("pos", F.lit(0)) == 0
    e = e.where(F.col("token").isNotNull() | first) if by_row else e.where(F.col("token").isNotNull())
    age = (F.col("_L") - 1 - F.col("pos")).cast("double")
    decay = F.exp(-age / F.lit(max(1.0, float(spec.tau))))

    def products(pairs):  # (token, ctx) -> (token, ctx, dot)
        pairs = with_vector(pairs.distinct(), emb, spec.att_offset, "token", "_att", spec.dim, n)
        return with_vector(pairs, emb, 0, "ctx", "_ctx", spec.dim, n).select("token", "ctx", vx.dot("_att", "_ctx", spec.dim).alias("dot"))

    ctx = {c: F.col(c).cast("long") + F.lit(int(offset)) for c, offset, _ in parts}  # ids in the embedding table
    if few:
        once = base.select(F.explode(F.array_distinct("_toks")).alias("token"), F.array(*[ctx[c] for c in few]).alias("_c"))
        pairs = once.select("token", F.explode("_c").alias("ctx")).where("token is not null and ctx is not null")
        maps = products(pairs).groupBy("token").agg(F.map_from_entries(F.collect_list(F.struct("ctx", "dot"))).alias("_dots"))
        if may_broadcast(base.sparkSession):
            maps = cut_lineage(maps, "dots")  # few maps are broadcast, so no token is shuffled for them
            if (maps.agg(F.sum(F.size("_dots"))).first()[0] or 0) <= BROADCAST_PRODUCTS:
                maps = F.broadcast(maps)
        e = e.join(maps, "token", "left")
    score = F.lit(0.0)
    for i, (c, _, weight) in enumerate(parts):
        if c in few:
            dot = F.when(ctx[c].isNotNull(), F.try_element_at("_dots", ctx[c]))
        else:
            dots = products(e.select("token", ctx[c].alias("ctx")).where("ctx is not null"))
            e = e.withColumn(f"_x{i}", ctx[c]).join(dots.select("token", F.col("ctx").alias(f"_x{i}"), F.col("dot").alias(f"_d{i}")), ["token", f"_x{i}"], "left")
            dot = F.col(f"_d{i}")
        score = score + F.lit(weight) * F.coalesce(dot, F.lit(0.0))
    own = [F.when(first, 1).alias("_row")] if by_row else []
    return e.select(spec.row_key, "pos", "token", (score + F.ln(decay + F.lit(DECAY_EPS))).alias("score"), *own)


def selected(rows: DataFrame, emb: DataFrame, spec: HistorySpec) -> DataFrame:
    """(row, sel): the top-k (score desc, older position first) as an array of
    (ns = -score, pos, token) structs."""
    return _chosen(rows, emb, spec).where(F.size("sel") > 0).select(spec.row_key, "sel")


def _chosen(rows: DataFrame, emb: DataFrame, spec: HistorySpec) -> DataFrame:
    """``selected`` with ``_n``, the rows of each key, and with the keys of rows without tokens."""
    sc = _scored(histories(rows, spec), emb, spec, by_row=True)
    one = F.struct((-F.col("score")).alias("ns"), F.col("pos"), F.col("token"))
    agg = sc.groupBy(spec.row_key).agg(F.collect_list(F.when(F.col("token").isNotNull(), one)).alias("_c"), F.count("_row").alias("_n"))
    return agg.select(spec.row_key, "_n", F.slice(F.sort_array("_c"), 1, spec.top_k).alias("sel"))


def top_k(rows: DataFrame, emb: DataFrame, spec: HistorySpec) -> DataFrame:
    """(row, rank, pos, token, score) of the selected tokens."""
    sel = selected(rows, emb, spec)
    return sel.select(spec.row_key, F.posexplode("sel").alias("rank", "_s")).select(
        spec.row_key, (F.col("rank") + 1).alias("rank"), F.col("_s.pos").alias("pos"),
        F.col("_s.token").alias("token"), (-F.col("_s.ns")).alias("score"))


def pool(rows: DataFrame, emb: DataFrame, spec: HistorySpec) -> DataFrame:
    """Per row: softmax (or relu) weights over the selected scores and the weighted sum
    of representation vectors; rows without history get a zero vector and n_sel = 0."""
    d = spec.dim
    # a row without key has no history of its own
    sel = _chosen(rows, emb, spec).withColumn("sel", F.when(F.col(spec.row_key).isNotNull(), F.col("sel")))
    if spec.gating == "relu":
        z = F.aggregate("sel", F.lit(0.0), lambda a, x: a + F.greatest(-x["ns"], F.lit(0.0))) + F.lit(1e-12)
        w = lambda m, z, ns: F.greatest(-ns, F.lit(0.0)) / z
    else:
        z = F.aggregate("sel", F.lit(0.0), lambda a, x: a + F.exp(-x["ns"] + F.get("sel", F.lit(0))["ns"]))
        w = lambda m, z, ns: F.exp(-ns - m) / z
    sel = sel.select(spec.row_key, "_n", z.alias("_z"), (-F.get("sel", F.lit(0))["ns"]).alias("_m"), F.explode_outer("sel").alias("_s"))
    picked = with_vector(sel.select(spec.row_key, "_n", F.col("_s.token").alias("token"), w(F.col("_m"), F.col("_z"), F.col("_s.ns")).alias("_w")),
                         emb, spec.rep_offset, "token", "_rep", d)
    # the rows lie by their key, so their vectors are added up where they are, in one sum per dimension
    pooled = picked.groupBy(spec.row_key).agg(
        F.first("_n").alias("_n"), F.count("token").alias("n_sel"),
        F.array(*[F.coalesce(F.sum(F.col("_w") * F.get("_rep", F.lit(i))), F.lit(0.0)) for i in range(d)]).alias("pooled"))
    return pooled.select(spec.row_key, "n_sel", "pooled", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))).alias("_copy")).drop("_copy")


def fm_interaction(vectors: list, dim: int | None = None) -> Column:
    """Pairwise low-rank interaction 0.5 * sum_d ((sum_i v_id)^2 - sum_i v_id^2)."""
    vs = [F.col(v) if isinstance(v, str) else v for v in vectors]
    s = vx.combine(vs, [1.0] * len(vs))
    sq = vx.combine([F.transform(v, lambda x: x * x) for v in vs], [1.0] * len(vs))
    diff = F.zip_with(s, sq, lambda a, b: a * a - b)
    return 0.5 * F.aggregate(diff, F.lit(0.0), lambda acc, x: acc + x)
