"""Quantization of the embedding table."""

from pyspark.sql import functions as F

from ..operators import vectors as vq
from ..session import scratch_path
from ..streaming.rows import run_batches
from . import fixtures as fx
from .registry import query

DIM, BITS = 64, 4


def numbers(xs) -> str:
    return "[" + ", ".join(repr(float(x)) for x in xs) + "]"


CENTROIDS, EDGES = vq.codebook(BITS, DIM)
ROT = "[" + ", ".join(numbers(r) for r in vq.rotation(DIM)) + "]"
UNIT_SQL = (
    "SELECT vec_id, label, embedding, greatest(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 1e-10) AS norm FROM embeddings"
)
ROTATED_SQL = (
    f"SELECT vec_id, label, norm, embedding, list_transform({ROT}, lambda r: list_sum(list_transform(r, lambda w, i: w * (embedding[i]::DOUBLE / norm)))) AS y FROM ({UNIT_SQL})"
)
CODED_SQL = f"SELECT *, list_transform(y, lambda v: len(list_filter({numbers(EDGES)}, lambda b: b < v))) AS code FROM ({ROTATED_SQL})"
RESTORED_SQL = (
    f"SELECT vec_id, label, embedding, list_transform(range(1, {DIM + 1}), lambda j: norm * list_sum(list_transform(code, lambda c, i: ({numbers(CENTROIDS)})[c + 1] * ({ROT})[i][j]))) AS restored FROM ({CODED_SQL})"
)


def vecs(spark, sf):
    return fx.table(spark, sf, "embeddings")


@query(
    "q1_codebook_levels",
    f"SELECT level, round(c::DOUBLE, 9) AS centroid, n FROM (SELECT unnest(range({2**BITS})) AS level, unnest({numbers(CENTROIDS)}) AS c) JOIN (SELECT level, count(*) AS n FROM (SELECT unnest(code) AS level FROM ({CODED_SQL})) GROUP BY 1) USING (level)",
)
def q1(spark, sf):
    """Levels of the codebook with how often the table uses them."""
    c, _ = vq.codebook(BITS, DIM)
    levels = spark.createDataFrame([(i, round(float(x), 9)) for i, x in enumerate(c)], "level int, centroid double")
    used = vecs(spark, sf).select(F.explode(vq.quantize(F.col("embedding"), DIM, BITS)["code"]).alias("level"))
    return used.groupBy("level").agg(F.count("*").alias("n")).join(F.broadcast(levels), "level")


ROUNDS = 5


def fitted_sql() -> str:
    """The fit in SQL: one pair of CTEs per round, from equal steps between the extremes."""
    k = 2**BITS
    edges = "(SELECT list_transform(range(1, {k}), lambda i: (c[i] + c[i + 1]) / 2) AS e FROM c{r})"
    level = "(SELECT len(list_filter(e, lambda b: x > b)) AS level, x FROM xs, " + edges + ")"
    parts = [
        f"xs AS MATERIALIZED (SELECT unnest(y) AS x FROM ({ROTATED_SQL}))",
        f"c0 AS (SELECT list_transform(range({k}), lambda i: lo + (hi - lo) * (2 * i + 1) / {2 * k}) AS c FROM (SELECT min(x) AS lo, max(x) AS hi FROM xs))",
    ]
    for r in range(ROUNDS):
        parts.append(f"m{r} AS (SELECT level, avg(x) AS m FROM {level.format(k=k, r=r)} GROUP BY 1)")
        parts.append(
            f"c{r + 1} AS MATERIALIZED (SELECT list(coalesce(m, v) ORDER BY i) AS c FROM (SELECT unnest(range({k})) AS i, unnest(c) AS v FROM c{r}) LEFT JOIN m{r} ON level = i)"
        )
    return f"WITH {', '.join(parts)} SELECT level, count(*) AS n, round(avg(x), 6) AS centroid FROM {level.format(k=k, r=ROUNDS)} GROUP BY 1"


@query("q1_fitted_codebook", fitted_sql())
def q1_fit(spark, sf):
    """Data-fitted variant: level means of the rotated coordinates after a few rounds."""
    values = vecs(spark, sf).select(F.explode(vq.rotate(F.col("embedding"), DIM)).alias("x"))
    c = vq.fit_codebook(values, "x", 2**BITS, ROUNDS)
    edges = F.array(*[F.lit((a + b) / 2) for a, b in zip(c, c[1:])])
    level = F.size(F.filter(edges, lambda e: F.col("x") > e))
    return values.groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.round(F.avg("x"), 6).alias("centroid"))


@query("q2_rotation", f"SELECT vec_id, i - 1 AS dim, round(y[i], 6) AS y FROM (SELECT vec_id, y, unnest(range(1, {DIM + 1})) AS i FROM ({ROTATED_SQL}))")
def q2(spark, sf):
    rows = vecs(spark, sf).select("vec_id", F.posexplode(vq.rotate(F.col("embedding"), DIM)).alias("dim", "y"))
    return rows.withColumn("y", F.round("y", 6))


@query("q3_quantize", f"SELECT vec_id, round(norm, 6) AS norm, array_to_string(code, ',') AS code FROM ({CODED_SQL})")
def q3(spark, sf):
    rows = vecs(spark, sf).select("vec_id", vq.quantize(F.col("embedding"), DIM, BITS).alias("q"))
    return rows.select(
        "vec_id", F.round("q.norm", 6).alias("norm"),
        F.array_join(F.transform("q.code", lambda c: c.cast("string")), ",").alias("code"),
    )


@query("q4_dequantize", f"SELECT vec_id, i - 1 AS dim, round(restored[i], 6) AS x FROM (SELECT vec_id, restored, unnest(range(1, {DIM + 1})) AS i FROM ({RESTORED_SQL}))")
def q4(spark, sf):
    rows = vq.round_trip(vecs(spark, sf), DIM, BITS)
    return rows.select("vec_id", F.posexplode("restored").alias("dim", "x")).withColumn("x", F.round("x", 6))


def sum_sql(expr: str) -> str:
    return f"list_sum(list_transform(embedding, lambda x, i: {expr}))"


@query(
    "q5_distortion",
    f"""SELECT label, count(*) AS n, round(avg(err), 6) AS mse, round(avg(err / nullif(aa, 0)), 6) AS relative_mse, round(avg(ab / nullif(sqrt(aa * bb), 0)), 6) AS cosine FROM (
          SELECT label, {sum_sql('(x::DOUBLE - restored[i]) * (x::DOUBLE - restored[i])')} AS err, {sum_sql('x::DOUBLE * x::DOUBLE')} AS aa, {sum_sql('restored[i] * restored[i]')} AS bb,
            {sum_sql('x::DOUBLE * restored[i]')} AS ab FROM ({RESTORED_SQL})) GROUP BY 1""",
)
def q5(spark, sf):
    return vq.distortion(vq.round_trip(vecs(spark, sf), DIM, BITS), ["label"])


RMS_SQL = f"SELECT dim, round(sqrt(avg(x * x)), 9) AS rms FROM (SELECT unnest(range({DIM})) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1"


@query("a21_channel_rms", RMS_SQL.replace("9) AS rms", "6) AS rms"))
def a21(spark, sf):
    return vq.channel_rms(vecs(spark, sf)).withColumn("rms", F.round("rms", 6))


@query("l7_outlier_channels", f"SELECT dim, round(r, 6) AS rms FROM (SELECT dim, rms AS r FROM ({RMS_SQL}) ORDER BY r DESC, dim LIMIT 8)")
def l7(spark, sf):
    return vq.outlier_channels(vq.channel_rms(vecs(spark, sf)), 8).select("dim", F.round("rms", 6).alias("rms"))


def mask(spark, sf, n: int) -> list[int]:
    """At most DIM channel numbers come to the driver."""
    return [r["dim"] for r in vq.outlier_channels(vq.channel_rms(vecs(spark, sf)), n).collect()]


def sub_round_trip_sql(source: str, dim: int, bits: int, seed: int) -> str:
    """Adds `restored` to rows (vec_id, v): normalise, rotate, code and come back."""
    centroids, edges = vq.codebook(bits, dim)
    rot = "[" + ", ".join(numbers(r) for r in vq.rotation(dim, seed)) + "]"
    unit = f"SELECT *, greatest(sqrt(list_sum(list_transform(v, lambda x: x * x))), 1e-10) AS norm FROM ({source})"
    turned = f"SELECT *, list_transform({rot}, lambda r: list_sum(list_transform(r, lambda w, i: w * (v[i] / norm)))) AS y FROM ({unit})"
    coded = f"SELECT *, list_transform(y, lambda z: ({numbers(centroids)})[len(list_filter({numbers(edges)}, lambda b: b < z)) + 1]) AS back FROM ({turned})"
    return f"SELECT vec_id, list_transform(range(1, {dim + 1}), lambda j: norm * list_sum(list_transform(back, lambda c, i: c * ({rot})[i][j]))) AS restored FROM ({coded})"


# channels of largest RMS go to one sub-vector and the rest to another, each with a rotation and codebook of its own
MIXED_SQL = f"""WITH rms AS ({RMS_SQL}),
  top AS (SELECT list(dim ORDER BY dim) AS o FROM (SELECT dim FROM rms ORDER BY rms DESC, dim LIMIT 16)),
  pick AS (SELECT o, list_filter(range({DIM}), lambda i: NOT list_contains(o, i)) AS r FROM top),
  cut AS (SELECT vec_id, label, embedding, list_transform(r, lambda i: embedding[i + 1]::DOUBLE) AS rv, list_transform(o, lambda i: embedding[i + 1]::DOUBLE) AS ov FROM embeddings, pick),
  back AS (SELECT cut.*, a.restored AS ra, b.restored AS rb FROM cut JOIN ({sub_round_trip_sql('SELECT vec_id, rv AS v FROM cut', DIM - 16, 3, 42)}) a USING (vec_id)
    JOIN ({sub_round_trip_sql('SELECT vec_id, ov AS v FROM cut', 16, 4, 43)}) b USING (vec_id)),
  whole AS (SELECT label, embedding, list_transform(range({DIM}), lambda i: CASE WHEN list_contains(o, i) THEN rb[list_position(o, i)] ELSE ra[list_position(r, i)] END) AS restored FROM back, pick)
SELECT label, count(*) AS n, round(avg(err), 6) AS mse, round(avg(err / nullif(aa, 0)), 6) AS relative_mse, round(avg(ab / nullif(sqrt(aa * bb), 0)), 6) AS cosine FROM (
  SELECT label, {sum_sql('(x::DOUBLE - restored[i]) * (x::DOUBLE - restored[i])')} AS err, {sum_sql('x::DOUBLE * x::DOUBLE')} AS aa, {sum_sql('restored[i] * restored[i]')} AS bb,
    {sum_sql('x::DOUBLE * restored[i]')} AS ab FROM whole) GROUP BY 1"""


@query("q6_outlier_channels", MIXED_SQL)
def q6(spark, sf):
    rows = vq.mixed_round_trip(vecs(spark, sf), DIM, 3, 4, mask(spark, sf, 16))
    return vq.distortion(rows, ["label"])


def sub_codes_sql(source: str, dim: int, bits: int, seed: int) -> str:
    _, edges = vq.codebook(bits, dim)
    rot = "[" + ", ".join(numbers(r) for r in vq.rotation(dim, seed)) + "]"
    unit = f"SELECT *, greatest(sqrt(list_sum(list_transform(v, lambda x: x * x))), 1e-10) AS norm FROM ({source})"
    turned = f"SELECT *, list_transform({rot}, lambda r: list_sum(list_transform(r, lambda w, i: w * (v[i] / norm)))) AS y FROM ({unit})"
    return f"SELECT vec_id, norm, list_transform(y, lambda z: len(list_filter({numbers(edges)}, lambda b: b < z))) AS code FROM ({turned})"


# the mask is that of the first wave
APPEND_SQL = f"""WITH rms AS ({RMS_SQL.replace("FROM embeddings", "FROM (SELECT * FROM embeddings WHERE vec_id % 2 = 0)")}),
  top AS (SELECT list(dim ORDER BY dim) AS o FROM (SELECT dim FROM rms ORDER BY rms DESC, dim LIMIT 16)),
  pick AS (SELECT o, list_filter(range({DIM}), lambda i: NOT list_contains(o, i)) AS r FROM top),
  cut AS (SELECT vec_id, list_transform(r, lambda i: embedding[i + 1]::DOUBLE) AS rv, list_transform(o, lambda i: embedding[i + 1]::DOUBLE) AS ov FROM embeddings, pick)
SELECT vec_id, array_to_string(a.code, ',') AS regular, array_to_string(b.code, ',') AS outlier, round(a.norm, 4) AS norm, round(b.norm, 4) AS outlier_norm,
  (({DIM} - 16) * 3 + 16 * 4 + 2 * 32) // 8 AS n_bytes
FROM ({sub_codes_sql('SELECT vec_id, rv AS v FROM cut', DIM - 16, 3, 42)}) a JOIN ({sub_codes_sql('SELECT vec_id, ov AS v FROM cut', 16, 4, 43)}) b USING (vec_id)"""


@query("q7_append_codes", APPEND_SQL)
def q7(spark, sf):
    """Vectors arrive in two waves; each wave is coded with the state that the first one made and appended, earlier codes stay."""
    waves, sink = scratch_path(spark, "waves"), scratch_path(spark, "codes")
    rows = vecs(spark, sf).select("vec_id", "embedding")
    for lo in (0, 1):
        rows.filter(F.col("vec_id") % 2 == lo).coalesce(1).write.mode("append").parquet(waves)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(waves)
    run_batches(stream, sink, lambda batch, n: vq.append_packed(batch, n, sink, DIM, 3, 4, 16))
    state = vq.QuantizerState.load(spark, f"{sink}-state")
    done = spark.read.parquet(sink).withColumn("c", vq.unpack(F.col("packed.codes"), state))
    shown = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    norm = lambda i: F.round(F.get("packed.norms", F.lit(i)).cast("double"), 4)
    size = F.length("packed.codes") + 4 * F.size("packed.norms")
    return done.select(
        "vec_id", shown(F.col("c.regular")).alias("regular"), shown(F.col("c.outlier")).alias("outlier"), norm(0).alias("norm"), norm(1).alias("outlier_norm"),
        size.alias("n_bytes"),
    )


PLANS = [(4, 0, 0), (3, 0, 0), (3, 16, 4)]
SIZE_SQL = """SELECT bits, outliers, outlier_bits, eff_bits, sum(coded)::BIGINT AS stored_bits, sum(d * 16)::BIGINT AS float_bits, round(sum(d * 16) / sum(coded), 6) AS factor FROM (
    SELECT p.*, len(embedding) AS d, CASE WHEN outlier_bits > bits THEN (len(embedding) - outliers) * bits + outliers * outlier_bits + 64 ELSE len(embedding) * bits + 32 END AS coded
    FROM embeddings, (VALUES (4, 0, 0, 4.0::DOUBLE), (3, 0, 0, 3.0::DOUBLE), (3, 16, 4, 3.25::DOUBLE)) p(bits, outliers, outlier_bits, eff_bits)) GROUP BY ALL"""


@query("a22_storage_accounting", SIZE_SQL)
def a22(spark, sf):
    return vq.size_report(vecs(spark, sf), DIM, PLANS)


@query("q8_size_report", f"SELECT bits, eff_bits, factor FROM ({SIZE_SQL})")
def q8(spark, sf):
    return vq.size_report(vecs(spark, sf), DIM, PLANS).select("bits", "eff_bits", "factor")
