"""Pairs of entities made so that every bridge reason, guard and merge method occurs, from the vectors of the test table.

Two vectors in a row make a pair: the first entity's point is the one, the second's leans to it as far as the wanted score. Frames, boxes,
numbers of tracklets and labels come from the pair's scenario.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..lineage import cut
from ..operators import similarity
from ..plans import merge
from ..sources import derived as d
from . import merging
from .geometry import size_ratio_sql
from .labels import CLOTH, STRONG
from .registry import register
from .similarity import ANN

FLOOR = 0.3
#: (score, tracklets of both, frame gap, shift of the second's boxes, their growth, labels, first attached only, second on two devices); labels: 0 none,
#: 1 all alike, 3 hard task opposed twice, 4 once, 5 all but the hard task alike
SCENARIOS = [
    (0.60, 1, 3, 0, 5, 1.0, 0, False, False), (0.70, 1, 3, 0, 40, 1.0, 0, False, False), (0.80, 3, 5, 2, 6, 1.0, 0, False, False),
    (0.65, 3, 5, 100, 3, 1.0, 0, False, False), (0.55, 3, 4, 0, 2, 1.0, 1, False, False), (0.72, 3, 3, 10, 15, 1.0, 0, False, False),
    (0.55, 2, 6, 4, 15, 1.0, 0, False, False), (0.55, 2, 9, 4, 15, 1.0, 1, False, False), (0.56, 3, 4, 50, 20, 1.0, 1, False, False),
    (0.56, 2, 3, 120, 60, 1.0, 1, False, False), (0.88, 5, 6, 100, 40, 1.0, 1, False, False), (0.62, 5, 6, 100, 75, 1.0, 1, False, False),
    (0.55, 1, 7, 10, 35, 1.0, 0, False, False), (0.55, 3, 4, 3, 5, 1.0, 0, False, False), (0.55, 2, 4, 10, 35, 1.0, 0, False, False),
    (0.42, 1, 3, 10, 35, 1.0, 0, False, False),
    # optional reasons
    (0.53, 2, 6, 100, 75, 1.0, 5, False, False), (0.55, 5, 6, 100, 60, 1.0, 0, False, False), (0.42, 2, 9, 40, 35, 1.0, 0, False, False),
    # guards
    (0.60, 5, 6, 2000, 0, 1.0, 0, False, False), (0.62, 2, 6, 100, 75, 1.6, 1, True, False), (0.80, 2, 9, 10, 15, 1.0, 0, False, False),
    (0.65, 3, 5, 100, 3, 1.0, 3, False, False), (0.82, 1, 4, 2000, 0, 1.0, 0, False, False), (0.60, 3, 4, 0, 200, 1.0, 0, False, True),
    (0.55, 2, 4, 4, 15, 1.0, 4, False, False),
    # methods without a bridge
    (0.87, 2, 4, 8, 100, 1.0, 0, False, False), (0.75, 1, 3, 2, 100, 1.0, 0, False, False), (0.65, 1, 3, 100, 150, 1.0, 0, False, False),
    (0.85, 1, 4, 2000, 0, 1.0, 1, False, False), (0.60, 1, 4, 2000, 0, 1.0, 0, False, True), (0.95, 3, 5, 2000, 0, 1.0, 0, False, False),
]
COLUMNS = ("k", "score", "n_a", "n_b", "gap", "dx", "grow", "mode", "attached", "two")
VALUES = ", ".join(f"({k}, {s}::DOUBLE, {a}, {b}, {gap}, {dx}, {g}::DOUBLE, {m}, {at}, {two})" for k, (s, a, b, gap, dx, g, m, at, two) in enumerate(SCENARIOS))

PAIRED = f"""sc({', '.join(COLUMNS)}) AS (VALUES {VALUES}),
un AS (SELECT vec_id AS i, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings),
pa AS (SELECT a.i // 2 AS p, a.v AS va, n.v AS vb, list_dot_product(a.v, n.v) AS rho FROM un a JOIN un n ON n.i = a.i + 1 WHERE a.i % 2 = 0),
ps AS (SELECT pa.*, sc.* FROM pa JOIN sc ON sc.k = p % {len(SCENARIOS)}),
pts AS (SELECT 2 * p AS entity_id, va AS vec FROM ps UNION ALL SELECT 2 * p + 1, list_transform(range(1, len(va) + 1), lambda j:
    score * va[j] + sqrt(1 - score * score) / sqrt(1 - rho * rho) * (vb[j] - rho * va[j])) FROM ps),
bth AS (SELECT a.entity_id, b.entity_id AS other_id, {ANN}(a.vec, b.vec) AS score FROM pts a JOIN pts b ON a.entity_id <> b.entity_id AND {ANN}(a.vec, b.vec) >= {FLOOR - merge.MARGIN_REACH}),
near AS (SELECT *, row_number() OVER w AS rank, lead(score) OVER w AS runner_up FROM bth WINDOW w AS (PARTITION BY entity_id ORDER BY score DESC, other_id)),
tk AS (SELECT ps.*, side, t, p * 100000 + (n_a - 1) * 400 + 20 AS last FROM ps, (VALUES (0), (1)) s(side), range(9) r(t) WHERE t < CASE side WHEN 0 THEN n_a ELSE n_b END),
tf AS (SELECT *, CASE WHEN side = 0 THEN p * 100000 + t * 400 WHEN gap = 0 THEN last - 10 + t * 400 ELSE last + gap + t * 400 END AS frame_start,
    (100 + side * dx)::DOUBLE AS bx1, CASE side WHEN 0 THEN 100.0 ELSE 250 - 150 * grow END::DOUBLE AS by1, CASE side WHEN 0 THEN 160.0 ELSE 100 + dx + 60 * grow END::DOUBLE AS bx2 FROM tk),
trk AS (SELECT concat(p, ':', side, ':', t) AS tracklet_id, 2 * p + side AS entity_id, concat('d', (p + CASE WHEN two AND side = 1 AND t = 1 THEN 1 ELSE 0 END) % 4) AS device_id,
    frame_start, frame_start + 20 AS frame_end, CASE WHEN attached AND side = 0 THEN 'occlusion_attached' ELSE 'matched' END AS state,
    bx1 AS fx1, by1 AS fy1, bx2 AS fx2, 250.0::DOUBLE AS fy2, bx1 AS lx1, by1 AS ly1, bx2 AS lx2, 250.0::DOUBLE AS ly2 FROM tf)"""
SAID = """SELECT 2 * p + side AS entity_id, TIMESTAMP '2024-01-01' + to_seconds(n) AS ts, task, CASE WHEN side = 1 AND mode IN (3, 4) THEN 'b' ELSE 'a' END AS label, 0.9::DOUBLE AS confidence
  FROM ps, (VALUES (0), (1)) s(side), (VALUES """ + ", ".join(f"('{t}')" for t in d.TASKS) + f""") k(task), range(2) r(n)
  WHERE mode = 1 OR mode = 5 AND task <> '{d.HARD}' OR mode = 3 AND task = '{d.HARD}' OR mode = 4 AND task = '{d.HARD}' AND n = 0"""
EACH = merging.base_sql(PAIRED, SAID, FLOOR, (4, 60, 120, 180, 240))


def _near(n, c, s, a):
    return f"c{n} <= {c} AND {size_ratio_sql(f'ct{n}p', f'ct{n}q')} <= {s} AND {merging.area_ratio_sql(f'ct{n}p', f'ct{n}q')} <= {a}"


_AT = next(k for k, (name, _) in enumerate(merging.RULES) if name == "scale_aware_reentry") + 1
OPTIONAL = merging.RULES[:_AT] + [
    ("clothing_supported_reentry", f"gap BETWEEN 30 AND 240 AND {merging.FEW} <= 2 AND {merging.MANY} <= 8 AND score >= 0.515 AND {CLOTH}"),
    ("occlusion_spatial_rejoin", f"gap > 0 AND score >= 0.53 AND (score >= 0.59 AND {_near(180, 0.42, 1.55, 2.1)} OR {_near(180, 0.5, 1.1, 2.0)}) AND NOT {STRONG}"),
] + merging.RULES[_AT:] + [("spatial_continuation", f"gap > 0 AND {merging.FEW} <= 2 AND score >= 0.2 AND c60 <= 0.3")]


def tables_of(spark, sf) -> merge.Tables:
    """The pairs as stored tables."""
    scenarios = spark.createDataFrame([(k, *s) for k, s in enumerate(SCENARIOS)],
                                      "k long, score double, n_a int, n_b int, gap long, dx long, grow double, mode int, attached boolean, two boolean")
    e = d.table(spark, sf, "embeddings").select(F.col("vec_id").alias("i"), F.col("embedding").cast("array<double>").alias("v"))

    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    unit = e.withColumn("_n", F.sqrt(dot(F.col("v"), F.col("v")))).select("i", F.transform("v", lambda x: x / F.col("_n")).alias("v"))
    pairs = unit.where("i % 2 = 0").select(F.floor(F.col("i") / 2).alias("p"), F.col("v").alias("va")).join(
        unit.where("i % 2 = 1").select(F.floor(F.col("i") / 2).alias("p"), F.col("v").alias("vb")), "p")
    pairs = cut(pairs.withColumn("rho", dot(F.col("va"), F.col("vb"))).withColumn("k", F.col("p") % len(SCENARIOS)).join(F.broadcast(scenarios), "k"))
    p, side, t = F.col("p"), F.col("side"), F.col("t")
    rest = F.sqrt(1 - F.col("score") * F.col("score")) / F.sqrt(1 - F.col("rho") * F.col("rho"))
    lean = F.zip_with("va", "vb", lambda x, y: F.col("score") * x + rest * (y - F.col("rho") * x))
    gallery = pairs.select((p * 2).alias("entity_id"), F.col("va").alias("vec")).unionByName(pairs.select((p * 2 + 1).alias("entity_id"), lean.alias("vec"))).select(
        F.col("entity_id").alias("point_id"), "entity_id", "vec")
    sides = pairs.drop("va", "vb").withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
    rows = sides.withColumn("t", F.explode(F.sequence(F.lit(0), F.when(side == 0, F.col("n_a")).otherwise(F.col("n_b")) - 1)))
    last = p * 100000 + (F.col("n_a") - 1) * 400 + 20
    start = F.when(side == 0, p * 100000 + t * 400).when(F.col("gap") == 0, last - 10 + t * 400).otherwise(last + F.col("gap") + t * 400)
    second = side == 1
    box = F.struct((F.lit(100.0) + side * F.col("dx")).alias("x1"), F.when(second, 250 - 150 * F.col("grow")).otherwise(100.0).alias("y1"),
                   F.when(second, 100 + F.col("dx") + 60 * F.col("grow")).otherwise(160.0).alias("x2"), F.lit(250.0).alias("y2"))
    device = F.concat(F.lit("d"), ((p + (F.col("two") & second & (t == 1)).cast("int")) % 4).cast("string"))
    tracklets = rows.select(
        F.concat_ws(":", "p", "side", "t").alias("tracklet_id"), (p * 2 + side).alias("entity_id"), device.alias("device_id"), start.cast("long").alias("frame_start"),
        (start + 20).cast("long").alias("frame_end"), F.when(F.col("attached") & (side == 0), "occlusion_attached").otherwise("matched").alias("state"),
        box.alias("first_box"), box.alias("last_box"))
    hard = F.col("task") == d.HARD
    said = sides.withColumn("task", F.explode(F.array(*map(F.lit, d.TASKS)))).withColumn("n", F.explode(F.array(F.lit(0), F.lit(1)))).where(
        (F.col("mode") == 1) | ((F.col("mode") == 5) & ~hard) | ((F.col("mode") == 3) & hard) | ((F.col("mode") == 4) & hard & (F.col("n") == 0)))
    labels = said.select(
        (p * 2 + side).alias("entity_id"), F.timestamp_seconds(F.unix_seconds(F.to_timestamp(F.lit("2024-01-01 00:00:00"))) + F.col("n")).alias("started_at"), "task",
        F.when(second & F.col("mode").isin(3, 4), "b").otherwise("a").alias("label"), F.lit(0.9).alias("confidence"))
    return merge.Tables(cut(tracklets), cut(labels), cut(gallery), d.HARD)


def judged(spark, sf, optional=False):
    t = tables_of(spark, sf)
    near = similarity.closest_entities(t.gallery, FLOOR - merge.MARGIN_REACH, FLOOR, ranks=merge.M.retries)
    return merge.judged(near, t, optional)


@register("bridge_reasons_each", f"WITH {merging.reasoned_sql(EACH, merging.RULES)} SELECT entity_id, other_id, reason FROM br")
def _(spark, sf):
    return judged(spark, sf).select("entity_id", "other_id", "reason")


@register("bridge_reasons_optional", f"WITH {merging.reasoned_sql(EACH, OPTIONAL)} SELECT entity_id, other_id, reason FROM br")
def _(spark, sf):
    return judged(spark, sf, optional=True).select("entity_id", "other_id", "reason")


@register("merge_guards_each", f"WITH {merging.reasoned_sql(EACH, merging.RULES)}{merging.GUARDS} {merging.OUTCOMES}")
def _(spark, sf):
    return judged(spark, sf).select("entity_id", "other_id", "rank", "rejected", "decision", "source_id", "target_id", "method")
