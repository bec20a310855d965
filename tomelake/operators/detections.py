"""Detections: decoding, filters, suppression, grouping into candidates and evaluation.

A detection is (session_id, det_idx, cx, cy, width, height, angle, score). What compares detections works within a session;
pairs that may overlap meet in the cells of a grid, so a session isn't crossed with itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tomelake.functions import geometry as G
from tomelake.functions import text as T

from .components import connected_components

BOX = ["cx", "cy", "width", "height", "angle"]


def decode(anchors: DataFrame, threshold: float = G.SPINE.threshold, logits: bool = False) -> DataFrame:
    """anchors(session_id, det_idx, cx, cy, w, h, score, angle) -> detections of at least that score, canonical boxes."""
    score = G.sigmoid(F.col("score")) if logits else F.col("score")
    rows = anchors.withColumn("_score", score).filter(F.col("_score") >= threshold).withColumn("_box", G.canonical(F.col("w"), F.col("h"), F.col("angle")))
    return rows.select("session_id", "det_idx", "cx", "cy", "_box.width", "_box.height", "_box.angle", F.col("_score").alias("score"))


def channels_to_anchors(tensors: DataFrame, channels: list[str]) -> DataFrame:
    """tensors(session_id, raw array of len(channels) * n, channel after channel) -> a row per anchor with a column per channel."""
    n = (F.size("raw") / len(channels)).cast("int")
    parts = [F.slice("raw", n * i + 1, n) for i in range(len(channels))]
    zipped = F.arrays_zip(*[p.alias(c) for p, c in zip(parts, channels, strict=True)])
    rows = tensors.select("session_id", F.posexplode(zipped).alias("det_idx", "a"))
    return rows.select("session_id", "det_idx", *[F.col("a").getField(str(i) if c not in rows.select("a.*").columns else c).alias(c) for i, c in enumerate(channels)])


def geometric_filter(detections: DataFrame, preset: G.Preset = G.SPINE) -> DataFrame:
    """detections with reject_reason; the ones that stay have null."""
    return detections.withColumn("reject_reason", G.reject_reason(G.Box.of(), F.col("score"), preset))


def filter_stats(filtered: DataFrame) -> DataFrame:
    """Per session: input, output and rejects by reason."""
    reasons = ["nan", "aspect", "area_small", "area_large", "bounds", "score"]
    return filtered.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("input"), F.count_if(F.col("reject_reason").isNull()).alias("output"), *[F.count_if(F.col("reject_reason") == r).alias(f"by_{r}") for r in reasons]
    )


#: Boxes of a session up to which each meets each; beyond, boxes meet in the cells of a grid.
FEW_BOXES, LEAST_CELL = 64, 128.0


def overlapping_pairs(detections: DataFrame) -> DataFrame:
    """Pairs a < b of one session whose axis-parallel boxes meet, with iou: columns a_* and b_*.

    Small sessions are joined as they are. The boxes of a larger one go to the cells of a grid that fits its boxes, and a
    pair counts in the cell that holds the upper left corner of what the two share, so each comes once.
    """
    names = [c for c in detections.columns if c != "session_id"]
    left, right, top, bottom = G.bounds(G.Box.of())
    rows = detections.withColumns({"_l": left, "_r": right, "_t": top, "_b": bottom})
    sizes = rows.groupBy("session_id").agg((F.count(F.lit(1)) > FEW_BOXES).alias("_many"), F.greatest(F.lit(LEAST_CELL), 2 * F.avg(F.greatest(F.col("_r") - F.col("_l"), F.col("_b") - F.col("_t")))).alias("_cell"))
    rows = rows.join(sizes, "session_id")
    at = lambda v: F.floor(v / F.col("_cell"))
    grid = lambda low, high: F.when(F.col("_many"), F.sequence(at(F.col(low)), at(F.col(high)))).otherwise(F.array(F.lit(0).cast("long")))
    rows = rows.withColumn("_x", F.explode(grid("_l", "_r"))).withColumn("_y", F.explode(grid("_t", "_b")))
    side = lambda p, more: rows.select("session_id", "_x", "_y", *more, *[F.col(c).alias(f"{p}{c}") for c in ["_l", "_r", "_t", "_b", *names]])
    pairs = side("a_", ["_many", "_cell"]).join(side("b_", []), ["session_id", "_x", "_y"]).filter(F.col("a_det_idx") < F.col("b_det_idx"))
    x, y = F.greatest("a__l", "b__l"), F.greatest("a__t", "b__t")
    pairs = pairs.withColumn("_w", F.least("a__r", "b__r") - x).withColumn("_h", F.least("a__b", "b__b") - y).filter((F.col("_w") > 0) & (F.col("_h") > 0))
    pairs = pairs.filter(~F.col("_many") | ((at(x) == F.col("_x")) & (at(y) == F.col("_y"))))
    area = lambda p: (F.col(f"{p}_r") - F.col(f"{p}_l")) * (F.col(f"{p}_b") - F.col(f"{p}_t"))
    shared = F.col("_w") * F.col("_h")
    union = area("a_") + area("b_") - shared
    pairs = pairs.withColumn("iou", F.when(union > 0, shared / union).otherwise(0.0)).filter("iou > 0")
    return pairs.select("session_id", *[f"{p}{c}" for p in ("a_", "b_") for c in names], "iou")


#: What makes two detections one book.
MERGE_IOU, SPLIT_ANGLE, SPLIT_DISTANCE, SPLIT_TEXT, MOST_IN_GROUP = 0.50, 0.175, 0.15, 0.75, 3


def merge_pairs(detections: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs to be merged: session_id, a, b, reason, iou, angle_diff, center_dist, text_sim. texts(session_id, det_idx, full_text).

    Boxes that merge lie over each other (their centres are close or they overlap), so the overlapping pairs are all there is to try.
    """
    angle = G.angle_difference(F.col("a_angle"), F.col("b_angle"))
    near = F.least("a_width", "a_height", "b_width", "b_height") * SPLIT_DISTANCE
    pairs = overlapping_pairs(detections).withColumn("angle_diff", angle).withColumn("center_dist", G.center_distance(G.Box.of("a_"), G.Box.of("b_")))
    pairs = pairs.withColumn("_dup", F.col("iou") >= MERGE_IOU).filter(F.col("_dup") | ((F.col("angle_diff") <= SPLIT_ANGLE) & (F.col("center_dist") <= near)))
    text = texts.filter("full_text <> ''").select("session_id", "det_idx", "full_text")
    for side in "ab":
        pairs = pairs.join(text.select("session_id", F.col("det_idx").alias(f"{side}_det_idx"), F.col("full_text").alias(f"{side}_text")), ["session_id", f"{side}_det_idx"], "left")
    pairs = pairs.withColumn("text_sim", T.normalized_jaro_winkler(F.col("a_text"), F.col("b_text")))
    pairs = pairs.filter(F.col("_dup") | (F.col("text_sim") >= SPLIT_TEXT))
    reason = F.when(F.col("_dup"), "iou_duplicate").otherwise("split_detection").alias("reason")
    return pairs.select("session_id", F.col("a_det_idx").alias("a"), F.col("b_det_idx").alias("b"), reason, "iou", "angle_diff", "center_dist", "text_sim")


def group_detections(detections: DataFrame, merges: DataFrame, cut=lambda df: df.checkpoint()) -> DataFrame:
    """Candidates: session_id, ordering_key, det_indices, representative, confidence, centroid_x, angle, fallback.

    Components of the merges; where one of a session's has more than three members, all of that session's detections stand
    alone. Ordered by the mean of cx, ties by the smallest index. The representative has the highest score, then area.
    """
    vertex = lambda c: F.struct("session_id", F.col(c).alias("det_idx"))
    edges = merges.select(vertex("a").alias("src"), vertex("b").alias("dst"))
    group = connected_components(edges, cut=cut).select("vertex.session_id", "vertex.det_idx", F.col("component.det_idx").alias("group"))
    rows = detections.join(group, ["session_id", "det_idx"], "left").withColumn("group", F.coalesce("group", "det_idx"))
    size = F.count(F.lit(1)).over(W.partitionBy("session_id", "group"))
    rows = rows.withColumn("_size", size)
    rows = rows.withColumn("fallback", F.max("_size").over(W.partitionBy("session_id")) > MOST_IN_GROUP)
    rows = rows.withColumn("group", F.when(F.col("fallback"), F.col("det_idx")).otherwise(F.col("group")))
    found = rows.groupBy("session_id", "group").agg(
        F.array_sort(F.collect_list("det_idx")).alias("det_indices"),
        F.max_by("det_idx", F.struct("score", F.col("width") * F.col("height"), -F.col("det_idx"))).alias("representative"),
        F.max("score").alias("confidence"),
        F.avg("cx").alias("centroid_x"),
        F.avg("angle").alias("angle"),
        F.first("fallback").alias("fallback"),
    )
    place = F.row_number().over(W.partitionBy("session_id").orderBy("centroid_x", "group")) - 1
    return found.withColumn("ordering_key", place).drop("group")


# Polygons: for suppression and evaluation, where a session's boxes are compared one after the other.


def polygon(cx, cy, w, h, angle) -> list[tuple[float, float]]:
    c, s = math.cos(angle), math.sin(angle)
    return [(cx + x * c - y * s, cy + x * s + y * c) for x, y in ((-w / 2, -h / 2), (w / 2, -h / 2), (w / 2, h / 2), (-w / 2, h / 2))]


def area(points: list[tuple[float, float]]) -> float:
    return abs(sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(points, points[1:] + points[:1], strict=True))) / 2 if len(points) > 2 else 0.0


def clip(points: list[tuple[float, float]], against: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """The part of a polygon on the left of all edges of a convex one."""
    for (ax, ay), (bx, by) in zip(against, against[1:] + against[:1], strict=True):
        side = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for x, y in points]
        out = []
        for i, (p, s) in enumerate(zip(points, side, strict=True)):
            q, r = points[i - 1], side[i - 1]
            if (s >= 0) != (r >= 0):
                t = r / (r - s)
                out.append((q[0] + t * (p[0] - q[0]), q[1] + t * (p[1] - q[1])))
            if s >= 0:
                out.append(p)
        points = out
        if not points:
            return []
    return points


def box_iou(a, b) -> float:
    """Of two rotated boxes (cx, cy, width, height, angle)."""
    reach = (math.hypot(a[2], a[3]) + math.hypot(b[2], b[3])) / 2
    if math.hypot(a[0] - b[0], a[1] - b[1]) >= reach:
        return 0.0
    shared = area(clip(polygon(*a), polygon(*b)))
    union = a[2] * a[3] + b[2] * b[3] - shared
    return shared / union if union > 0 else 0.0


def bounds_iou(a, b) -> float:
    """Of the axis-parallel boxes around two rotated ones."""

    def bounds(x):
        xs, ys = zip(*polygon(*x), strict=True)
        return min(xs), max(xs), min(ys), max(ys)

    (l1, r1, t1, b1), (l2, r2, t2, b2) = bounds(a), bounds(b)
    w, h = min(r1, r2) - max(l1, l2), min(b1, b2) - max(t1, t2)
    if w <= 0 or h <= 0:
        return 0.0
    union = (r1 - l1) * (b1 - t1) + (r2 - l2) * (b2 - t2) - w * h
    return w * h / union if union > 0 else 0.0


IOU = {"obb": box_iou, "aabb": bounds_iou}


def hard_nms(boxes: list, scores: list[float], threshold: float, iou=box_iou) -> list[int]:
    """Indices that stay: best score first, dropped where the overlap with a kept one is over the threshold. Ties keep their order."""
    kept: list[int] = []
    for i in sorted(range(len(scores)), key=lambda i: -scores[i]):
        if all(iou(boxes[i], boxes[k]) <= threshold for k in kept):
            kept.append(i)
    return kept


def soft_nms(boxes: list, scores: list[float], sigma: float = 0.5, least: float = 0.001, iou=box_iou) -> list[tuple[int, float]]:
    """(index, decayed score) in the order of choice: each chosen box lowers its neighbours' scores by exp(-iou**2 / sigma)."""
    left, out = dict(enumerate(scores)), []
    while left:
        i = max(left, key=lambda k: (left[k], -k))
        if left[i] < least:
            break
        out.append((i, left.pop(i)))
        left = {k: v for k, s in left.items() if (v := s * math.exp(-(iou(boxes[i], boxes[k]) ** 2) / sigma)) >= least}
    return out


def suppress(detections: DataFrame, preset: G.Preset = G.SPINE, most: int = 500) -> DataFrame:
    """Detections of each session that survive suppression, with their scores (decayed ones for the soft kind) and rank.

    Before, each session is cut to its `most` best detections, which bounds a group.
    """
    best = W.partitionBy("session_id").orderBy(F.desc("score"), "det_idx")
    few = detections.select("session_id", "det_idx", *BOX, "score").withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= most).drop("_n")
    iou, sigma, least, soft, limit = IOU[preset.nms_mode], preset.soft_sigma, preset.soft_threshold, preset.soft, preset.nms_iou

    def one(rows: list[tuple]) -> Iterator[tuple]:
        boxes, scores = [r[2:7] for r in rows], [r[7] for r in rows]
        kept = soft_nms(boxes, scores, sigma, least, iou) if soft else [(i, scores[i]) for i in hard_nms(boxes, scores, limit, iou)]
        for rank, (i, s) in enumerate(kept):
            yield (*rows[i][:7], s, rank)

    kinds = dict(few.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in ["session_id", "det_idx", *BOX, "score"]) + ", rank long"
    return _by_session(few, ["session_id", F.desc("score"), "det_idx"], one, schema)


def _by_session(rows: DataFrame, order: list, one, schema: str) -> DataFrame:
    """one(rows of a session) for each session, streamed through sorted partitions; the first column is the session."""
    names = [c.strip().split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        for batch in batches:
            out: list[tuple] = []
            for row in batch.itertuples(index=False, name=None):
                if held and held[0][0] != row[0]:
                    out += one(held)
                    held = []
                held.append(row)
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame(list(one(held)) if held else [], columns=names)

    return rows.repartition("session_id").sortWithinPartitions(*order).mapInPandas(run, schema)


def postprocess(anchors: DataFrame, preset: G.Preset = G.SPINE) -> DataFrame:
    """Decode, suppress, filter by shape, keep the best `top_k` of each session."""
    kept = geometric_filter(suppress(decode(anchors, preset.threshold), preset), preset).filter("reject_reason is null").drop("reject_reason")
    best = W.partitionBy("session_id").orderBy("rank")
    return kept.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= preset.top_k).drop("rank")


def match_predictions(predictions: DataFrame, truth: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per session: tp, fp, fn of a greedy one-to-one match in the order of the scores."""
    columns = ["session_id", "det_idx", *BOX]
    rows = truth.select(*columns, F.lit(2.0).alias("score"), F.lit(True).alias("true")).unionByName(predictions.select(*columns, "score", F.lit(False).alias("true")))

    def one(session: list[tuple]) -> Iterator[tuple]:
        boxes = [r[2:7] for r in session if r[8]]
        free, tp, n = set(range(len(boxes))), 0, len(session) - len(boxes)
        for r in session[len(boxes) :]:
            best = max(free, key=lambda i: (box_iou(r[2:7], boxes[i]), -i), default=None)
            if best is not None and box_iou(r[2:7], boxes[best]) >= threshold:
                free.discard(best)
                tp += 1
        yield session[0][0], tp, n - tp, len(boxes) - tp

    kind = dict(predictions.dtypes)["session_id"]
    return _by_session(rows, ["session_id", F.desc("true"), F.desc("score"), "det_idx"], one, f"session_id {kind}, tp long, fp long, fn long")


def sweep(predictions: DataFrame, truth: DataFrame, thresholds: list[float]) -> DataFrame:
    """Precision, recall and f1 (four places) for each score threshold, best f1 first, ties by the lower threshold."""
    grid = predictions.select("*", F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold")).filter(F.col("score") >= F.col("threshold"))
    wanted = truth.select("*", F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold"))
    # A session at a threshold is a session of its own, numbered by the place of the threshold.
    places = F.array(*[F.lit(float(t)) for t in thresholds])
    key = lambda df: df.withColumn("session_id", F.concat_ws("|", F.array_position(places, F.col("threshold").cast("double")).cast("string"), F.col("session_id").cast("string")))
    counts = match_predictions(key(grid), key(wanted)).withColumn("threshold", F.element_at(places, F.split_part("session_id", F.lit("|"), F.lit(1)).cast("int")))
    total = counts.groupBy("threshold").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    out = total.withColumn("precision", F.round(p, 4)).withColumn("recall", F.round(r, 4)).withColumn("f1", F.round(ratio(2 * p * r, p + r), 4))
    return out.orderBy(F.desc("f1"), "threshold")


def parse_labels(lines: DataFrame, width: float, height: float) -> DataFrame:
    """lines(file, line_no, value) of `class x1 y1 ... x4 y4` (shares of the image) -> file, line_no, cx, cy, width, height, angle. Short lines are left out."""
    f = F.split(F.trim("value"), r"\s+")
    rows = lines.withColumn("f", f).filter(F.size("f") >= 9)
    xs, ys = ([F.col("f")[i].cast("double") * size for i in range(first, 9, 2)] for first, size in ((1, width), (2, height)))
    rows = rows.withColumn("_x", F.array(*xs)).withColumn("_y", F.array(*ys))
    mean = lambda c: sum(F.col(c)[i] for i in range(4)) / 4
    rows = rows.withColumn("cx", mean("_x")).withColumn("cy", mean("_y")).withColumn("_a", F.atan2(F.col("_y")[1] - F.col("_y")[0], F.col("_x")[1] - F.col("_x")[0]))
    turned = lambda u, v: [(F.col("_x")[i] - F.col("cx")) * u + (F.col("_y")[i] - F.col("cy")) * v for i in range(4)]
    along, across = turned(F.cos("_a"), F.sin("_a")), turned(-F.sin("_a"), F.cos("_a"))
    box = G.canonical(F.greatest(*along) - F.least(*along), F.greatest(*across) - F.least(*across), F.col("_a"))
    return rows.withColumn("_box", box).select("file", "line_no", "cx", "cy", "_box.width", "_box.height", "_box.angle")
