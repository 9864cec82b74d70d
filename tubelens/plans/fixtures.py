"""Detection-shaped views over the ``events`` and ``region`` tables.

Every table grows with ``events``. Coordinates are integer-valued doubles.
"""
from __future__ import annotations

import math
import os

from pyspark.sql import DataFrame, SparkSession, functions as F

ZOOM = (0.5, 0.5, 1.0)
N_SLICES = 12
# native and resampled frame of the derived volumes
NATIVE_SHAPE = (400, 640, 12)
ISO_SHAPE = (200, 320, 12)
SLICES_PER_TASK = 4_000


class Fixtures:
    """Lazily built views for one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.dir, f"{name}.parquet"))

    def base(self) -> DataFrame:
        return self.table("events").selectExpr(
            "user_id v", "event_id e", "value",
            "cast(20+(user_id*17+(event_id%3)*53)%120 as double) bx",
            "cast(15+(user_id*29+(event_id%3)*31)%80 as double) by_",
            "15+(user_id%4)*5 w", "10+(user_id%3)*4 h")

    def det(self) -> DataFrame:
        """Per-slice boxes; ``det_id`` is unique."""
        return self.base().selectExpr(
            "e det_id", "v volume_id", "cast(floor(e/3) as bigint)%12 slice_z",
            "bx+e%7-3 x1", "by_+e%5-2 y1", "bx+e%7-3+w+e%4-1 x2", "by_+e%5-2+h+e%3-1 y2",
            "cast(least(value/500.0D,0.999999D) as double) score")

    def volumes(self) -> DataFrame:
        return self.table("events").select(F.col("user_id").alias("volume_id")).distinct()

    def lesions(self) -> DataFrame:
        """Lesion footprint: k=0 for all volumes, a second one for every fourth."""
        k = F.explode(F.when(F.col("v") % 4 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
        return self.volumes().select(F.col("volume_id").alias("v")).select("v", k.alias("k")).selectExpr(
            "v", "k",
            "case when k=0 then 20+(v*17)%120+(case v%5 when 1 then 7 when 2 then 10 else 0 end) else 20+(v*17+53)%120 end c0",
            "case when k=0 then 15+(v*29)%80+(case when v%7=0 then 40 else 0 end) else 15+(v*29+31)%80 end r0",
            "15+(v%4)*5 w", "10+(v%3)*4 h")

    def gt_slices(self) -> DataFrame:
        """Inclusive ground-truth boxes on slices 1..10."""
        z = F.explode(F.sequence(F.lit(1).cast("long"), F.lit(10).cast("long"))).alias("slice_z")
        return self.lesions().select("*", z).selectExpr(
            "v volume_id", "slice_z", "r0", "c0", "r0+h-1 r1", "c0+w-1 c1", "cast(k as bigint) component_id")

    def gt_boxes(self) -> DataFrame:
        """Official 3-D ground truth; five more volumes have ground truth and no predictions."""
        a = self.lesions().selectExpr(
            "v public_id", "cast(k+1 as bigint) label_id", "cast(5.5 as double) coordX",
            "cast(2*c0+w-1 as double) coordY", "cast(2*r0+h-1 as double) coordZ", "cast(9 as double) x_length",
            "cast(2*(w-1) as double) y_length", "cast(2*(h-1) as double) z_length")
        b = self.table("region").selectExpr(
            "cast(1000000+r_regionkey as bigint) public_id", "cast(1 as bigint) label_id", "cast(10 as double) coordX",
            "cast(10 as double) coordY", "cast(10 as double) coordZ", "cast(4 as double) x_length",
            "cast(4 as double) y_length", "cast(4 as double) z_length")
        return a.unionByName(b)

    def gt_gaps(self) -> DataFrame:
        """Ground truth in which the first lesions carry ids that no prediction knows."""
        return self.gt_boxes().withColumn("public_id", F.expr("public_id + case when label_id = 2 then 0 else 2000000 end"))

    def pred(self) -> DataFrame:
        """Ready-made 3-D predictions."""
        return self.base().selectExpr(
            "e pred_id", "v public_id", "5.5D+e%5-2 coordX", "2*bx+w-1+(e%11-5)*2 coordY",
            "2*by_+h-1+e%7-3 coordZ", "cast(9-e%2 as double) x_length", "cast(2*(w-1) as double) y_length",
            "cast(2*(h-1)+e%3 as double) z_length", "cast(least(value/500.0D,0.999999D) as double) probability")

    def meta(self) -> DataFrame:
        arr = lambda t, kind: F.array(*[F.lit(x).cast(kind) for x in t])
        return self.volumes().select(
            "volume_id", arr(NATIVE_SHAPE, "long").alias("native_shape"), arr(ISO_SHAPE, "long").alias("iso_shape"),
            arr(ZOOM, "double").alias("zoom_factors"))

    def frames(self) -> DataFrame:
        """``meta`` with frame sizes that differ by volume, for the frame statistics."""
        v = F.col("volume_id")
        return self.volumes().select(v, F.array(150 + v % 9, 320 + v % 22, F.lit(12).cast("long") + v % 3).alias("iso_shape"))

    def manifest(self) -> DataFrame:
        """Splits by ``id % 10``: 0-6 train, 7-8 val, 9 test; fold by ``id % 5`` in train."""
        return self.volumes().selectExpr(
            "volume_id", "case when volume_id%10<=6 then 'train' when volume_id%10<=8 then 'val' else 'test' end split",
            "case when volume_id%10<=6 then volume_id%5 else -1 end fold", "case when volume_id%2=0 then 'B' else 'M' end label")

    def voxels(self) -> DataFrame:
        """Set voxels of the lesion mask (lesions of one volume do not overlap). The slices are dealt out by their number before
        they grow several hundredfold; by their bytes they would lie in one or two tasks."""
        g = self.gt_slices()
        # never the usual number: Spark leaves out a repartition that equals the one before, and merges that one by bytes
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")) + 1, math.ceil(g.count() / SLICES_PER_TASK))
        g = g.repartition(parts, "volume_id")
        return (g.select("volume_id", F.col("slice_z").alias("d2"), F.explode(F.sequence("r0", "r1")).alias("d0"), "c0", "c1")
                .select("volume_id", "d0", F.explode(F.sequence("c0", "c1")).alias("d1"), "d2"))

    def slice_stats(self) -> DataFrame:
        """Intensity-like statistics per slice from the event values."""
        s = F.col("score")
        return self.det().groupBy("volume_id", "slice_z").agg(
            F.count(F.lit(1)).alias("n"), F.avg(s).alias("mean"), F.sum(s * s).alias("sumsq"), F.max(s).alias("top"))

    def dirty(self) -> DataFrame:
        """Detections where some rows break the contract."""
        return self.det().selectExpr(
            "det_id", "volume_id", "slice_z", "case when det_id%10=3 then x2 else x1 end x1", "y1",
            "case when det_id%10=3 then x1 else x2 end x2", "case when det_id%10=4 then y1 else y2 end y2",
            "case when det_id%10=5 then score+1 when det_id%10=6 then null else score end score")

    def members(self) -> DataFrame:
        """Ready-made tubes: the boxes of one cluster of one volume."""
        return self.det().withColumn("tube_id", F.col("volume_id") * 3 + F.col("det_id") % 3)

    def record(self) -> DataFrame:
        """Candidate record from the ready-made predictions, with its best IoU still to be added."""
        det = "case when public_id%10<=6 then concat('fold', public_id%5) else concat('full_seed', pred_id%3) end"
        return self.pred().selectExpr(
            "public_id", f"concat_ws(':', {det}, cast(public_id as string), cast(pred_id as string)) candidate_id",
            f"{det} detector_of_origin",
            "case when public_id%10<=6 then 'train' when public_id%10<=8 then 'val' else 'test' end split",
            "case when public_id%10<=6 then public_id%5 else -1 end fold",
            "coordX", "coordY", "coordZ", "x_length", "y_length", "z_length",
            "probability score_max", "probability*0.5D score_mean", "probability*0.1D score_std", "probability*0.25D score_min",
            "1+pred_id%7 slice_count", "1+pred_id%9 z_span", "cast(1+pred_id%7 as double)/(1+pred_id%9) fill_ratio",
            "cast(pred_id%13 as double)/100 centroid_jitter", "cast(pred_id%17 as double)/50 area_cv",
            "cast(0 as bigint) rank", "cast(0 as double) rank_norm",
            "case when pred_id%4=0 then 'pos' when pred_id%4=1 then 'ignore' else 'neg' end label",
            "cast(pred_id%10 as double)/10 iou_gt",
            "coordZ/2 cen_d0", "coordY/2 cen_d1", "coordX cen_d2",
            "cast(pred_id%11 as double) ext_d0", "cast(pred_id%6 as double) ext_d1", "cast(pred_id%5 as double) ext_d2",
            "case when public_id%3=0 then 'old' else 'new' end preprocess_hash",
            "pred_id cand_seq", "pred_id tube_id")

    def cases(self) -> DataFrame:
        """Volumes with the split names used in folders."""
        return self.manifest().selectExpr(
            "volume_id", "case split when 'train' then 'Train' when 'val' then 'Validation' else 'Test' end split", "label")

    def epoch_log(self) -> DataFrame:
        """One row per (run, epoch) of a training log, from the event values."""
        return self.base().groupBy((F.col("v") % 4).alias("run"), (F.col("e") % 12).alias("epoch")).agg(
            (F.floor(F.avg("value")) / 1000.0).alias("cpm"), (F.floor(F.max("value")) % 7 / 10.0).alias("ceiling"))

    def anchors(self) -> DataFrame:
        """Two anchor levels per image (= volume): a regular grid over its events."""
        return self.base().selectExpr(
            "v image", "e%2 level", "e anchor_id", "cast((e*7)%160 as double) x1", "cast((e*5)%110 as double) y1",
            "cast((e*7)%160 + 16 + 16*(e%2) as double) x2", "cast((e*5)%110 + 12 + 12*(e%2) as double) y2")

    def anchor_gt(self) -> DataFrame:
        return self.lesions().selectExpr("v image", "cast(k as bigint) gt_id", "cast(c0 as double) x1", "cast(r0 as double) y1",
                                         "cast(c0+w as double) x2", "cast(r0+h as double) y2")

    def paths(self) -> DataFrame:
        """File listing: a DATA and a MASK file per volume, some missing, some twice."""
        d = self.volumes().selectExpr("volume_id", "explode(sequence(1, case when volume_id%11=5 then 2 else 1 end)) n").selectExpr(
            "concat('/cases/', n, '/DATA/DATA_', volume_id, '.nrrd') path", "volume_id*10 length")
        m = self.volumes().where("volume_id%7<>3").selectExpr("concat('/cases/1/MASK/MASK_', volume_id, '.nrrd') path", "volume_id length")
        return d.unionByName(m)
