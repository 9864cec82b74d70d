"""Thresholds and knobs. These are fixed values: results depend on them."""
from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Optional

# --- fixed values -----------------------------------------------------------
HIT_IOU = 0.30                       # strict: a hit needs IoU > HIT_IOU
LABEL_POS_IOU = 0.30                 # pos  if IoU >  0.30
LABEL_NEG_IOU = 0.10                 # neg  if IoU <  0.10, otherwise ignore
KEY_FP = (0.125, 0.25, 0.5, 1.0, 2.0, 4.0, 8.0)
N_THRESHOLDS = 200                   # probability thresholds i * 0.005
THRESHOLD_STEP = 0.005
FROC_EPS = 1e-8
SPACING_MM = (0.073, 0.200, 0.475674)
ISO_SPACING_MM = 0.4
MERGE_GAP = 8.0
MIN_BOX_AREA = 0
LESION_MIN_VOXELS = 1000
FOLDS = 5
FOLD_SEED = 0
ASSIGN_TOPK = 9
DIAG_SCORE = 0.05
NEG_POS_RATIO = 2
FULL_SEEDS = (0, 1, 2)
SELECT_MIN_EPOCH = 3
SELECT_CPM_TOL = 0.02
FP_BUDGETS = (0.125, 0.25, 0.5, 1.0, 2.0, 4.0, 8.0)
SIZE_EDGES = (0.0, 16.0, 32.0, 64.0, 128.0, None)
IOU_SWEEP = (0.1, 0.2, 0.3)
NMS_IOU_2D = 0.70
DETECTIONS_PER_SLICE = 500
OP_SCORE = 0.05
SCORE_FLOOR = 0.08
POOL_BUDGET = 200
RECALL_POOL_MAX = 1800
RECALL_FRAC = 0.98
RECON_SOFT = 0.85
RECON_FLOOR = 0.50
RECON_SOFT_SHARE = 0.85
CLUSTER_RADIUS = 10.0
GREY_IOU = 0.20
SCORE_THRESHOLDS = (0.5, 0.3, 0.2, 0.1, 0.05, 0.03, 0.02, 0.01, 0.005)
SCORE_FLOORS = (0.0, 0.03, 0.05, 0.07, 0.10, 0.15, 0.20, 0.30, 0.50)
SUMMARY_PERCENTILES = (0, 10, 25, 50, 75, 90, 100)
DESIGN_PERCENTILES = (1, 5, 10, 25, 50, 75, 90, 95, 99, 100)
SPLIT_NAMES = {"Train": "train", "Validation": "val", "Test": "test"}
PROB_CLAMP = 0.999999

# rule that turns training statistics into design constants
DESIGN_RULE = {
    "min_size_round": 32,
    "max_size_round": 32,
    "anchor_diag_lo_pct": 1,
    "anchor_diag_hi_pct": 99,
    "anchor_n_levels": 5,
    "aspect_pcts": (10, 50, 90),
    "aspect_grid": (0.2, 0.25, 0.33, 0.5, 0.75, 1.0, 1.5, 2.0),
    "anchor_min_base": 16,
    "intensity_sample_slices": 4000,
    "intensity_seed": 0,
}
# --- end of fixed values ----------------------------------------------------


@dataclass(frozen=True)
class LinkConfig:
    """Knobs of the linker and of the pool built from its tubes. ``None`` = off."""

    link_iou: float = 0.30
    max_z_gap: int = 1
    min_tube_len: int = 8
    max_tube_zspan: Optional[int] = 182
    max_centroid_drift: Optional[float] = 342.0
    containment: float = 1.0
    nms_iou: Optional[float] = None
    score_floor: float = SCORE_FLOOR
    op_score: float = 0.0
    label: str = field(default="default")

    def but(self, **kw) -> "LinkConfig":
        return replace(self, **kw)

    def link_key(self) -> tuple:
        """Configs that agree on this key have identical tubes."""
        return (self.op_score, self.containment, self.link_iou, self.max_z_gap,
                self.min_tube_len, self.max_tube_zspan, self.max_centroid_drift)
