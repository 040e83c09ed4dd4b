"""Scoring rules, trees and weights as data."""

from __future__ import annotations

# Leaf, metric, path in the metric's record, mode, low, high, direction.
RULES = (
    ("depth_medium", "depth_temporal_consistency", "raw.medium.abs_rel.mean", "linear", 0.0, 0.14176436788561275, -1),
    ("depth_short", "depth_temporal_consistency", "raw.short.abs_rel.mean", "linear", 0.0, 0.09525020744355248, -1),
    ("gs_lpips", "da3_reconstruction", "raw.lpips.mean", "linear", 0.0, 0.7396781370043755, -1),
    ("gs_psnr", "da3_reconstruction", "raw.psnr.mean", "linear", 10.539809218922558, 16.268401595223732, 1),
    ("gs_ssim", "da3_reconstruction", "raw.ssim.mean", "unit", None, None, 1),
    ("identity_mean", "anchor_identity", "raw.macro_mean_similarity", "unit", None, None, 1),
    ("qe_anchor_depth", "evidence_query", "raw.canonical.anchor_depth.macro_abs_rel", "linear", 0.0, 2.437855698099644, -1),
    ("qe_anchor_dino", "evidence_query", "raw.canonical.anchor_macro.local_dino_similarity", "unit", None, None, 1),
    ("qe_anchor_lpips", "evidence_query", "raw.canonical.anchor_macro.lpips", "linear", 0.0, 0.8064011335372925, -1),
    ("qe_anchor_psnr", "evidence_query", "raw.canonical.anchor_macro.psnr", "linear", 6.516648524540612, 20.357512070936565, 1),
    ("qe_anchor_ssim", "evidence_query", "raw.canonical.anchor_macro.ssim", "unit", None, None, 1),
    ("qe_depth", "evidence_query", "raw.canonical.depth.abs_rel", "linear", 0.0, 0.9412913785181602, -1),
    ("qe_dino", "evidence_query", "raw.canonical.overall_evidence.local_dino_similarity", "unit", None, None, 1),
    ("qe_lpips", "evidence_query", "raw.canonical.overall_evidence.lpips", "linear", 0.0, 0.7165747284889221, -1),
    ("qe_psnr", "evidence_query", "raw.canonical.overall_evidence.psnr", "linear", 7.857921244216762, 18.650929576599054, 1),
    ("qe_ssim", "evidence_query", "raw.canonical.overall_evidence.ssim", "unit", None, None, 1),
    ("reproj_medium", "covisible_reprojection", "raw.medium.feature_reprojection_similarity.mean", "unit", None, None, 1),
    ("reproj_short", "covisible_reprojection", "raw.short.feature_reprojection_similarity.mean", "unit", None, None, 1),
    ("return_anchor_depth", "q0_return", "raw.canonical.anchor_depth.macro_abs_rel", "linear", 0.0, 2.67922551011131, -1),
    ("return_anchor_dino", "q0_return", "raw.canonical.anchor_macro.dino_similarity", "unit", None, None, 1),
    ("return_anchor_lpips", "q0_return", "raw.canonical.anchor_macro.lpips", "linear", 0.0, 0.8377343416213989, -1),
    ("return_anchor_psnr", "q0_return", "raw.canonical.anchor_macro.psnr", "linear", 6.563484363389333, 22.54424610613289, 1),
    ("return_anchor_ssim", "q0_return", "raw.canonical.anchor_macro.ssim", "unit", None, None, 1),
    ("return_depth", "q0_return", "raw.canonical.depth.abs_rel", "linear", 0.0, 1.2495174358422247, -1),
    ("return_dino", "q0_return", "raw.canonical.full_valid_image.dino_similarity", "unit", None, None, 1),
    ("return_lpips", "q0_return", "raw.canonical.full_valid_image.lpips", "linear", 0.0, 0.7513390779495239, -1),
    ("return_psnr", "q0_return", "raw.canonical.full_valid_image.psnr", "linear", 7.840857641709704, 21.064701258387007, 1),
    ("return_ssim", "q0_return", "raw.canonical.full_valid_image.ssim", "unit", None, None, 1),
    ("revisit_different_dino", "completion_revisit", "raw.direct.different_pose.dino_global_similarity.mean", "unit", None, None, 1),
    ("revisit_geom_depth_abs_rel", "completion_revisit", "raw.canonical.depth_abs_rel.mean", "linear", 0.0, 0.3347997114247419, -1),
    ("revisit_geom_dino_similarity", "completion_revisit", "raw.canonical.dino_similarity.mean", "unit", None, None, 1),
    ("revisit_geom_local_pointcloud_fscore", "completion_revisit", "raw.canonical.local_pointcloud_fscore.mean", "unit", None, None, 1),
    ("revisit_same_depth_abs_rel", "completion_revisit", "raw.direct.same_pose.depth_abs_rel.mean", "linear", 0.0, 2.059636474372718, -1),
    ("revisit_same_dino_patch_similarity", "completion_revisit", "raw.direct.same_pose.dino_patch_similarity.mean", "unit", None, None, 1),
    ("revisit_same_lpips", "completion_revisit", "raw.direct.same_pose.lpips.mean", "linear", 0.0, 0.6862051089604696, -1),
    ("revisit_same_psnr", "completion_revisit", "raw.direct.same_pose.psnr.mean", "linear", 8.392342638818656, 20.910536107951618, 1),
    ("scale", "regional_scale_inconsistency", "raw.regional_scale_inconsistency.mean", "linear", 0.0, 0.04653122656560562, -1),
)
# Trees of strict means over leaves.
TREES = {
    "return": {
        "appearance": {"full": ["return_psnr", "return_ssim", "return_lpips", "return_dino"], "anchors": ["return_anchor_psnr", "return_anchor_ssim", "return_anchor_lpips", "return_anchor_dino"]},
        "depth": ["return_depth", "return_anchor_depth"],
    },
    "query": {
        "appearance": {"full": ["qe_psnr", "qe_ssim", "qe_lpips", "qe_dino"], "anchors": ["qe_anchor_psnr", "qe_anchor_ssim", "qe_anchor_lpips", "qe_anchor_dino"]},
        "depth": ["qe_depth", "qe_anchor_depth"],
    },
    "identity": "identity_mean",
    "same_pose": {"rgb": ["revisit_same_psnr", "revisit_same_lpips"], "semantic": "revisit_same_dino_patch_similarity", "depth": "revisit_same_depth_abs_rel"},
    "different_pose": "revisit_different_dino",
    "geometry": ["revisit_geom_dino_similarity", "revisit_geom_depth_abs_rel", "revisit_geom_local_pointcloud_fscore"],
    "T5": {"depth": ["depth_short", "depth_medium"], "feature": ["reproj_short", "reproj_medium"], "scale": "scale", "reconstruction": ["gs_psnr", "gs_ssim", "gs_lpips"]},
}
# Weights.
OVERALL = {"T1": 0.25, "T2": 0.25, "T3": 0.1, "T4": 0.1, "T5": 0.1, "T6": 0.2}
T3 = {"return": 0.3, "query": 0.4, "identity": 0.3}
T6 = {"short": 0.3, "long": 0.7}
INDICATOR = {"level": 0.3, "retention": 0.7}
# The indicators of the temporal dimensions, those that are means of two, and the controls of a run without poses.
TEMPORAL = {"quality": ("hps", "imaging", "aesthetic"), "control": ("translation", "rotation", "move", "turn"), "geometry": ("depth", "feature", "scale")}
TEMPORAL_PAIRS = {"depth": ("depth_short", "depth_medium"), "feature": ("reproj_short", "reproj_medium")}
ACTION_CONTROL = ("move", "turn")
# Control errors that score 0, bounds of the preference score.
TRANSLATION_BOUND, ROTATION_BOUND = 0.215320517416, 32.764762231129
PREFERENCE = (-5.21, 8.61)
CONTROL, QUALITY = ("translation", "rotation", "move", "turn"), ("aesthetic", "imaging", "flicker", "smoothness", "hps")
# Statuses of a metric that leave a run incomplete.
INCOMPLETE = ("not_available", "invalid_input", "evaluator_failed")
