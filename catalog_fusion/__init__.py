"""Fusion of film catalogues and analysis of their ratings on Spark."""

from catalog_fusion.plans.fuse import MergeReport, load_merged, merge_sources
from catalog_fusion.plans.rating_model import RatingModel, predict_rating, recommend_release_slots
from catalog_fusion.sources.scan import Source, discover

__all__ = [
    "MergeReport",
    "RatingModel",
    "Source",
    "discover",
    "load_merged",
    "merge_sources",
    "predict_rating",
    "recommend_release_slots",
]
