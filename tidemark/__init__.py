"""Signal-window and study analytics on Spark DataFrames."""

from tidemark.config import FeatureConfig, StudyPlan, StudyQuality

__all__ = ["FeatureConfig", "StudyPlan", "StudyQuality"]
