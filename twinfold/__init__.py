"""PySpark library for matched case-control modelling."""

from twinfold.operators.crossval import FoldCrossValidator, FoldCrossValidatorModel
from twinfold.operators.evaluator import PrecisionRecallEvaluator
from twinfold.operators.folds import assign_folds
from twinfold.plans.cleaning import clean_cohort, run_cleaning
from twinfold.plans.cluster_flow import ClusterFlowConfig, cluster_then_classify
from twinfold.plans.two_stage import TwoStageConfig, run_two_stage, two_stage
from twinfold.session import build_session, configure

__all__ = [
    "ClusterFlowConfig",
    "FoldCrossValidator",
    "FoldCrossValidatorModel",
    "PrecisionRecallEvaluator",
    "TwoStageConfig",
    "assign_folds",
    "build_session",
    "clean_cohort",
    "cluster_then_classify",
    "configure",
    "run_cleaning",
    "run_two_stage",
    "two_stage",
]
