"""Spark-native data cleaning and quality engine."""

from .api import CleanPlan, ColumnPlan, ColumnProfile, ExplainReport, Profile, clean, clean_csv, compare_clean, compare_plans, explain_clean, infer_roles, profile, suggest_plan
from .cleaner import Cleaner
from .config import CleanConfig, EngineConfig
from .enterprise.cluster import ClusterConfig, clusters, merge_clusters
from .enterprise.compliance import ComplianceBundle, ComplianceConfig, generate_compliance_report
from .enterprise.interface import EnterpriseConfig, EnterpriseResult, clean_enterprise
from .enterprise.lineage import LineageConfig, LineageTracker, schema_of
from .enterprise.mask import MaskingRule, mask_dataframe
from .enterprise.semantic import SemanticValidatorConfig, run_semantic_validation
from .enterprise.trust import QualityReport, TrustScore, TrustScoreWeights, build_quality_report, compute_trust_score
from .report import Action, CleanReport
from .streaming.cleaner import StreamingCleanConfig, StreamingCleaner

__all__ = [
    "Action", "CleanConfig", "CleanPlan", "CleanReport", "Cleaner", "ClusterConfig", "ColumnPlan", "ColumnProfile", "ComplianceBundle",
    "ComplianceConfig", "EngineConfig", "EnterpriseConfig", "EnterpriseResult", "ExplainReport", "LineageConfig", "LineageTracker",
    "MaskingRule", "Profile", "QualityReport", "SemanticValidatorConfig", "StreamingCleanConfig", "StreamingCleaner", "TrustScore",
    "TrustScoreWeights", "build_quality_report", "clean", "clean_csv", "clean_enterprise", "clusters", "compare_clean", "compare_plans",
    "compute_trust_score", "explain_clean", "generate_compliance_report", "infer_roles", "mask_dataframe", "merge_clusters", "profile",
    "run_semantic_validation", "schema_of", "suggest_plan",
]
