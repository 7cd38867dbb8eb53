"""Clustering, masking, validation, trust scores, lineage, compliance reports."""
