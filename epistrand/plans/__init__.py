"""Whole jobs, planned for as few and as narrow shuffles as possible."""

from epistrand.plans.history import horizon_test_sets, patient_runs, patient_sequences, store_sequences  # noqa: F401
