"""The analytic and curation jobs."""
