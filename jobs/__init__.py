"""Runnable jobs: `python -m jobs.index_corpus CONFIG`, `python -m jobs.study_corpus CONFIG`."""
