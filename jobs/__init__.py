"""Runnable jobs: each module has a run(session, ...) function and a command line."""
