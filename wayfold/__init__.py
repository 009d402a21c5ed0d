"""wayfold: a PySpark library for provider directories, referral flows and training-data pipelines.

Everything is a ``DataFrame -> DataFrame`` function or a Column expression; nothing here owns a session.
"""
