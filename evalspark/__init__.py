"""evalspark: evaluation analytics (leaderboards, stratified pass rates, dependency
distances, text post-processing, task-program data work) as Spark DataFrame plans.

Entry points: ``evalspark.session.build_session``, the operators under
``evalspark.operators`` / ``evalspark.functions``, scans and sinks under
``evalspark.sources``, and the registered queries in ``evalspark.plans``.
"""

__version__ = "0.1.0"
