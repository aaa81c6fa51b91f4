"""Construct labels of Python sources (F32), re-aimed as a Spark job.

Parsing is per source file inside ``mapInPandas`` (stdlib ``ast``, one file
per row, files spread over partitions); everything after -- restricting to
checkpoint ranges (J6), repeated-condition flags (W7), label frequencies
(A12) -- is Spark joins and aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABEL_SCHEMA = "task string, label string, line int, cond string"


def _labels_of(text: str):
    import ast
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return
    for node in ast.walk(tree):
        if isinstance(node, (ast.For, ast.While, ast.AsyncFor)):
            yield "Define Stop Criteria", node.lineno, None
        elif isinstance(node, ast.GeneratorExp):
            yield "Generator_Expressions", node.lineno, None
        elif isinstance(node, ast.ListComp):
            yield "List_Comprehension", node.lineno, None
        elif isinstance(node, ast.Lambda):
            yield "Lambda_Expressions", node.lineno, None
        elif isinstance(node, ast.If):
            # an ``elif`` is itself an If node and reports its own line once
            yield "If-else Reasoning", node.lineno, ast.dump(node.test)
            if node.orelse and not isinstance(node.orelse[0], ast.If):
                yield "If-else Reasoning", node.orelse[0].lineno, None


def construct_labels(sources: DataFrame, task: str = "task", text: str = "text") -> DataFrame:
    """(task, text) -> rows (task, label, line, cond); ``cond`` is the shape of an
    ``if`` test (for the repeated-condition flag), null otherwise."""
    def run(it):
        import pandas as pd
        for pdf in it:
            out = [(t, lbl, ln, cond) for t, src in zip(pdf[task], pdf[text]) if src is not None
                   for lbl, ln, cond in _labels_of(src)]
            yield pd.DataFrame(out, columns=["task", "label", "line", "cond"])
    return sources.select(F.col(task).alias(task), F.col(text).alias(text)).mapInPandas(run, LABEL_SCHEMA)


def labels_in_checkpoints(labels: DataFrame, ckpts: DataFrame) -> DataFrame:
    """Labels whose line lies in a checkpoint range of the same task, plus
    ``Pattern-Based Completion`` for an ``if`` whose test shape was already
    seen earlier in the same range; counts per (task, start, end, label)."""
    from evalspark.operators.spans import records_in_range, seen_before
    j = records_in_range(ckpts, labels, ["task"], "start_line", "end_line", "line", bucket=256.0)
    conds = j.filter(F.col("cond").isNotNull()).select("task", "start_line", "end_line", "cond", "line")
    rep = seen_before(conds, ["task", "start_line", "end_line", "cond"], ["line"]) \
        .filter("repeated").select("task", "start_line", "end_line", F.lit("Pattern-Based Completion").alias("label"),
                                   "line")
    allr = j.select("task", "start_line", "end_line", "label", "line").unionByName(rep)
    return allr.groupBy("task", "start_line", "end_line", "label").agg(F.count(F.lit(1)).alias("n"))
